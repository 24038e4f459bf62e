"""Chat formatting: link quoted passages to the messages they come from and put replies in order.

Built-in expressions only.  Lines are given quote levels; runs of lines of one
level are passages, normalised and hashed.  A passage is joined to the latest
earlier message of its conversation whose own text, one of its passages or one
of its lines has the same hash.  Links make reply trees, and the Euler tour of
the trees is ranked by pointer doubling, so a conversation of any size is put in
reply order without ever being gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import dropped, saved
from .text import ascii_lower

BLOCK = 512
CROWD = 1024
BROADCAST_ROWS = 1_000_000
MARK = r"^(?:[ \t]*>)+"
#: Lines that announce a quotation; they go with it.
ANNOUNCES = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "))


def _hash(text: Column) -> Column:
    return F.when(text != "", F.md5(text.cast("binary")))


def parse_lines(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, pos, level, body) of every line; level is the number of quote marks."""
    lines = messages.select("mid", "conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", MARK, 0)
    level = F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))
    body = F.when(level > 0, F.regexp_replace("line", MARK + "[ \t]?", "")).otherwise(F.col("line"))
    return lines.select("mid", "conv_id", "turn", "pos", level.alias("level"), body.alias("body"))


def _latest_before(origins: DataFrame, asks: DataFrame, key: list[str]) -> DataFrame:
    """For each ask (key, turn) the latest origin of the key with a smaller turn, as ``found`` (turn, mid).

    ``origins`` has one row for each key and turn, ``asks`` too.  Turns are cut
    into blocks; a block is one bounded window, and what stands before a block is
    carried from block to block as one row each.
    """
    block = F.floor(F.col("turn") / BLOCK).alias("block")
    rows = origins.select(*key, block, "turn", F.struct("turn", "mid").alias("o"), F.lit(False).alias("ask")).unionByName(
        asks.select(*key, block, "turn", F.lit(None).cast("struct<turn:bigint,mid:string>").alias("o"), F.lit(True).alias("ask"))
    )
    inside = Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    here = rows.withColumn("near", F.max("o").over(inside)).filter("ask")
    tops = rows.groupBy(*key, "block").agg(F.max("o").alias("top"))
    over = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.withColumn("far", F.max("top").over(over)).select(*key, "block", "far")
    return here.join(carried, [*key, "block"]).select(*key, "turn", F.coalesce("near", "far").alias("found"))


def link(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (mid, level, passage, origin turn and mid) and texts without quotes (mid, own)."""
    lines = parse_lines(messages)
    w = Window.partitionBy("mid").orderBy("pos")
    nxt = F.coalesce(F.lead("level").over(w), F.lit(0))
    announces = (F.col("level") == 0) & (nxt > 0) & F.col("body").rlike(ANNOUNCES)
    lines = lines.withColumn("level", F.when(announces, F.lit(-1)).otherwise(F.col("level")))
    new = F.coalesce((F.col("level") != F.lag("level").over(w)).cast("int"), F.lit(1))
    lines = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "body")))
    runs = lines.groupBy("mid", "conv_id", "turn", "run").agg(F.first("level").alias("level"), F.transform(ordered, lambda x: x["body"]).alias("bodies"))
    runs = saved(runs.withColumn("whole", normal(F.array_join("bodies", " "))), "runs")
    own_runs = F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("run", "bodies"))))
    own = runs.groupBy("mid", "conv_id", "turn").agg(
        F.flatten(F.transform(own_runs, lambda x: x["bodies"])).alias("lines"), F.max(F.col("level") != 0).alias("quotes")
    )
    # trailing and leading blank lines are left over from cut quotes
    clean = F.when(F.col("quotes"), F.regexp_replace(F.array_join("lines", "\n"), r"^\s+|\s+$", "")).otherwise(F.array_join("lines", "\n"))
    texts = own.select("mid", clean.alias("own"), "quotes")

    one = F.transform("bodies", lambda x: _hash(normal(x)))
    quoted = runs.filter("level > 0").select("mid", "conv_id", "turn", "run", "level", F.explode(F.array_distinct(F.concat(
        F.array(F.struct(_hash(F.col("whole")).alias("h"), F.lit(True).alias("full"))),
        F.transform(one, lambda h: F.struct(h.alias("h"), F.lit(False).alias("full"))),
    ))).alias("u")).select("mid", "conv_id", "turn", "run", "level", "u.h", "u.full").filter("h is not null")
    # only conversations that quote are looked through for origins
    quoted = saved(quoted, "quoted")
    asking = quoted.select("conv_id").distinct()
    if asking.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        asking = F.broadcast(asking)
    said = runs.filter("level = 0").join(asking, "conv_id", "left_semi").select("mid", "conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array(_hash(F.col("whole"))), one))).alias("h"))
    whole = own.join(asking, "conv_id", "left_semi").select("mid", "conv_id", "turn", _hash(normal(F.array_join("lines", " "))).alias("h"))
    origins = said.unionByName(whole).filter("h is not null").groupBy("conv_id", "h", "turn").agg(F.min("mid").alias("mid"))
    # only what is quoted somewhere in the conversation can be an origin
    origins = origins.join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    asks = quoted.select("conv_id", "h", "turn").distinct()
    found = _latest_before(origins, asks, ["conv_id", "h"]).filter("found is not null")
    hits = quoted.join(found, ["conv_id", "h", "turn"])
    # the whole passage decides; else the message that most of its lines come from, the latest on ties
    votes = hits.groupBy("mid", "run", "level", "found").agg(F.max("full").alias("full"), F.count("*").alias("n"))
    best = votes.groupBy("mid", "run", "level").agg(F.max(F.struct("full", "n", "found")).alias("b"))
    return best.select("mid", "run", "level", F.col("b.found").alias("found")), texts


def _blocked(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``block``: blocks of turns, and where one turn holds very many children of a parent, of turns and leading digits of ``mid``."""
    n = nodes.withColumn("b", F.floor(F.col("turn") / BLOCK))
    key = ["conv_id", "parent", "b"]
    crowds = n.groupBy(*key, "turn").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    crowds = saved(crowds.withColumn("k", F.ceil(F.log(16.0, F.col("n") / CROWD)).cast("int")).drop("n"), "crowds")
    rows = crowds.count()
    if not rows:
        return n.withColumn("block", F.struct("b", F.lit(0).cast("long").alias("t"), F.lit("").alias("m")))
    fine = crowds.select(*key).distinct().withColumn("fine", F.lit(True))
    if rows <= BROADCAST_ROWS:
        crowds, fine = F.broadcast(crowds), F.broadcast(fine)
    n = n.join(fine, key, "left").join(crowds, [*key, "turn"], "left")
    turn = F.when(F.col("fine"), F.col("turn")).otherwise(0)
    digits = F.when(F.col("k").isNotNull(), F.expr("substring(mid, 1, k)")).otherwise("")
    return n.withColumn("block", F.struct("b", turn.alias("t"), digits.alias("m"))).drop("k", "fine")


def _next_sibling(nodes: DataFrame) -> DataFrame:
    """(mid, next): the next child of the same parent by turn and ``mid``, block by block."""
    n = saved(_blocked(nodes).select("conv_id", "parent", "block", "mid", F.struct("turn", "mid").alias("me")), "siblings")
    inside = Window.partitionBy("conv_id", "parent", "block").orderBy("me")
    first = n.groupBy("conv_id", "parent", "block").agg(F.min("me").alias("low"))
    over = Window.partitionBy("conv_id", "parent").orderBy("block")
    carried = first.withColumn("far", F.lead("low").over(over)).select("conv_id", "parent", "block", "far")
    near = n.withColumn("near", F.lead("me").over(inside))
    return near.join(carried, ["conv_id", "parent", "block"]).select("mid", F.coalesce("near.mid", "far.mid").alias("next"))


def reply_order(nodes: DataFrame) -> DataFrame:
    """(mid, position, depth) from (mid, conv_id, turn, parent); a root's parent is "".

    Every node has a way down and a way up.  Each event knows the next one of the
    tour; doubling the pointers sums up the ways down and up that follow.
    """
    first = nodes.groupBy("conv_id", "parent").agg(F.min(F.struct("turn", "mid"))["mid"].alias("child"))
    child = first.filter("parent != ''").select(F.col("parent").alias("mid"), "child")
    steps = nodes.join(child, "mid", "left").join(_next_sibling(nodes), "mid", "left")
    down = steps.select(
        F.concat("mid", F.lit("d")).alias("e"),
        F.when(F.col("child").isNotNull(), F.concat("child", F.lit("d"))).otherwise(F.concat("mid", F.lit("u"))).alias("to"),
        F.lit(1).cast("long").alias("downs"), F.lit(0).cast("long").alias("ups"),
    )
    parent_up = F.when(F.col("parent") != "", F.concat("parent", F.lit("u")))
    up = steps.select(
        F.concat("mid", F.lit("u")).alias("e"),
        F.when(F.col("next").isNotNull(), F.concat("next", F.lit("d"))).otherwise(parent_up).alias("to"),
        F.lit(0).cast("long").alias("downs"), F.lit(1).cast("long").alias("ups"),
    )
    now = saved(down.unionByName(up), "tour")
    while now.filter("to is not null").limit(1).count():
        ahead = now.select(F.col("e").alias("to"), F.col("to").alias("to2"), F.col("downs").alias("d2"), F.col("ups").alias("u2"))
        # events that have reached the end of their tour take no further part
        moved = now.filter("to is not null").join(ahead, "to").select(
            "e", F.col("to2").alias("to"), (F.col("downs") + F.col("d2")).alias("downs"), (F.col("ups") + F.col("u2")).alias("ups")
        )
        before = now
        now = saved(now.filter("to is null").unionByName(moved), "tour")
        dropped(before)
    ranked = now.filter(F.col("e").endswith("d")).select(F.expr("substring(e, 1, 32)").alias("mid"), "downs", (F.col("ups") - F.col("downs")).cast("int").alias("depth"))
    total = nodes.groupBy("conv_id").agg(F.count("*").alias("n"))
    return nodes.select("mid", "conv_id").join(total, "conv_id").join(ranked, "mid").select("mid", (F.col("n") - F.col("downs") + 1).alias("position"), "depth")


def conversations(
    messages: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per message: its text without quotes and its place in the reply order.

    Columns ``conv_id``, ``turn``, ``role``, ``text`` (without quoted lines and
    the lines that announce them), ``copies``, ``n_quotes`` (quoted passages),
    ``n_linked``, ``parent_turn``, ``linked_by`` (``quote``, ``previous`` or
    null), ``depth`` and ``position`` (from 1 in its conversation).

    The parent is the message that the passages of the least quote level come
    from, the latest where there are several; without a link it is the previous
    turn.  Replies stand under their parent in the order of their turns.

    Nulls: a message without a conversation or turn stands alone at position 1; a
    null text is an empty one.  Equal rows are one message with ``copies``.
    Different messages of one turn are ordered by a hash of their content, and
    never reply to each other, however many there are.  Texts of any length are
    parsed whole.  Other columns are not looked at, whatever their names.  An empty
    table gives an empty result.
    """
    base = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    mid = F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")).cast("binary"))
    base = saved(base.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("mid", mid), "messages")
    links, texts = link(base)
    links = saved(links, "links")
    counts = links.groupBy("mid").agg(F.count("*").alias("n_linked"), F.min(F.struct("level", (-F.col("found.turn")).alias("t"), "found"))["found"].alias("origin"))
    placed = base.filter("conv_id is not null and turn is not null")
    turns = placed.groupBy("conv_id", "turn").agg(F.min("mid").alias("mid"))
    previous = _latest_before(turns, turns.select("conv_id", "turn"), ["conv_id"]).select("conv_id", "turn", F.col("found").alias("before"))
    nodes = placed.join(counts, "mid", "left").join(previous, ["conv_id", "turn"])
    parent = F.coalesce("origin", "before")
    nodes = saved(
        nodes.select(
            "mid", "conv_id", "turn", F.coalesce(parent["mid"], F.lit("")).alias("parent"), parent["turn"].alias("parent_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            F.when(F.col("origin").isNotNull(), "quote").when(F.col("before").isNotNull(), "previous").alias("linked_by"),
        ),
        "nodes",
    )
    order = reply_order(nodes.select("mid", "conv_id", "turn", "parent"))
    known = nodes.select("mid", "parent_turn", "linked_by", "n_linked").join(order, "mid")
    passages = parse_lines(base.filter(F.col("text").contains(">")))
    w = Window.partitionBy("mid").orderBy("pos")
    starts = (F.col("level") > 0) & (F.col("level") != F.coalesce(F.lag("level").over(w), F.lit(0)))
    n_quotes = passages.withColumn("s", starts.cast("long")).groupBy("mid").agg(F.sum("s").alias("n_quotes"))
    out = base.drop("text").join(texts, "mid").join(known, "mid", "left").join(n_quotes, "mid", "left")
    return out.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), "copies", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent_turn", "linked_by", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("position", F.lit(1)).cast("long").alias("position"),
    )
