"""Registered queries and their DuckDB counterparts, one pair a line of work.

Python functions in the queries are lowered by capture; the SQL spells out what
they mean.  Where the tables lack the characters that an operator acts on, both
sides put them in first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unicode_sets as U
from ..functions.reuse import dictionary_batch, distinct_apply, hoisted, lookup_join, row_udf
from ..functions.udf import lowerable
from ..operators import drive, relational as R, text as X
from ..sources import io
from .explain import explain_udf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The 29 whitespace code points, as RE2 spells them.
WS = "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in U.ranges("isspace")) + "]"
NWS = "[^" + WS[1:]
ALNUM = "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in U.ranges("isalnum") if a < 0x250) + "]"


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return io.read_parquet(spark, f"{d}/{name}.parquet")


# ---- functions as a user would write them


@lowerable("boolean")
def keep_length(text, low=50, high=2000):
    n = len(text)
    return low <= n <= high


@lowerable("double")
def affine(v):
    return v * 1.5 + 1.25


@lowerable("string")
def grade(v):
    if v is None:
        return "none"
    if v < 10.0:
        return "low"
    return "mid" if v <= 50.0 else "high"


@lowerable("boolean")
def q6_keep(discount, quantity):
    return 0.05 <= discount and discount <= 0.07 and quantity < 24.0


@lowerable("double")
def revenue(price, discount):
    return price * discount


@lowerable("bigint")
def letters(text):
    return sum(1 for c in text if c.isalnum())


@lowerable("double")
def alnum_ratio_of(text):
    if not text:
        return 0.0
    return sum(1 for c in text if c.isalnum()) / len(text)


@lowerable("bigint")
def vowels(text):
    n = 0
    for c in text:
        if c in "aeiou":
            n += 1
    return n


@lowerable("double")
def total(xs):
    s = 0.0
    for x in xs:
        s += x
    return s


@lowerable("bigint")
def positives(xs):
    return sum(1 for x in xs if x > 0.0)


@lowerable("bigint")
def priority_rank(p):
    ranks = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}
    return ranks.get("none", 0) + 1 if p not in ("1-URGENT", "2-HIGH") else 0


@lowerable("boolean")
def startish(name):
    return name.startswith("Customer#0000000") or name.endswith("7")


@lowerable("string")
def tagged(kind):
    return "<" + kind + ">"


@lowerable("string")
def first_char(text):
    return text[0]


@lowerable("bigint")
def truncated(v):
    return int(abs(v))


def _slow_label(kind: str) -> str:
    """Not lowerable: formats a value."""
    return f"{kind}:{len(kind):03d}"


# ---- lowered functions


@query("SELECT lang, count(*) AS n FROM documents WHERE length(text) BETWEEN 50 AND 2000 GROUP BY lang")
def length_filter_by_lang(spark, d):
    return R.where(table(spark, d, "documents"), keep_length("text")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT event_id, value * 1.5 + 1.25 AS out FROM events")
def affine_projection(spark, d):
    return R.select(table(spark, d, "events"), "event_id", out=affine("value"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'none' WHEN value < 10 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS grade FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)")
def null_select(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return R.select(df, "event_id", grade=grade("value"))


@query("SELECT event_id, CAST(trunc(abs(value)) AS BIGINT) AS v FROM events")
def cast_abs(spark, d):
    return R.select(table(spark, d, "events"), "event_id", v=truncated("value"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6_udf(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate >= '1994-01-01' AND l_shipdate < '1995-01-01'")
    kept = R.where(li, q6_keep("l_discount", "l_quantity"))
    return R.with_columns(kept, {"r": revenue("l_extendedprice", "l_discount")}).agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT doc_id, translate(replace(replace(replace(text, '.', '—'), 'th', '“'), ',', '’'), '“”‘’–—', '\"\"''''--') AS text FROM documents")
def punct_normalize(spark, d):
    odd = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("—")), F.lit("th"), F.lit("“")), F.lit(","), F.lit("’"))
    return R.with_columns(table(spark, d, "documents").select("doc_id", odd.alias("text")), {"text": X.PUNCT("text")})


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def clean_html(spark, d):
    return R.select(table(spark, d, "pages"), "page_id", text=X.HTML("html"))


@query(f"SELECT doc_id, trim(regexp_replace(replace(text, '.', chr(12288) || chr(9)), '{WS}+', ' ', 'g')) AS text FROM documents")
def ws_normalize(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("."), F.lit("　\t")).alias("text"))
    return R.with_columns(df, {"text": X.SPACES("text")})


@query("SELECT doc_id, translate(regexp_replace(replace(text, ' ', chr(12288)), '^" + WS + "+|" + WS + "+$', '', 'g'), '" + "".join(sorted(X.BLANKS)) + "', '" + " " * len(X.BLANKS) + "') AS text FROM documents")
def join_translate(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(" "), F.lit("　")).alias("text"))
    return R.with_columns(df, {"text": X.JOINED("text")})


@query(f"SELECT page_id, regexp_replace(url || ' ' || html, 'https?://{NWS}+|www\\.{NWS}+', '', 'gi') AS text FROM pages")
def clean_links(spark, d):
    df = table(spark, d, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))
    return R.with_columns(df, {"text": X.LINKS("text")})


@query(f"SELECT doc_id, regexp_replace(text || ' (c) 2020 Foo. All rights reserved x', '(copyright{WS}*\\(?c\\)?|©|\\(c\\)|all rights reserved)[^\\n.]*\\.?', '', 'gi') AS text FROM documents")
def clean_copyright(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" (c) 2020 Foo. All rights reserved x")).alias("text"))
    return R.with_columns(df, {"text": X.COPYRIGHT("text")})


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '', 'g') AS text FROM documents")
def clean_email(spark, d):
    return R.with_columns(table(spark, d, "documents").select("doc_id", "text"), {"text": X.EMAIL("text")})


@query("SELECT doc_id, length(text) > 0 AND 10 * len(regexp_extract_all(text, '[a-zA-Z]')) >= length(text) AND trim(text) <> '' AS english FROM documents")
def language_en(spark, d):
    return R.select(table(spark, d, "documents"), "doc_id", english=X.LANGUAGE("text"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{ALNUM}')) AS BIGINT) AS letters, CASE WHEN text = '' THEN 0.0 ELSE round(len(regexp_extract_all(text, '{ALNUM}')) / length(text), 9) END AS ratio FROM documents")
def alnum_ratio(spark, d):
    out = R.select(table(spark, d, "documents"), "doc_id", letters=letters("text"), ratio=alnum_ratio_of("text"))
    return out.withColumn("ratio", F.round("ratio", 9))


@query("SELECT doc_id, CAST(length(text) - length(translate(text, 'aeiou', '')) AS BIGINT) AS vowels FROM documents")
def explicit_loop(spark, d):
    return R.select(table(spark, d, "documents"), "doc_id", vowels=vowels("text"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS p FROM embeddings")
def emb_sum(spark, d):
    out = R.select(table(spark, d, "embeddings"), "vec_id", s=total("embedding"), p=positives("embedding"))
    return out.withColumn("s", F.round("s", 4))


@query("SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000000') OR ends_with(c_name, '7')")
def string_predicates(spark, d):
    return R.where(table(spark, d, "customer"), startish("c_name")).select("c_custkey")


@query("SELECT event_id, '<' || event_type || '>' AS tag, event_type[1] AS head FROM events")
def concat_index(spark, d):
    return R.select(table(spark, d, "events"), "event_id", tag=tagged("event_type"), head=first_char("event_type"))


@query("SELECT o_orderpriority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS rank, count(*) AS n FROM orders GROUP BY 1, 2")
def static_table(spark, d):
    df = R.with_columns(table(spark, d, "orders"), {"rank": priority_rank("o_orderpriority")})
    return df.groupBy("o_orderpriority", F.col("rank").cast("int").alias("rank")).agg(F.count("*").alias("n"))


# ---- batch and reuse


@query("SELECT event_id, event_type || ':' || lpad(CAST(length(event_type) AS VARCHAR), 3, '0') AS label FROM events")
def dict_reuse(spark, d):
    from pyspark.sql import types as T

    return table(spark, d, "events").select("event_id", dictionary_batch(_slow_label, T.StringType(), 16_384)("event_type").alias("label"))


@query("SELECT event_id, event_type || ':' || lpad(CAST(length(event_type) AS VARCHAR), 3, '0') AS label FROM events")
def distinct_reuse(spark, d):
    from pyspark.sql import types as T

    out = distinct_apply(table(spark, d, "events"), "event_type", "label", lambda c: row_udf(_slow_label, T.StringType())(c))
    return out.select("event_id", "label")


@query("SELECT event_id, 'run-7' AS run FROM events")
def invariant_hoist(spark, d):
    return table(spark, d, "events").select("event_id", hoisted(lambda n: f"run-{n}", 7).alias("run"))


@query("SELECT c_custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def value_lookup(spark, d):
    out = lookup_join(table(spark, d, "customer"), "c_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name", "nation", "none")
    return out.select("c_custkey", "nation")


@query("SELECT c_custkey, CASE WHEN n_name IS NULL THEN '{\"row\":\"' || c_nationkey || '\",\"record\":null}' ELSE '{\"row\":\"' || c_nationkey || '\",\"record\":{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}}' END AS aligned FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def ad_sensor_align(spark, d):
    out = drive.sensor_align(table(spark, d, "customer"), "c_nationkey", table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")
    return out.select("c_custkey", "aligned")


@query("""
WITH logged AS (
  SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'no json' WHEN 1 THEN props ELSE '{"path": "/logs/' || (event_id % 300) || '.bin"}' END AS payload, event_id % 5 > 1 AS named
  FROM events
), listing AS (SELECT '/logs/' || p_partkey || '.bin' AS file, p_size AS bytes FROM part WHERE p_partkey % 2 = 0)
SELECT event_id, '{"file":' || CASE WHEN named THEN '"/logs/' || (event_id % 300) || '.bin"' ELSE 'null' END
  || ',"json":' || CASE WHEN event_id % 5 = 0 THEN 'false' ELSE 'true' END || ',"bytes":' || coalesce(CAST(bytes AS VARCHAR), 'null') || '}' AS matched
FROM logged LEFT JOIN listing ON named AND file = '/logs/' || (event_id % 300) || '.bin'
""")
def ad_index(spark, d):
    kind, file = F.col("event_id") % 5, F.concat(F.lit("/logs/"), (F.col("event_id") % 300).cast("string"), F.lit(".bin"))
    logged = F.when(kind == 0, F.lit("no json")).when(kind == 1, F.col("props")).otherwise(F.concat(F.lit('{"path": "'), file, F.lit('"}')))
    listing = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.concat(F.lit("/logs/"), F.col("p_partkey").cast("string"), F.lit(".bin")).alias("file"), F.col("p_size").alias("bytes"))
    return drive.match_files(table(spark, d, "events").withColumn("payload", logged), "payload", listing).select("event_id", "matched")


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def fix_unicode(spark, d):
    return table(spark, d, "documents").select("doc_id", X.nfc_column(F.col("text")).alias("text"))


@query("""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents WHERE text IS NOT NULL),
chars AS (SELECT r, c, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(text, '(?s).')) AS c FROM d) GROUP BY r, c),
size AS (SELECT r, sum(n) AS total FROM chars GROUP BY r),
score AS (SELECT r, pow(2, -sum(n / total * log2(n / total))) AS p FROM chars JOIN size USING (r) GROUP BY r)
SELECT doc_id FROM d LEFT JOIN score USING (r) WHERE coalesce(p, 1) <= 17.77
""")
def perplexity_filter(spark, d):
    return X.perplexity_filter(table(spark, d, "documents"), "text", 17.77).select("doc_id")


@query(f"""
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM documents
""")
def text_chunk(spark, d):
    return R.select(table(spark, d, "documents"), "doc_id", text=X.CHUNKS("text"))


@query("SELECT DISTINCT text FROM documents")
def dedup_text(spark, d):
    return X.document_deduplicator(table(spark, d, "documents").select("text"))


_CLEANED = f"""
SELECT trim(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '<[^>]+>', ' ', 'g'), 'https?://{NWS}+|www\\.{NWS}+', '', 'gi'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '', 'g'),
  '(copyright{WS}*\\(?c\\)?|©|\\(c\\)|all rights reserved)[^\\n.]*\\.?', '', 'gi'), '“”‘’–—', '""''''--'), '{WS}+', ' ', 'g')) AS text
FROM documents"""


@query(f"""
WITH c AS ({_CLEANED})
SELECT DISTINCT text FROM c WHERE length(text) BETWEEN 5 AND 100000
  AND len(regexp_extract_all(text, '{ALNUM}')) / length(text) >= 0.2
  AND 10 * len(regexp_extract_all(text, '[a-zA-Z]')) >= length(text)
""")
def text_pipeline(spark, d):
    return X.clean_pipeline(table(spark, d, "documents").select("text"))


@query("""
SELECT * FROM (VALUES
  ('clean_html', 'native', 'proven', 'regex'), ('clean_links', 'native', 'proven', 'links'), ('clean_email', 'native', 'proven', 'email'),
  ('clean_copyright', 'native', 'proven', 'copyright'), ('fix_unicode', 'arrow', 'call', ''), ('normalize_punctuation', 'native', 'proven', 'translate'),
  ('normalize_whitespace', 'native', 'proven', 'whitespace,strip'), ('replace_blanks', 'native', 'proven', 'strip,join_translate,translate'),
  ('split_chunks', 'native', 'proven', 'sentences,strip,join'), ('text_length', 'native', 'proven', 'len,compare.le'),
  ('alphanumeric', 'native', 'proven', 'unicode.isalnum,count,len,binary.truediv,compare.ge,select'),
  ('language_score', 'native', 'proven', 'findall,argmax,strip,compare.ne,len,binary.truediv,compare.ge')
) AS t(name, route, reason, operators)
""")
def explain_calls(spark, d):
    docs = table(spark, d, "documents")
    rows = explain_udf(docs, *(u("text") for u in X.MAPPERS.values()), X.LENGTH("text"), X.ALNUM("text"), X.LANGUAGE("text"))
    return spark.createDataFrame([(r["name"], r["route"], r["reason"], ",".join(r["operators"])) for r in rows], "name string, route string, reason string, operators string")


# ---- relational surface


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def groupby_agg(spark, d):
    li = R.where(table(spark, d, "lineitem"), F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return R.groupby(li, "l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT r_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_chain(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    out = R.join(o, c, F.col("o_custkey") == F.col("c_custkey"))
    out = R.join(out, n, F.col("c_nationkey") == F.col("n_nationkey"))
    return R.join(out, r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return R.join(table(spark, d, "customer").select("c_custkey"), big, "c_custkey", "semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_anti(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return R.join(table(spark, d, "customer").select("c_custkey"), o, "c_custkey", "anti")


@query("SELECT n_name, s_name FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def join_left(spark, d):
    return R.join(table(spark, d, "nation"), table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "s_name")


def _keys(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return c, table(spark, d, "supplier").filter("s_suppkey <= 8").select(F.col("s_nationkey").alias("k"))


_C, _S = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_suppkey <= 8"


@query(f"{_C} UNION {_S}")
def set_union(spark, d):
    return R.union(*_keys(spark, d))


@query(f"{_C} UNION ALL {_S}")
def set_union_all(spark, d):
    return R.union_all(*_keys(spark, d))


@query(f"{_C} UNION ALL {_S}")
def set_concat(spark, d):
    return R.concat(*_keys(spark, d))


@query(f"{_C} UNION BY NAME {_S}")
def set_union_by_name(spark, d):
    return R.union_by_name(*_keys(spark, d))


@query(f"{_C} UNION ALL BY NAME {_S}")
def set_union_all_by_name(spark, d):
    return R.union_all_by_name(*_keys(spark, d))


@query(f"{_C} INTERSECT {_S}")
def set_intersect(spark, d):
    return R.intersect(*_keys(spark, d))


@query(f"{_C} INTERSECT ALL {_S}")
def set_intersect_all(spark, d):
    return R.intersect_all(*_keys(spark, d))


@query(f"{_C} EXCEPT {_S}")
def set_except_distinct(spark, d):
    return R.except_distinct(*_keys(spark, d))


@query(f"{_C} EXCEPT ALL {_S}")
def set_except_all(spark, d):
    return R.except_all(*_keys(spark, d))


@query("SELECT count(o_orderkey) AS o_orderkey FROM orders")
def agg_count(spark, d):
    return R.count(table(spark, d, "orders"), "o_orderkey")


@query("SELECT round(sum(o_totalprice), 2) AS o_totalprice FROM orders")
def agg_sum(spark, d):
    return R.sum(table(spark, d, "orders"), "o_totalprice").select(F.round("o_totalprice", 2).alias("o_totalprice"))


@query("SELECT min(o_totalprice) AS o_totalprice, min(o_orderdate) AS o_orderdate FROM orders")
def agg_min(spark, d):
    return R.min(table(spark, d, "orders"), "o_totalprice", "o_orderdate")


@query("SELECT max(o_totalprice) AS o_totalprice, max(o_orderdate) AS o_orderdate FROM orders")
def agg_max(spark, d):
    return R.max(table(spark, d, "orders"), "o_totalprice", "o_orderdate")


@query("SELECT round(avg(o_totalprice), 4) AS o_totalprice FROM orders")
def agg_mean(spark, d):
    return R.mean(table(spark, d, "orders"), "o_totalprice").select(F.round("o_totalprice", 4).alias("o_totalprice"))


@query("SELECT round(stddev_pop(o_totalprice), 3) AS o_totalprice FROM orders")
def agg_stddev(spark, d):
    return R.stddev(table(spark, d, "orders"), "o_totalprice").select(F.round("o_totalprice", 3).alias("o_totalprice"))


@query("SELECT array_to_string(list_sort(list(c_mktsegment)), ',') AS segments FROM customer")
def agg_list(spark, d):
    out = R.agg_list(table(spark, d, "customer"), "c_mktsegment")
    return out.select(F.array_join(F.array_sort("c_mktsegment"), ",").alias("segments"))


@query("SELECT array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer")
def agg_set(spark, d):
    return R.agg_set(table(spark, d, "customer"), "c_mktsegment").select(F.array_join(F.array_sort("c_mktsegment"), ",").alias("segments"))


@query("SELECT array_to_string(list_sort(regexp_extract_all(string_agg(n_name, ''), '.')), '') AS letters FROM nation")
def agg_concat(spark, d):
    out = R.agg_concat(table(spark, d, "nation"), "n_name")
    return out.select(F.array_join(F.array_sort(F.split("n_name", "")), "").alias("letters"))


@query("SELECT any_value(n_name) AS n_name FROM nation WHERE n_nationkey = 7")
def agg_any_value(spark, d):
    return R.any_value(table(spark, d, "nation").filter("n_nationkey = 7"), "n_name")


@query("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")
def agg_global(spark, d):
    return R.agg(table(spark, d, "orders"), F.count("*").alias("n"), F.max("o_totalprice").alias("top"))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def rows_distinct(spark, d):
    return R.unique(table(spark, d, "customer").select("c_mktsegment", "c_nationkey"))


@query("SELECT c_mktsegment FROM customer GROUP BY 1")
def rows_drop_duplicates(spark, d):
    return R.drop_duplicates(table(spark, d, "customer"), "c_mktsegment").select("c_mktsegment")


@query("SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL")
def rows_drop_null(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    return R.drop_null(df, "value")


@query("SELECT event_id, value FROM events WHERE event_id % 5 <> 0")
def rows_drop_nan(spark, d):
    df = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return R.drop_nan(df)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def rows_sort_limit_offset(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.limit(R.offset(R.sort(o, "o_totalprice", "o_orderkey", desc=[True, False]), 5), 20)


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def rows_explode(spark, d):
    df = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("line"))
    return R.explode(df, "line")


@query("SELECT o_orderkey, variable, value FROM (UNPIVOT (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice FROM orders) ON o_custkey, o_totalprice INTO NAME variable VALUE value)")
def rows_unpivot(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), "o_totalprice")
    return R.melt(df, ["o_orderkey"])


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY 1")
def rows_pivot(spark, d):
    out = R.pivot(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", names=["F", "O"])
    return out.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def columns_rename_exclude(spark, d):
    df = R.exclude(table(spark, d, "nation"), "n_regionkey")
    return R.with_columns_renamed(R.with_column_renamed(df, "n_nationkey", "key"), {"n_name": "name"})


@query("SELECT n_name, n_nationkey FROM nation")
def columns_getitem(spark, d):
    return R.getitem(table(spark, d, "nation"), ["n_name", "n_nationkey"])


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders")
def columns_with_column(spark, d):
    return R.with_column(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "twice", F.col("o_totalprice") * 2).select("o_orderkey", "twice")


@query("SELECT count(*) AS n FROM orders")
def partitions_repartition(spark, d):
    return R.into_partitions(R.repartition(table(spark, d, "orders"), 4, "o_custkey"), 2).agg(F.count("*").alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def rows_pipe(spark, d):
    return R.pipe(table(spark, d, "nation"), lambda df: df.groupBy("n_regionkey").agg(F.count("*").alias("n")))


@query()
def rows_sample(spark, d):
    return R.sample(table(spark, d, "orders"), 0.1, seed=7)


@query("""
SELECT column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type, true AS nullable
FROM (DESCRIBE SELECT * FROM nation)
""")
def frame_describe(spark, d):
    return R.describe(table(spark, d, "nation"))


def _summary(name: str, kind: str) -> str:
    return f"SELECT '{name}' AS column_name, '{kind}' AS type, CAST(min({name}) AS VARCHAR) AS min, CAST(max({name}) AS VARCHAR) AS max, count({name}) AS count, count(*) - count({name}) AS nulls FROM nation"


@query(" UNION ALL ".join(_summary(n, k) for n, k in (("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int"))))
def frame_summarize(spark, d):
    return R.summarize(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")).drop("approx_distinct")


# ---- more of what is captured


PRIORITY = {"1-URGENT": 1, "2-HIGH": 2}


@lowerable("string")
def shouted(text, lang):
    return f"{lang.upper()}: {text.lower().removeprefix('the ')}"


@lowerable("double")
def clamped(v):
    return max(10.0, min(v, 1000.0))


@lowerable("bigint")
def priority(name):
    return PRIORITY.get(name, 0)


@lowerable("array<double>")
def range_of(v):
    return [v, v * 2.0]


@lowerable("struct<name:string,total:double,large:boolean>")
def summary_of(name, v):
    return name, v, v > 1000.0


@lowerable("double")
def field_sum(row):
    return row["price"] * 2.0 if row.late else row["price"]


@lowerable("string")
def initials(text):
    return "".join(w.upper() for w in text.split(" ") if w != "")


def _checksum(text: str) -> int:
    return sum(ord(c) for c in text)  # stays Python


@lowerable("bigint")
def checksum_of(name):
    return _checksum(name.replace("#", "")) * 2


@query("SELECT doc_id, upper(lang) || ': ' || regexp_replace(lower(text), '^the ', '') AS said FROM documents WHERE lang IS NOT NULL")
def capture_case(spark, d):
    return R.select(table(spark, d, "documents").filter("lang is not null"), "doc_id", said=shouted("text", "lang"))


@query("SELECT o_orderkey, least(greatest(o_totalprice, 10), 1000) AS price FROM orders")
def capture_extremes(spark, d):
    return R.select(table(spark, d, "orders"), "o_orderkey", price=clamped("o_totalprice"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS priority FROM orders")
def capture_lookup_default(spark, d):
    return R.select(table(spark, d, "orders"), "o_orderkey", priority=priority("o_orderpriority"))


@query("SELECT c_custkey, c_acctbal AS low, c_acctbal * 2 AS high, c_name AS name, c_acctbal AS total, c_acctbal > 1000 AS large FROM customer")
def capture_results(spark, d):
    out = R.select(table(spark, d, "customer"), "c_custkey", pair=range_of("c_acctbal"), told=summary_of("c_name", "c_acctbal"))
    return out.select("c_custkey", F.col("pair")[0].alias("low"), F.col("pair")[1].alias("high"), "told.*")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate > TIMESTAMP '1997-01-01' THEN l_extendedprice * 2 ELSE l_extendedprice END AS price FROM lineitem")
def capture_struct(spark, d):
    li = table(spark, d, "lineitem")
    row = F.struct(F.col("l_extendedprice").alias("price"), (F.col("l_shipdate") > F.lit("1997-01-01").cast("timestamp")).alias("late"))
    return R.select(li.withColumn("row", row), "l_orderkey", "l_linenumber", price=field_sum("row"))


@query("SELECT p_partkey, upper(replace(p_type, ' ', '')) AS letters FROM part")
def capture_split_join(spark, d):
    return R.select(table(spark, d, "part"), "p_partkey", letters=initials("p_type"))


@query("SELECT c_custkey, CAST(2 * list_sum(list_transform(regexp_extract_all(replace(c_name, '#', ''), '.'), lambda x: ascii(x))) AS BIGINT) AS tag FROM customer")
def capture_region(spark, d):
    return R.select(table(spark, d, "customer"), "c_custkey", tag=checksum_of("c_name"))
