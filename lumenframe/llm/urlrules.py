"""URL filter: explicit host and path rules, then association rules mined from labels.

Spark's FP-growth mines combinations of URL tokens that occur with bad labels.
Rules pruned by support, confidence and lift are kept in an inverted index under
their rarest token; a url's tokens look up that index, and a rule fires when all
of its tokens are present.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved
from .text import ascii_lower

#: The production rules: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
BAD = "!bad"


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules: Sequence = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host suffixes, path segments with their place, extension, query names."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
        lambda n: F.concat(F.lit("h:"), F.array_join(F.slice(labels, -n, n), ".")),
    )
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    places = F.transform(segments, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    ext = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    names = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1))
    )
    scheme = F.coalesce(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit(""))
    rest = F.filter(
        F.array(
            F.when(ext != "", F.concat(F.lit("e:"), ascii_lower(ext))),
            F.when(scheme != "", F.concat(F.lit("s:"), ascii_lower(scheme))),
        ),
        lambda x: x.isNotNull(),
    )
    known = F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(known, places, names, rest))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float, min_count: int) -> DataFrame:
    """Rules from (tokens, bad): id, antecedent tokens, confidence, lift, support, and the indexed token.

    ``min_count`` is the least number of bad urls behind a rule.  FP-growth drops
    tokens under the support before it deals transactions out.
    """
    spark = labelled.sparkSession
    n, n_bad = labelled.agg(F.count("*"), F.sum(F.col("bad").cast("int"))).first()
    empty = spark.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, lift double, support double, token string")
    if not n_bad:
        return empty
    support = max(min_support, min_count / n)
    if support > 1:
        return empty
    frequent = (
        labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= support * n)
    )
    marked = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    model = FPGrowth(itemsCol="items", minSupport=float(support), minConfidence=float(min_confidence)).fit(labelled.select(marked.alias("items")))
    rules = model.associationRules.filter((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
    rules = saved(rules.select(
        F.array_sort("antecedent").alias("antecedent"), "confidence", "lift", "support",
        F.xxhash64(F.array_join(F.array_sort("antecedent"), "\x01")).alias("rule_id"),
    ), "url-rules")
    rarest = (
        rules.select("rule_id", F.explode("antecedent").alias("token")).join(frequent, "token")
        .groupBy("rule_id").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    )
    return rules.join(rarest, "rule_id").select("rule_id", "antecedent", "confidence", "lift", "support", "token")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    *,
    url_col: str = "url",
    id_col: str = "page_id",
    rules: Sequence = RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.6,
    min_lift: float = 1.5,
    min_count: int = 5,
) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``verdict``, ``mined`` and ``confidence``.

    ``labels`` has ``id`` and ``bad`` (boolean) and may cover some pages only.
    Explicit rules come first, the longest wins; else the page is blocked if a
    mined rule of at least ``min_confidence`` fires, and allowed if none does.

    Nulls: a null url, or one without ``://``, has an empty host and path, no
    host tokens, and is allowed unless a rule mined from such urls fires; a null
    label or id teaches nothing.  Rows that repeat get the same verdict each;
    an id with several labels teaches once for each.  No labels: no mined rule.
    Of several rules that fire the one of the largest confidence is named, then of
    the largest support, then the last by its tokens.  Very long urls are read
    whole, all of their tokens.  Clashing names among the added columns are
    replaced.  An empty table gives an empty result.
    """
    added = ["host", "path", "rule", "verdict", "mined", "confidence"]
    pages = pages.drop(*added)
    url = F.col(url_col)
    known = labels.filter("id is not null and bad is not null").select(F.col("id").alias("__lf_id"), "bad")
    taught = pages.select(F.col(id_col).alias("__lf_id"), tokens(url).alias("tokens")).join(known, "__lf_id").select("tokens", "bad")
    mined = mine(taught, min_support, min_confidence, min_lift, min_count)
    # Verdicts are worked out once per token set, so copies of a url and hot hosts cost one look-up.
    sets = pages.select(tokens(url).alias("__lf_t")).distinct()
    hits = (
        sets.select("__lf_t", F.explode("__lf_t").alias("token"))
        .join(mined, "token")
        .filter(F.size(F.array_except("antecedent", "__lf_t")) == 0)
        .groupBy("__lf_t")
        .agg(F.max(F.struct("confidence", "support", "antecedent")).alias("__lf_best"))
    )
    out = pages.withColumn("__lf_t", tokens(url)).join(hits, "__lf_t", "left")
    out = out.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    out = out.withColumn("__lf_x", explicit(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("__lf_best").isNotNull(), "block").otherwise("allow")
    return out.select(
        *pages.columns, "host", "path",
        F.col("__lf_x.rule").alias("rule"),
        F.coalesce("__lf_x.verdict", method).alias("verdict"),
        F.array_join("__lf_best.antecedent", " ").alias("mined"),
        F.col("__lf_best.confidence").alias("confidence"),
    )
