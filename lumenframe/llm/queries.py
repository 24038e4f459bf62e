"""One query per operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quotelink import conversations

    return conversations(_t(spark, sf_dir, "conversations"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linefreq import drop_boilerplate

    out = drop_boilerplate(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op3_mix_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_t(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", "source")


def op4_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxcnn import judge, learnable

    out = judge(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", "predicted", "flagged", "lang")


def op5_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .interpolm import scores

    return scores(_t(spark, sf_dir, "documents"))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langmix import identify, learnable

    out = identify(_t(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "langs", "proportions")


def op7_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .anisoann import search

    return search(_t(spark, sf_dir, "embeddings"))


def op8_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grayhash import groups

    return groups(_t(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("bad"))
    out = judge(_t(spark, sf_dir, "pages").select("page_id", "url"), labels)
    return out.select("page_id", "host", "path", "rule", "verdict", "mined", "confidence")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import leaks

    return leaks(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quote_links": op1_quote_links,
    "op2_line_frequency": op2_line_frequency,
    "op3_mix_flow": op3_mix_flow,
    "op4_toxic_cnn": op4_toxic_cnn,
    "op5_interpolated_lm": op5_interpolated_lm,
    "op6_language_mixture": op6_language_mixture,
    "op7_anisotropic_ann": op7_anisotropic_ann,
    "op8_simhash_gray": op8_simhash_gray,
    "op9_url_rules": op9_url_rules,
    "op10_decontaminate": op10_decontaminate,
}

ORACLES: dict[str, str] = {
    # The tables hold no quoted lines, so there every message replies to the turn before it;
    # quotes are tested against brute force.
    "op1_quote_links": r"""
WITH m AS (SELECT conv_id, turn, role, text, count(*) AS copies FROM conversations GROUP BY ALL)
SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '\r\n|\r', chr(10), 'g') AS text, copies,
       CAST(0 AS BIGINT) AS n_quotes, CAST(0 AS BIGINT) AS n_linked, lag(turn) OVER w AS parent_turn,
       CASE WHEN lag(turn) OVER w IS NULL THEN NULL ELSE 'previous' END AS linked_by,
       CAST(row_number() OVER w - 1 AS INTEGER) AS depth, row_number() OVER w AS position
FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""",
    "op2_line_frequency": r"""
WITH pages AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, source, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT r, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pages WHERE text IS NOT NULL)
),
marked AS (SELECT r, source, i, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines),
bad AS (
  SELECT source, bare FROM (
    SELECT source, bare, count(DISTINCT r) AS n FROM marked WHERE bare <> '' AND source IS NOT NULL GROUP BY source, bare
  ) JOIN (SELECT source, count(*) AS total FROM pages GROUP BY source) USING (source)
  WHERE n >= 10 AND n > 0.1 * total
),
kept AS (
  SELECT m.r, count(*) AS n_lines, sum(CASE WHEN b.bare IS NULL THEN 0 ELSE 1 END) AS n_dropped,
         coalesce(string_agg(m.line, chr(10) ORDER BY m.i) FILTER (WHERE b.bare IS NULL), '') AS text
  FROM marked m LEFT JOIN bad b ON m.source = b.source AND m.bare = b.bare GROUP BY m.r
)
SELECT p.doc_id, p.source, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(k.n_dropped, 0) AS BIGINT) AS n_dropped,
       CASE WHEN p.text IS NULL THEN NULL ELSE k.text END AS text
FROM pages p LEFT JOIN kept k USING (r)
""",
}
