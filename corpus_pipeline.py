"""Corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and is handed what the stage before it
kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.decontam import without_leaks
from lumenframe.llm.grayhash import representatives
from lumenframe.llm.linefreq import drop_boilerplate
from lumenframe.llm.mixing import mix
from lumenframe.llm.store import dropped, saved
from lumenframe.llm.toxcnn import judge as judge_toxicity


def _aside(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that an operator would replace under other names, and the names to put back."""
    moved = {c: f"__stage_{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    return docs.withColumnsRenamed(moved), {new: old for old, new in moved.items()}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold of their language.

    A null text scores as an empty one, a null language has the common threshold;
    equal texts of a language stay or go together.  Whole texts are scored, however
    long.  Columns named like the operator's own keep their values.  Without labels
    the untrained model's scores decide; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    moved, back = _aside(docs, "score", "predicted", "flagged")
    kept = judge_toxicity(moved, labels).filter(~F.col("flagged"))
    return kept.drop("score", "predicted", "flagged").withColumnsRenamed(back).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` follows the text.

    A null text stays null, and documents without a source keep all lines.  Every
    row is a page of its source, repeated ones too.  Whole texts are read, however
    long.  Columns named like the operator's own keep their values; an empty table
    stays empty.
    """
    moved, back = _aside(docs, "n_lines", "n_dropped")
    out = drop_boilerplate(moved)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_dropped").withColumnsRenamed(back).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Null texts count as empty ones, and these are copies of each other; a null id
    loses to any other.  Of equal rows one stays, and of rows that share an id the
    one whose text has the least hash.  Whole texts are compared, however long.
    Columns may have any names; an empty table stays empty.
    """
    return representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts stay; equal rows stay or go together, and a clean row
    stays if its id has a contaminated one.  Whole texts are searched, however
    long.  Columns may have any names.  Without items all documents stay; an empty
    table stays empty.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes, with the number of passes and words taken.

    A null or empty text has no words and is never taken; a null source is a
    source of its own.  Of equal rows at a cut as many are taken once more as the
    words left allow.  Texts are only counted.  Columns named like the operator's
    own are replaced by them; an empty table stays empty.
    """
    return mix(docs).filter("passes > 0")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]

#: A trained classifier, fingerprint components and a flow are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage kept is deleted once the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            after = saved(after, name)
            if i:
                dropped(docs)
        docs = after
    return docs
