"""The corpus pipeline: each stage reads what the one before it kept and wrote.

Classified for quality, rejected documents going; common lines dropped; one document of each group of
near-duplicates (five-word shingles, similarity 0.8) kept; documents with benchmark windows dropped;
what is left mixed to target weights, which repeats documents, each repeat numbered in `copy`.

Line dedup leaves a document whose lines are all common as an empty text; the next stage links it with nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope.llm import decontamination, line_dedup, mixing, near_dups, quality_classifier
from cartonscope.llm.common import stored, table


READ = ("doc_id", "text", "source", "n_chars")


def aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with the columns that no stage reads under names that clash with nothing, and the way back."""
    names = {c: c if c in READ else f"aside{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(c).alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = aside(docs)
    out = line_dedup.dedup_lines(plain)
    changed = F.col("line_dropped") > 0
    return (out.withColumn("text", F.when(changed, F.col("line_kept")).otherwise(F.col("text")))
            .withColumn("n_chars", F.when(changed, F.length("line_kept").cast("long")).otherwise(F.col("n_chars"))).select(*back))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, back = aside(docs)
    return mixing.emitted(mixing.mix(plain)).select(*back, "copy")


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", benchmark), ("mixing", mixture)]
#: SQL can express neither the fitted classifier nor the systematic draw; tests hold the stages against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
