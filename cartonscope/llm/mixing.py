"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source size times. Documents of a source stand in
one order, by size, then a hash bucket, then id; their expected copies are summed along it, one
random offset is added for the source, and a document is emitted once for each whole number its
stretch crosses. Ordering by size keeps what a source takes within one document of its target.

Defined cases: null or wordless text has size 0 and may be emitted, at no cost; a null source is a
source, last; a source without words gets target 0; an empty table gives an empty mix. Repeated rows
and equal ids are separate documents. Columns named mix_* of the input are replaced, all others kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Equal sizes of a source are dealt over so many buckets, so that no one order spans a hot size.
BUCKETS = 256


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of sources (key, source, source_size): share of all sizes by weight, at most `most` times a
    source's size, the excess reshared by weight. One row per source, so its order is one window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last(), "mix_key")
    everything = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "mix_key")
    t = (sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
         .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share))))
    capped = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("level", (F.col("total") - capped) / open_weight)
    # Sources reach their cap in the order of cap / weight; the first that does not sets the level of all after it.
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"),
                         F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap"))
    return t.select("mix_key", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = BUCKETS) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target and mix_copies (times the mix holds the row)."""
    rows = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    rows = rows.select(
        "*", words_in(F.col(text_col)).alias("mix_size"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("mix_key"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(buckets)).alias("mix_bucket"))
    groups = rows.groupBy("mix_key", "mix_size", "mix_bucket").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.col(source_col).cast("string")).alias("source"))
    sizes = groups.groupBy("mix_key").agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size"),
                                          F.first("source").alias("source"))
    # Rank of a group's first document in its source: over sizes, then over the buckets of a size.
    of_size = groups.groupBy("mix_key", "mix_size").agg(F.sum("n").alias("n"))
    before = lambda *order: Window.partitionBy(*order[:-1]).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.select("mix_key", "mix_size", F.coalesce(
        F.sum("n").over(before("mix_key", "mix_size")), F.lit(0)).alias("smaller"))
    places = (groups.withColumn("earlier", F.coalesce(
        F.sum("n").over(before("mix_key", "mix_size", "mix_bucket")), F.lit(0)))
        .join(of_size, ["mix_key", "mix_size"]).join(source_targets(sizes, weights, share, most), "mix_key")
        .select("mix_key", "mix_size", "mix_bucket", (F.col("smaller") + F.col("earlier")).alias("mix_before"),
                F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")))
    # F.col(id_col) is the order inside a group; rows that tie have equal size and so equal shares.
    rank = F.row_number().over(Window.partitionBy("mix_key", "mix_size", "mix_bucket").orderBy(F.col(id_col)))
    each = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.col("mix_key")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    end = F.col("mix_before") + F.col("mix_rank")
    copies = (F.floor(each * end + offset) - F.floor(each * (end - 1) + offset)).cast("long")
    return (rows.join(places, ["mix_key", "mix_size", "mix_bucket"]).withColumn("mix_rank", rank)
            .withColumn("mix_copies", copies).drop("mix_key", "mix_bucket", "mix_before", "mix_rank"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as mix_copies says, numbered from 1 in `copy`."""
    return mixed.filter("mix_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
