"""The stored results of the register, which verification changes a few rows at a time.

Rows lie by hash of scan in ``buckets`` partitions, each of one generation: ``rows/bucket=7/gen=0``. A load of accepted verifications reads the
buckets of its scans only and writes the new form of the changed rows, nothing else, beside them: ``changes/bucket=7/load=...``. Reading puts changes over
rows by key. Compaction writes the buckets that have changes as a next generation, then removes what that replaces.

Results are never shuffled or sorted, since their texts are wide as rows and small in column files: a new table's rows are first written into their
lots of buckets where they are and from these into buckets, so that a task has few files open, and each bucket is then written by one task as one file. Changes meet rows bucket by bucket too, in the
task that reads the bucket's files; only changes are held there.

Every step may be repeated: a load that runs again starts from what was there before it and replaces itself; changes are whole rows, so that
putting them over rows that have them already alters nothing; readers take the newest generation of a bucket, and older ones go only after it is complete. One writer at a
time is assumed. What the driver sees are numbers of buckets and loads, never rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartonscope import constants as K
from cartonscope.operators import verification as V
from cartonscope.operators.verification import KEY

BUCKETS = 64
#: Rows of changes in a bucket up to which they are held as a hash table; more are sorted together with the bucket's rows.
HASHED = 1_000_000
#: Bytes that one of the files that a task writes at a time may hold back.
BLOCK = 2 << 20


@contextmanager
def unsorted_parts(spark: SparkSession, files: int) -> Iterator[None]:
    """A task may write so many partitions side by side, so that its rows are not sorted by partition first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(files + 1))  # where all are in use, Spark sorts the rest
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _one_task(rows: DataFrame, bucket: int) -> DataFrame:
    """A bucket's rows, read by one task: nothing that joins or groups them moves them again."""
    return rows.filter(F.col("bucket") == bucket).coalesce(1)


def _together(parts: Iterable[DataFrame], like: DataFrame) -> DataFrame:
    """Buckets one behind the other, a task each. A scan of no bucket comes first: a union of single tasks alone counts as one task (Spark 4.1)."""
    return reduce(DataFrame.unionByName, parts, like.filter(F.col("bucket") < 0))


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class ResultsTable:
    """spark, the folder, and how many buckets it was created with."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("scan_id"), F.lit(self.buckets)).cast("int")

    def create(self, results: DataFrame) -> ResultsTable:
        """One file a bucket."""
        staged, tasks = f"{self.path}/staged-{uuid.uuid4().hex}", 4 * self.spark.sparkContext.defaultParallelism
        lots = math.isqrt(self.buckets - 1) + 1
        # few tasks, since each writes a file a lot; they stream, whatever they write
        self._stage(results.withColumn("bucket", self.bucket()).withColumn("lot", F.col("bucket") % lots).coalesce(tasks), f"{staged}/lots", "lot", lots)
        schema = self._schema(results)
        dealt = self.spark.read.schema(StructType([*schema.fields]).add("lot", "integer")).parquet(f"{staged}/lots")
        of_lots = [dealt.filter(F.col("lot") == n).coalesce(max(2, tasks // lots)).drop("lot") for n in range(lots)]
        self._stage(reduce(DataFrame.unionByName, of_lots), f"{staged}/buckets", "bucket", lots)
        rows = self.spark.read.schema(schema).parquet(f"{staged}/buckets")
        self._write({b: _one_task(rows, b).withColumn("gen", F.lit(0)) for b in self._numbers(f"{staged}/buckets")}, rows.withColumn("gen", F.lit(0)))
        _remove(self.spark, staged)
        return self

    def _stage(self, rows: DataFrame, path: str, part: str, files: int) -> None:
        with unsorted_parts(self.spark, files):
            rows.write.option("compression", "zstd").option("parquet.block.size", BLOCK).partitionBy(part).parquet(path)

    @staticmethod
    def _schema(rows: DataFrame) -> StructType:
        return StructType([f for f in rows.schema.fields if f.name != "bucket"]).add("bucket", "integer")

    def _write(self, parts: dict[int, DataFrame], like: DataFrame) -> None:
        """Buckets as the generations that they name, one file each."""
        with unsorted_parts(self.spark, 1):
            (_together(parts.values(), like).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "gen").parquet(f"{self.path}/rows"))

    def _numbers(self, path: str) -> list[int]:
        """Buckets that a folder has, from the names in it."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in found or [])

    def _versions(self, part: str, version: str) -> list[tuple[int, int]]:
        """(bucket, version) of all partitions, from the names of their folders."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/bucket=*/{version}=*")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        names = [s.getPath().toString().rsplit("/", 2)[1:] for s in found or []]
        return [tuple(int(n.partition("=")[2]) for n in pair) for pair in names]

    def _newest(self) -> dict[int, int]:
        newest: dict[int, int] = {}
        for bucket, gen in self._versions("rows", "gen"):
            newest[bucket] = max(gen, newest.get(bucket, gen))
        return newest

    def stored(self, wanted: list[int] | None = None) -> DataFrame:
        """Rows without later changes, of some buckets or all; the others' files are not opened."""
        newest = self._newest()
        later = {b: g for b, g in newest.items() if g > 0 and (wanted is None or b in wanted)}
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if wanted is not None:
            rows = rows.filter(F.col("bucket").isin(wanted))
        current = F.col("gen") == 0
        if later:
            gen = F.element_at(F.create_map(*[F.lit(x) for pair in later.items() for x in pair]), F.col("bucket"))
            current = F.col("gen") == F.coalesce(gen, F.lit(0))
        return rows.filter(current).drop("gen")

    def read(self, wanted: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The results as they are now, or were before a load, of some buckets or all, with their bucket."""
        if not self._versions("changes", "load"):
            return self.stored(wanted)
        changes = self.spark.read.parquet(f"{self.path}/changes")
        return self.over(changes if before is None else changes.filter(F.col("load") < before), wanted)

    def over(self, changes: DataFrame, wanted: list[int] | None = None) -> DataFrame:
        """Stored rows with loads of changes put over them, the newest load of a row on top. changes: as they were written, by bucket."""
        parts = self._parts(changes, wanted)
        return _together(parts.values(), self.stored()) if parts else self.stored([])

    def _parts(self, changes: DataFrame | None, wanted: list[int] | None = None) -> dict[int, DataFrame]:
        """Each bucket's rows with changes put over them, in the one task that reads its files."""
        newest = self._newest()
        rows = self.spark.read.parquet(f"{self.path}/rows")
        found = {b: _one_task(rows.filter(F.col("gen") == newest[b]).drop("gen"), b) for b in sorted(newest) if wanted is None or b in wanted}
        if changes is None:
            return found
        form = F.struct(*[c for c in rows.columns if c not in ("bucket", "gen", *KEY)])
        hashed = changes.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
        hint = "shuffle_hash" if hashed <= HASHED else "merge"

        def put_over(bucket: int, part: DataFrame) -> DataFrame:
            new = _one_task(changes, bucket).groupBy("bucket", *KEY).agg(F.max_by(form, "load").alias("new"))
            joined, hit = part.join(new.hint(hint), ["bucket", *KEY], "left"), F.col("new").isNotNull()
            return joined.select(*[c if c in ("bucket", *KEY) else F.when(hit, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in part.columns])
        return {b: put_over(b, part) for b, part in found.items()}

    def buckets_of(self, scans: DataFrame) -> list[int]:
        """Buckets that rows with a scan_id fall into; no more than there are."""
        return sorted(r.b for r in scans.select(self.bucket().alias("b")).distinct().collect())

    def near(self, scans: DataFrame) -> DataFrame:
        """Results of the buckets that these scans fall into."""
        return self.read(self.buckets_of(scans))

    def apply(self, accepted: DataFrame, load: int) -> list[int]:
        """Writes the new form of the rows that a load of accepted verifications changes, and returns their buckets.
        Loads are numbered upwards. A result that is no longer undecided is left as it is."""
        return self.write_changes(accepted, f"{self.path}/changes", load)

    def write_changes(self, accepted: DataFrame, path: str, load: int) -> list[int]:
        taken = f"{self.path}/taken-{uuid.uuid4().hex}"
        accepted.filter("scan_id IS NOT NULL").withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(taken)
        wanted = self._numbers(taken)
        requests = self.spark.read.schema(self._schema(accepted)).parquet(taken)
        before = self.spark.read.parquet(f"{self.path}/changes").filter(F.col("load") < load) if self._versions("changes", "load") else None

        def changed(bucket: int, part: DataFrame) -> DataFrame:
            mine = _one_task(requests, bucket).drop("bucket").hint(hint)
            # no left-semi join, since the optimizer moves that below the coalesce and shuffles for it; what is hit passes
            applied = V.apply_verifications(part.filter(F.col("status") == K.NEEDS_VERIFICATION), mine)
            return applied.filter(F.col("status") == K.PASS).select(*part.columns, F.lit(load).alias("load"))
        hint = "shuffle_hash" if requests.count() <= HASHED * self.buckets else "merge"
        parts = [changed(b, part) for b, part in self._parts(before, wanted).items()]
        with unsorted_parts(self.spark, 1):
            (_together(parts, self.stored().withColumn("load", F.lit(load))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "load").parquet(path))
        _remove(self.spark, taken)
        return wanted

    def compact(self, loads: int = 1) -> list[int]:
        """Writes buckets that have at least so many loads of changes as a next generation, and returns them."""
        found = self._versions("changes", "load")
        count: dict[int, int] = {}
        for bucket, _ in found:
            count[bucket] = count.get(bucket, 0) + 1
        due = sorted(b for b, n in count.items() if n >= loads)
        if not due:
            return []
        newest = self._newest()
        parts = self._parts(self.spark.read.parquet(f"{self.path}/changes"), due)
        self._write({b: part.withColumn("gen", F.lit(newest[b] + 1)) for b, part in parts.items()}, self.stored().withColumn("gen", F.lit(0)))
        for bucket, load in found:
            if bucket in due:
                _remove(self.spark, f"{self.path}/changes/bucket={bucket}/load={load}")
        for bucket in due:
            _remove(self.spark, f"{self.path}/rows/bucket={bucket}/gen={newest[bucket]}")
        return due
