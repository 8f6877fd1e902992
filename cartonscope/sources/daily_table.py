"""Scans counted by day, status and score band, kept up to date by loads, so that a dashboard reads days and not scans.

Each load writes what it adds to the counts under ``deltas/load=...``: a load of scans their number, a load of verifications minus one for what
a scan was and plus one for what it is now. Compaction sums the loads up to the newest one into ``base/through=...``; how many rows are read
then depends on days, not on scans or loads.

Every step may be repeated. A load counts once it is complete (its folder has the mark that Spark writes last); one that is complete, or summed
up already, is left as it is, and one that failed is written anew. Readers take the newest complete base and the complete loads after it.
Loads are numbered upwards over scans and verifications together; one writer at a time is assumed, which finishes a load before it begins the next.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope.operators import rollups as R
from cartonscope.sources.results_table import ResultsTable, _remove

COUNTS = "day date, overall_status string, band string, n bigint"
KINDS = ["day", "overall_status", "band"]


def counted(scans: DataFrame) -> DataFrame:
    """(day, overall_status, band, n) of scans with created_at, overall_status and compliance_score; nulls are groups of their own."""
    return scans.groupBy(F.to_date("created_at").alias("day"), "overall_status", R.score_band(F.col("compliance_score")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KINDS).agg(F.sum("n").alias("n")).filter("n <> 0")


@dataclass(frozen=True)
class DailyTable:
    spark: SparkSession
    path: str

    def _complete(self, part: str, version: str) -> list[int]:
        """Numbers of the complete folders, from their names."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/{version}=*/_SUCCESS")
        found = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(target)
        return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found or [])

    def _through(self) -> int | None:
        return max(self._complete("base", "through"), default=None)

    def _parts(self) -> list[str]:
        through = self._through()
        base = [] if through is None else [f"{self.path}/base/through={through}"]
        return base + [f"{self.path}/deltas/load={n}" for n in self._complete("deltas", "load") if through is None or n > through]

    def holds(self, load: int) -> bool:
        through = self._through()
        return (through is not None and load <= through) or load in self._complete("deltas", "load")

    def _write(self, counts: DataFrame, load: int) -> bool:
        counts.repartition(1).write.mode("overwrite").parquet(f"{self.path}/deltas/load={load}")
        return True

    def add_scans(self, scans: DataFrame, load: int) -> bool:
        """Counts a load of new scans; False where it was counted before."""
        return not self.holds(load) and self._write(counted(scans), load)

    def add_changes(self, before: DataFrame, after: DataFrame, load: int) -> bool:
        """Counts scans as ``after`` no longer as ``before``; both hold the same scans."""
        if self.holds(load):
            return False
        gone = counted(before).withColumn("n", -F.col("n"))
        return self._write(_summed(gone.unionByName(counted(after))), load)

    def add_verifications(self, results: ResultsTable, accepted: DataFrame, scans: DataFrame, change: int, load: int) -> bool:
        """Counts what the load ``change`` of verifications made of its scans. It comes before the compaction of ``results`` that takes
        that load in, since the results before it are still to be told from those after it."""
        if self.holds(load):
            return False
        mine = accepted.select("scan_id").distinct()
        known = scans.select(F.col("id").alias("scan_id"), "created_at").join(mine, "scan_id", "left_semi")
        wanted = results.buckets_of(mine)

        def at(limit: int) -> DataFrame:
            return known.join(R.rollup(results.read(wanted, limit).join(mine, "scan_id", "left_semi")), "scan_id")
        return self.add_changes(at(change), at(change + 1), load)

    def read(self) -> DataFrame:
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], COUNTS)
        return _summed(reduce(DataFrame.unionByName, [self.spark.read.schema(COUNTS).parquet(p) for p in parts]))

    def compact(self) -> int | None:
        """Sums all complete loads into one base and returns the newest load in it."""
        before = self._through()
        loads = [n for n in self._complete("deltas", "load") if before is None or n > before]
        if loads:
            self.read().repartition(1).write.mode("overwrite").parquet(f"{self.path}/base/through={loads[-1]}")
        # What the newest base replaces goes only now, also where an earlier compaction ended before this.
        through = self._through()
        for old in self._complete("base", "through")[:-1]:
            _remove(self.spark, f"{self.path}/base/through={old}")
        for load in self._complete("deltas", "load"):
            if through is not None and load <= through:
                _remove(self.spark, f"{self.path}/deltas/load={load}")
        return through
