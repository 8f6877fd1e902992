"""The dashboard from counts by day (:class:`cartonscope.sources.daily_table.DailyTable`), equal to a count of all scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.operators import register as Q
from cartonscope.operators import rollups as R


def total(days: DataFrame) -> DataFrame:
    return days.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_scans"))


def by_status(days: DataFrame) -> DataFrame:
    return days.groupBy("overall_status").agg(F.sum("n").alias("n"))


def score_bands(days: DataFrame) -> DataFrame:
    return days.filter("band IS NOT NULL").groupBy("band").agg(F.sum("n").alias("n"))


def clearance(days: DataFrame) -> DataFrame:
    """Passed share of decided scans, whole per cent (halves up); NULL when none is decided."""
    def of(status: str):
        return F.coalesce(F.sum(F.when(F.col("overall_status") == status, F.col("n"))), F.lit(0))
    n_pass, n_fail = of(K.PASS), of(K.FAIL)
    return days.agg(n_pass.alias("passed"), n_fail.alias("failed"),
                    F.floor(F.lit(100.0) * n_pass / F.nullif(n_pass + n_fail, F.lit(0)) + 0.5).cast("int").alias("clearance"))


def daily_volume(days: DataFrame, scans: DataFrame, now: str) -> DataFrame:
    """Scans a day since ``now`` minus 30 days. That instant cuts its own day in two, so this one day is counted from
    the register's partition of it; all later ones come from their counts."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {K.TREND_DAYS} DAYS")
    first = (scans.filter((F.col("scan_date") == F.to_date(since)) & (F.col("created_at") >= since))
             .groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    return days.filter(F.col("day") > F.to_date(since)).groupBy("day").agg(F.sum("n").alias("n")).unionByName(first)


def payload(days: DataFrame, scans: DataFrame, products: DataFrame, now: str) -> DataFrame:
    """One row: total_scans, by_status, recent_failures (newest first) and trend (one entry a day, without gaps).

    Each list is bounded: statuses, the latest failures, the days of the trend."""
    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))
    recent = Q.recent_noncompliant(scans, products)
    newest = listed(recent.select("created_at", "id", "product_name", "compliance_score"), "recent_failures").select(
        F.reverse("recent_failures").alias("recent_failures"))
    trend = listed(R.daily_series(daily_volume(days, scans, now), now), "trend")
    out = total(days).withColumn("one", F.lit(1))
    for part in (listed(by_status(days), "by_status"), newest, trend):
        out = out.join(F.broadcast(part.withColumn("one", F.lit(1))), "one")
    return out.drop("one")
