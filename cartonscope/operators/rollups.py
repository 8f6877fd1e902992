"""Per-scan verdicts, evidence boxes and dashboard aggregates. Every aggregate is mergeable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartonscope import constants as K


def _n(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("scan_id").agg(
        _n(K.PASS).alias("pass_count"), _n(K.FAIL).alias("fail_count"),
        _n(K.NEEDS_VERIFICATION).alias("needs_verification_count"),
        _n(K.NOT_APPLICABLE).alias("not_applicable_count"))


def score_of(passed: Column, applicable: Column) -> Column:
    """Share of applicable checks passed, one decimal, halves to the even digit; NULL when none applies."""
    return F.bround(F.lit(100.0) * passed / F.nullif(applicable, F.lit(0)), 1)


def _applicable() -> Column:
    return F.col("pass_count") + F.col("fail_count") + F.col("needs_verification_count")


def compliance_score(results: DataFrame) -> DataFrame:
    return status_counts(results).select(
        "scan_id", score_of(F.col("pass_count"), _applicable()).alias("compliance_score"))


def verdict() -> Column:
    return (F.when(F.col("fail_count") > 0, K.FAIL)
            .when(F.col("needs_verification_count") > 0, K.NEEDS_VERIFICATION).otherwise(K.PASS))


def overall_status(results: DataFrame) -> DataFrame:
    return status_counts(results).select("scan_id", verdict().alias("overall_status"))


def rollup(results: DataFrame) -> DataFrame:
    """Counts, score and verdict in one aggregate."""
    return status_counts(results).withColumns({
        "compliance_score": score_of(F.col("pass_count"), _applicable()), "overall_status": verdict()})


def evidence_boxes(results: DataFrame) -> DataFrame:
    """Boxes worth drawing: one row per distinct box with its worst status and the rules behind it.

    A group holds at most one row per registered rule."""
    box = F.col("evidence.bounding_box")
    drawn = results.filter(F.col("status").isin(K.PASS, K.FAIL) & box.isNotNull()).select(
        "scan_id", "rule_no", "rule_id", "status", box["x"].alias("x"), box["y"].alias("y"),
        box["width"].alias("width"), box["height"].alias("height"))
    failed = F.count_if(F.col("status") == K.FAIL) > 0
    ids = F.array_sort(F.collect_list(F.struct("rule_no", "rule_id", "status")))
    grouped = drawn.groupBy("scan_id", "x", "y", "width", "height").agg(failed.alias("failed"), ids.alias("cited"))
    worst = F.when(F.col("failed"), K.FAIL).otherwise(K.PASS)
    return (grouped.withColumn("worst_status", worst)
            .withColumn("label", F.concat(F.array_join(F.transform(
                F.filter("cited", lambda c: c["status"] == F.col("worst_status")), lambda c: c["rule_id"]), "/"),
                F.lit(" "), F.col("worst_status")))
            .drop("failed", "cited"))


def clip_boxes(boxes: DataFrame, meta: DataFrame) -> DataFrame:
    w, h = F.col("image_width_px"), F.col("image_height_px")

    def clamp(c, upper):
        return F.greatest(F.lit(0), F.least(c, upper))
    return boxes.join(meta.select("scan_id", "image_width_px", "image_height_px"), "scan_id").withColumns({
        "x1": clamp(F.col("x"), w - 1), "y1": clamp(F.col("y"), h - 1),
        "x2": clamp(F.col("x") + F.col("width"), w), "y2": clamp(F.col("y") + F.col("height"), h)})


# ---- dashboard -------------------------------------------------------------------------------

def total_scans(scans: DataFrame) -> DataFrame:
    return scans.agg(F.count(F.lit(1)).alias("total_scans"))


def scans_by_status(scans: DataFrame) -> DataFrame:
    return scans.groupBy("overall_status").agg(F.count(F.lit(1)).alias("n"))


def daily_volume(scans: DataFrame, now: str) -> DataFrame:
    """Days with scans since ``now`` minus 30 days (an instant, so up to 31 calendar days).

    Tables partitioned by scan_date read only those partitions."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {K.TREND_DAYS} DAYS")
    return (scans.filter((F.col("scan_date") >= F.to_date(since)) & (F.col("created_at") >= since))
            .groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")))


def daily_series(volume: DataFrame, today: str) -> DataFrame:
    """Contiguous 30-day series ending ``today``; days without scans count zero."""
    end = F.lit(today).cast("date")
    days = volume.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(end, K.TREND_DAYS - 1), end)).alias("day"))
    return days.join(volume, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def clearance(scans: DataFrame) -> DataFrame:
    """Passed share of decided scans, whole per cent (halves up); NULL when none is decided."""
    n_pass = F.count_if(F.col("overall_status") == K.PASS)
    n_fail = F.count_if(F.col("overall_status") == K.FAIL)
    return scans.agg(n_pass.alias("passed"), n_fail.alias("failed"),
                     F.floor(F.lit(100.0) * n_pass / F.nullif(n_pass + n_fail, F.lit(0)) + 0.5)
                     .cast("int").alias("clearance"))


def shares_and_peak(scans: DataFrame, now: str) -> DataFrame:
    """Status shares in whole per cent, next to the 30-day total and the busiest day (at least 1).

    The share window runs over the handful of status groups."""
    shares = scans_by_status(scans)
    total = F.sum("n").over(Window.partitionBy())
    volume = daily_volume(scans, now)
    series = daily_series(volume, now)
    trend = volume.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trend_total"))
    peak = series.agg(F.greatest(F.lit(1).cast("bigint"), F.max("n")).alias("peak"))
    return (shares.withColumn("share_pct", F.floor(F.lit(100.0) * F.col("n") / total + 0.5).cast("int"))
            .withColumn("one", F.lit(1)).join(F.broadcast(trend.withColumn("one", F.lit(1))), "one")
            .join(F.broadcast(peak.withColumn("one", F.lit(1))), "one").drop("one"))


def golden_diff(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected against actual status per (label, rule): OK, MISMATCH or MISSING."""
    actual = results.select("scan_id", "rule_id", F.col("status").alias("actual"))
    return expected.join(actual, ["scan_id", "rule_id"], "left").withColumn(
        "outcome", F.when(F.col("actual").isNull(), "MISSING")
        .when(F.col("actual") == F.col("expected"), "OK").otherwise("MISMATCH"))


def golden_summary(diff: DataFrame) -> DataFrame:
    per_label = diff.groupBy("scan_id").agg(F.bool_and(F.col("outcome") == "OK").alias("matched"))
    return per_label.agg(F.count_if("matched").alias("labels_matched"), F.count(F.lit(1)).alias("labels"))


def score_band(score: Column) -> Column:
    return (F.when(score >= K.SCORE_HIGH, "high").when(score >= K.SCORE_MID, "mid")
            .when(score.isNotNull(), "low"))


def score_bands(scans: DataFrame) -> DataFrame:
    return (scans.select(score_band(F.col("compliance_score")).alias("band")).filter("band IS NOT NULL")
            .groupBy("band").agg(F.count(F.lit(1)).alias("n")))
