"""Photo planning from measurement tables: quality floor, size cap, skew consensus, upscale.

Medians are exact. Rows collapse first to (photo, distinct value, count), which combines on the map
side; the rank walk then runs over distinct values, bounded by a photo's pixel geometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import text as X


def quality_floor(metrics: DataFrame) -> DataFrame:
    shorter = F.least("width", "height")
    too_small = X.fill(K.REASON_TOO_SMALL, w=F.col("width"), h=F.col("height"), s=shorter,
                       min=F.lit(K.MIN_SHORTER_SIDE_PX))
    reason = (F.when(shorter < K.MIN_SHORTER_SIDE_PX, too_small)
              .when(F.col("laplacian_variance") < K.MIN_SHARPNESS, K.REASON_BLURRY))
    return metrics.withColumns({"shorter_side_px": shorter, "reason": reason, "ok": reason.isNull()})


def resolution_cap(metrics: DataFrame, limit: int = K.MAX_LONGEST_SIDE_PX) -> DataFrame:
    longest = F.greatest("width", "height")
    factor = F.when(longest > limit, F.lit(float(limit)) / longest).otherwise(F.lit(1.0))
    capped = {"capped_width": "width", "capped_height": "height"}
    return metrics.withColumn("cap_factor", factor).withColumns({
        new: F.when(F.col("cap_factor") < 1.0, F.floor(F.col(old) * F.col("cap_factor")).cast("int"))
        .otherwise(F.col(old)) for new, old in capped.items()})


def _with_median(values: DataFrame, value: str) -> DataFrame:
    """(image_id, value, n, total, median) per distinct value of each photo."""
    hist = values.groupBy("image_id", value).agg(F.count(F.lit(1)).alias("n"))
    photo = Window.partitionBy("image_id")
    upto = photo.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = hist.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(photo)})

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col(value))).over(photo)
    lower, upper = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return ranked.withColumn("median", (at(lower) + at(upper)) / 2)


def skew_consensus(segments: DataFrame) -> DataFrame:
    """Median line angle per photo, 0 unless enough lines agree with it."""
    angle = F.degrees(F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double")))
    angles = (segments.filter("x1 <> x2").select("image_id", angle.alias("angle"))
              .filter((F.col("angle") > -45) & (F.col("angle") < 45)))
    near = F.abs(F.col("angle") - F.col("median")) <= K.SKEW_TOLERANCE_DEG
    per_photo = _with_median(angles, "angle").groupBy("image_id").agg(
        F.sum("n").alias("n_lines"), F.first("median").alias("median_angle"),
        F.sum(F.when(near, F.col("n")).otherwise(0)).alias("n_agree"))
    trusted = ((F.col("n_lines") >= K.MIN_SKEW_LINES)
               & (F.col("n_agree") / F.col("n_lines") >= K.MIN_SKEW_AGREEMENT))
    seen = per_photo.withColumn("angle", F.when(trusted, F.col("median_angle")).otherwise(F.lit(0.0)))
    return seen.withColumn("rotation", F.when(F.abs("angle") >= K.MIN_ROTATION_DEG, F.col("angle")).otherwise(F.lit(0.0)))


def upscale_plan(metrics: DataFrame, heights: DataFrame) -> DataFrame:
    """Upscale factor from the median text height of each photo."""
    sized = (heights.join(metrics.select("image_id", F.col("height").alias("photo_height")), "image_id")
             .filter((F.col("h") > 3) & (F.col("h") < F.col("photo_height") * 0.3)).select("image_id", "h"))
    medians = _with_median(sized, "h").groupBy("image_id").agg(F.first("median").cast("double").alias("median_height"))
    m, longest = F.col("median_height"), F.greatest("width", "height")
    wanted = F.least(F.lit(K.MAX_UPSCALE), F.lit(float(K.UPSCALE_TEXT_HEIGHT_PX)) / F.greatest(m, F.lit(1.0)))
    capped = F.when(longest * wanted > K.MAX_UPSCALED_SIDE_PX, F.lit(float(K.MAX_UPSCALED_SIDE_PX)) / longest).otherwise(wanted)
    factor = F.when(m.isNull() | (m >= K.UPSCALE_TEXT_HEIGHT_PX), F.lit(1.0)).otherwise(capped)
    return metrics.join(medians, "image_id", "left").withColumn("upscale_factor", factor)


def stages_applied(plan: DataFrame) -> DataFrame:
    """Names of the stages a photo goes through, from cap_factor, rotation and upscale_factor."""
    stages = F.array_compact(F.array(
        F.when(F.col("cap_factor") < 1.0, F.concat(F.lit("resolution_cap(x"), X.fixed(F.col("cap_factor"), 3), F.lit(")"))),
        F.when(F.col("rotation") != 0.0, F.concat(F.lit("deskew("), X.fixed(F.col("rotation"), 1), F.lit(" deg)"))),
        F.lit("clahe_contrast"),
        F.when(F.col("upscale_factor") > 1.0, F.concat(F.lit("upscale(x"), X.fixed(F.col("upscale_factor"), 2), F.lit(")")))))
    return plan.withColumn("stages", stages)


def image_plan(metrics: DataFrame, segments: DataFrame, heights: DataFrame) -> DataFrame:
    capped = resolution_cap(metrics).select(
        "image_id", "cap_factor", F.col("capped_width").alias("width"), F.col("capped_height").alias("height"))
    turned = capped.join(skew_consensus(segments).select("image_id", "rotation"), "image_id", "left").withColumn(
        "rotation", F.coalesce("rotation", F.lit(0.0)))
    return stages_applied(upscale_plan(turned, heights))
