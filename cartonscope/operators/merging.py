"""Reconciliation of several readers of the same label.

Declarations hold one row per scan on every side, so merging is one equi-join on scan_id and a
column-wise choice; long form joins on (scan_id, field_name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import text as X
from cartonscope.operators.extraction import not_found
from cartonscope.schemas import EXTRACTED


def is_found(field: Column) -> Column:
    return F.coalesce(field["found"], F.lit(False))


def better_pass(p: Column, s: Column) -> Column:
    """The primary pass unless it found nothing or the other pass is strictly more confident."""
    p_conf = F.coalesce(p["ocr_confidence"], F.lit(0.0))
    s_conf = F.coalesce(s["ocr_confidence"], F.lit(0.0))
    take_second = is_found(s) & (~is_found(p) | (s_conf > p_conf))
    return F.when(take_second, s).otherwise(F.coalesce(p, not_found()))


def with_vision(ocr: Column, vision: Column, agree: Column | None = None) -> Column:
    """Vision fills gaps, corroborates agreement, and wins disagreement while OCR keeps the box."""
    agree = agree if agree is not None else X.values_agree(ocr["value"], vision["value"])
    combined = F.struct(
        F.when(agree, ocr["value"]).otherwise(vision["value"]).alias("value"), ocr["raw_text_span"].alias("raw_text_span"),
        ocr["bounding_box"].alias("bounding_box"), ocr["ocr_confidence"].alias("ocr_confidence"),
        ocr["language"].alias("language"), F.lit(True).alias("found"),
        F.when(agree, "ocr+vision").otherwise("vision").alias("source"),
        F.when(agree, ocr["disagreement_note"])
        .otherwise(F.concat(F.lit(K.NOTE_DISAGREEMENT), X.quoted(F.coalesce(ocr["value"], F.lit("None")))))
        .alias("disagreement_note")).cast(EXTRACTED)
    return (F.when(~is_found(vision), F.coalesce(ocr, not_found()))
            .when(~is_found(ocr), vision).otherwise(combined))


def _second_side(df: DataFrame) -> DataFrame:
    return df.select("scan_id", *[F.col(f).alias(f"s_{f}") for f in K.DECLARATION_FIELDS])


def rederive_category(unit: Column, prior: Column) -> Column:
    return X.unit_category(F.when(unit != "", unit), prior)


def on_ids(ids: DataFrame, declarations: DataFrame) -> DataFrame:
    """declarations for all of ids (scan_id), unknown where they have none. Merging what covers all ids needs outer joins to one side
    only; these keep the layout of their left side, so that bucketed tables are merged one after the other without an exchange."""
    return ids.join(declarations, "scan_id", "left")


def merge_passes(primary: DataFrame, secondary: DataFrame, covered: bool = False) -> DataFrame:
    """Two passes over the same photos; flags, geometry and warnings stay the primary's, and are unknown
    for a photo that only the second pass read. covered: primary has every photo (:func:`on_ids`)."""
    j = primary.join(_second_side(secondary), "scan_id", "left" if covered else "full_outer")
    merged = j.withColumns({f: better_pass(F.col(f), F.col(f"s_{f}")) for f in K.DECLARATION_FIELDS})
    return (merged.withColumn("commodity_category",
                              rederive_category(F.col("net_quantity_unit.value"), F.col("commodity_category")))
            .select(primary.columns))


def merge_vision(ocr: DataFrame, vision: DataFrame, covered: bool = False) -> DataFrame:
    """OCR and vision; a label that only one of them read keeps that reading. covered: ocr has every label."""
    j = ocr.join(_second_side(vision), "scan_id", "left" if covered else "full_outer")
    agree = j.withColumns({f"agree_{f}": X.values_agree(F.col(f"{f}.value"), F.col(f"s_{f}.value"))
                           for f in K.DECLARATION_FIELDS})
    merged = agree.withColumns({f: with_vision(F.col(f), F.col(f"s_{f}"), F.col(f"agree_{f}"))
                                for f in K.DECLARATION_FIELDS})
    return merged.withColumns({
        "commodity_category": rederive_category(F.col("net_quantity_unit.value"), F.col("commodity_category")),
        "is_imported": F.when(F.col("country_of_origin.found"), F.lit(True)).otherwise(F.col("is_imported")),
    }).select(ocr.columns)


def merge_fields(a: DataFrame, b: DataFrame, choose) -> DataFrame:
    """Long form: full outer join on (scan_id, field_name), ``choose`` = better_pass | with_vision."""
    def side(df, name):
        return df.select("scan_id", "field_name", F.struct(*[f.name for f in EXTRACTED.fields]).alias(name))
    j = side(a, "p").join(side(b, "s"), ["scan_id", "field_name"], "full_outer")
    return j.select("scan_id", "field_name", choose(F.col("p"), F.col("s")).alias("f")).select(
        "scan_id", "field_name", "f.*")


def corroborated(f: Column) -> Column:
    return f["source"] == "ocr+vision"


def contested(f: Column) -> Column:
    return f["disagreement_note"].isNotNull()


def low_confidence(f: Column) -> Column:
    return ~corroborated(f) & F.coalesce(f["ocr_confidence"] < K.LOW_CONFIDENCE, F.lit(False))


def needs_manual_check(f: Column) -> Column:
    return contested(f) | low_confidence(f)


def trust_flags(fields: DataFrame) -> DataFrame:
    f = F.struct("source", "disagreement_note", "ocr_confidence")
    return fields.withColumns({
        "corroborated": corroborated(f), "contested": contested(f), "low_confidence": low_confidence(f),
        "needs_manual_check": needs_manual_check(f)})
