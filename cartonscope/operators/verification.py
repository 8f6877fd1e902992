"""Audited human verification of undecided results, as a batch state transition.

Audit rows are written before the new results; the results are always re-derivable from the original
results and the audit table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import text as X
from cartonscope.operators import rollups as R

KEY = ["scan_id", "rule_id"]


def first_per_rule(eligible: DataFrame) -> DataFrame:
    """The earliest request per (scan, rule): a mergeable minimum, so a rule that many people
    verify at once is reduced before the shuffle."""
    return eligible.groupBy(*KEY).agg(F.min(F.struct("ts", "request_id")).alias("w")).select(
        *KEY, F.col("w.request_id").alias("request_id"))


def classify_requests(requests: DataFrame, scans: DataFrame, results: DataFrame) -> DataFrame:
    """Adds ``code``: 403 not an admin, 404 unknown scan or rule, 409 not undecided (or already taken
    by an earlier request of the batch), 200 accepted."""
    known = scans.select(F.col("id").alias("scan_id"), F.lit(True).alias("scan_known"))
    current = results.select(*KEY, F.col("status").alias("current_status"))
    checked = requests.join(known, "scan_id", "left").join(current, KEY, "left").withColumn(
        "code", F.when(F.col("role") != "admin", 403).when(F.col("scan_known").isNull(), 404)
        .when(F.col("current_status").isNull(), 404)
        .when(F.col("current_status") != K.NEEDS_VERIFICATION, 409).otherwise(200))
    winners = first_per_rule(checked.filter("code = 200")).select("request_id", F.lit(True).alias("wins"))
    return (checked.join(winners, "request_id", "left")
            .withColumn("code", F.when((F.col("code") == 200) & F.col("wins").isNull(), 409)
                        .otherwise(F.col("code")))
            .drop("scan_known", "wins"))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.filter("code = 200").select(
        *KEY, "ts", "email", F.nullif(X.strip(F.coalesce("note", F.lit(""))), F.lit("")).alias("note"))


def iso_utc(ts: Column) -> Column:
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""),
                    F.lit("+00:00"))


def disclosure() -> Column:
    head = X.fill(K.VERIFIED_NOTE, who=F.col("v.email"), when=F.date_format("v.ts", "yyyy-MM-dd HH:mm"))
    return F.concat(head, F.when(F.col("v.note").isNotNull(), F.concat(F.lit(K.VERIFIER_NOTE), F.col("v.note")))
                    .otherwise(""))


def apply_verifications(results: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    """Results with accepted requests applied; every other row passes unchanged."""
    v = accepted_rows.select(*KEY, F.struct("ts", "email", "note").alias("v"))
    hit = F.col("v").isNotNull()
    new = {
        "status": F.when(hit, K.PASS).otherwise(F.col("status")),
        "original_status": F.when(hit, K.NEEDS_VERIFICATION).otherwise(F.col("original_status")),
        "verified_by": F.when(hit, F.col("v.email")).otherwise(F.col("verified_by")),
        "verified_at": F.when(hit, iso_utc(F.col("v.ts"))).otherwise(F.col("verified_at")),
        "verification_note": F.when(hit, F.col("v.note")).otherwise(F.col("verification_note")),
        "notes": F.when(hit, X.strip(F.concat(disclosure(), F.lit(" "), F.coalesce("notes", F.lit("")))))
        .otherwise(F.col("notes"))}
    return results.join(v, KEY, "left").withColumns(new).select(results.columns)


def touched(rows: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    return rows.join(accepted_rows.select("scan_id"), "scan_id", "left_semi")


def recompute_rollups(new_results: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    """Score and verdict of the scans that changed, from the same aggregate as a fresh scan."""
    return R.rollup(touched(new_results, accepted_rows))


def audit_rows(accepted_rows: DataFrame) -> DataFrame:
    return accepted_rows.select(
        *KEY, F.lit(K.NEEDS_VERIFICATION).alias("original_status"), F.lit(K.PASS).alias("new_status"),
        F.col("email").alias("verified_by"), "note", F.col("ts").alias("created_at"))


def untouched(results: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    return results.join(accepted_rows.select(*KEY), KEY, "left_anti")


def redraw_set(new_results: DataFrame, accepted_rows: DataFrame) -> DataFrame:
    return R.evidence_boxes(touched(new_results, accepted_rows))


def replay(results: DataFrame, audit: DataFrame) -> DataFrame:
    """Rebuilds verified results from the original ones and the audit table."""
    first = audit.groupBy(*KEY).agg(F.min_by(F.struct("verified_by", "note", "created_at"), "created_at").alias("a"))
    return apply_verifications(results, first.select(
        *KEY, F.col("a.created_at").alias("ts"), F.col("a.verified_by").alias("email"), F.col("a.note").alias("note")))
