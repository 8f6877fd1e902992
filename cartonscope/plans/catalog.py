"""Every operator bound to the derived tables: ``(spark, sf_dir) -> flat DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope import schemas as S
from cartonscope.functions import patterns as P
from cartonscope.functions import text as X
from cartonscope.operators import admission, dashboard, imaging
from cartonscope.operators import anchors as A
from cartonscope.operators import extraction as E
from cartonscope.operators import layout as L
from cartonscope.operators import merging as M
from cartonscope.operators import register as Q
from cartonscope.operators import rollups as R
from cartonscope.operators import rules as RU
from cartonscope.operators import verification as V
from cartonscope.plans import label_pipeline as PL
from cartonscope.plans import label_tables as T
from cartonscope.session import configure, rocks
from cartonscope.sources import readers, sinks
from cartonscope.sources.bucketed import all_ids
from cartonscope.sources.daily_table import DailyTable
from cartonscope.sources.results_table import ResultsTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2001-08-01 12:00:00"
LIMITER = {"window_seconds": 86_400, "limit": 2}


def query(key: str):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        return fn
    return add


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# ---- sources and sinks -----------------------------------------------------------------------

def both_readings(spark, d) -> DataFrame:
    return T.label_regions(spark, d).unionByName(T.label_regions(spark, d, "s"))


@query("src_1")
def src_1(spark, d):
    """Payloads as the register stores them, written and read back."""
    path = T.scratch(spark)
    sinks.raw_payloads(both_readings(spark, d)).write.parquet(path)
    return readers.read_regions(spark, path, "payload").select(
        "scan_id", "reader", "region_idx", "text", "x", "y", "width", "height", "confidence")


@query("src_2")
def src_2(spark, d):
    return readers.clean_words(T.label_words(spark, d)).drop("language", "reader")


@query("src_3")
def src_3(spark, d):
    """The dictionary, with the number of boxes each term occurs in exactly."""
    found = A.anchor_exact(T.label_regions(spark, d)).groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n"))
    return A.anchors(spark).join(found, ["grp", "term"], "left").select(
        "grp", "lang", "term", F.coalesce("n", F.lit(0)).alias("n_boxes"))


@query("src_4")
def src_4(spark, d):
    return readers.admit_uploads(T.uploads(spark, d)).select("upload_id", "extension", "reason")


@query("src_5")
def src_5(spark, d):
    return E.to_long(readers.parse_reader_answers(T.reader_answers(spark, d))).select(
        "scan_id", "field_name", "value", "found", "source")


@query("src_6")
def src_6(spark, d):
    root = T.scratch(spark)
    for name, df in (("scans", T.scans(spark, d)), ("products", T.products(spark, d)), ("users", T.users(spark, d)),
                     ("rule_verifications", V.audit_rows(V.accepted(_classified(spark, d))))):
        df.write.parquet(f"{root}/{name}")
    tables = readers.read_register(spark, root)
    audits = tables["rule_verifications"].groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_audits"))
    scans, users = tables["scans"], tables["users"]
    products = tables["products"].select(F.col("id").alias("product_id"), "brand")
    return (scans.join(audits, scans["id"] == audits["scan_id"], "left").join(products, "product_id", "left")
            .join(users.select(F.col("email").alias("inspector_email"), "role"), "inspector_email", "left")
            .select(scans["id"], "brand", "role", "overall_status", F.coalesce("n_audits", F.lit(0)).alias("n_audits"),
                    stamp("created_at")))


@query("snk_1")
def snk_1(spark, d):
    path = T.scratch(spark)
    sinks.write_scans(_register(spark, d), path)
    back = readers.read_table(spark, path, S.SCANS)
    boxes = readers.explode_payload(back.withColumnRenamed("id", "scan_id")).groupBy(F.col("scan_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_boxes"))
    # what is read of wide columns is taken before the join, which moves its rows
    rows = back.select("id", "product_id", "inspector_email", "overall_status", "compliance_score", "ruleset_version", "font_size_tier",
                       F.size("rule_results").alias("n_results"), F.get_json_object("declarations_json", "$.mrp_value.value").alias("mrp"),
                       F.col("scan_date").cast("string").alias("scan_date"))
    return rows.join(boxes, "id", "left").select(
        F.col("id").alias("scan_id"), "product_id", "inspector_email", "overall_status", "compliance_score", "ruleset_version",
        "font_size_tier", "n_results", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), "mrp", "scan_date")


def _register(spark, d) -> DataFrame:
    """Register rows with everything a scan record holds."""
    scans = T.scans(spark, d).withColumnRenamed("id", "scan_id")
    declared = _declared_table(spark, d, "p").join(scans.select("scan_id", "font_size_tier"), "scan_id")
    return sinks.scan_records(T.rule_results(spark, d), scans, declared, both_readings(spark, d))


def _stored_register(spark, d) -> DataFrame:
    return T.written(spark, d, "register", lambda: _register(spark, d)).select(*S.SCANS.names)


@query("snk_2_rows")
def snk_2_rows(spark, d):
    path = T.scratch(spark)
    sinks.write_report(sinks.report_rows(T.rule_results(spark, d)), path, "json")
    return spark.read.schema("scan_id bigint, rule_no int, rule string, requirement string, status string, "
                             "evidence_notes string").json(path)


@query("snk_2_summary")
def snk_2_summary(spark, d):
    return sinks.report_summary(T.rule_results(spark, d))


@query("snk_2_header")
def snk_2_header(spark, d):
    return sinks.report_header(T.scans(spark, d), T.products(spark, d), _declared_few(spark, d, "p"))


@query("snk_3")
def snk_3(spark, d):
    path = T.scratch(spark)
    audit = V.audit_rows(_accepted_stored(spark, d))
    for load in (0, 1, 1):  # the second load is repeated, as after a failure
        sinks.append_audit(audit, path, load)
    return spark.read.parquet(path).select("scan_id", "rule_id", "original_status", "new_status", "verified_by", "note",
                                           stamp("created_at"))


# ---- text ------------------------------------------------------------------------------------

def _per_line(key: str, expr: Callable[[Column], Column], every: bool = False):
    @query(key)
    def run(spark, d):
        out = T.text_lines(spark, d).select("src", "line_no", expr(F.col("line")).alias("result"))
        return out if every else out.filter("result IS NOT NULL")


def _changed(fn):
    return lambda c: F.when(fn(c) != c, fn(c))


_per_line("txt_1", _changed(X.normalize_digits))
_per_line("txt_2", _changed(X.fix_unit_noise))
_per_line("txt_3", lambda c: X.price_value(X.normalize_digits(c)))
_per_line("txt_4", lambda c: X.first_number(c))
_per_line("txt_5", lambda c: F.concat(X.quantity_of(c)["value"], F.lit("|"), X.quantity_of(c)["unit"]))
_per_line("txt_6", X.date_text)
_per_line("txt_7", X.phone_loose)
_per_line("txt_8", X.phone_strict)
_per_line("txt_9", lambda c: F.when(X.phone_loose(c).isNotNull(), X.is_reference_number(c, P.PHONE_LOOSE).cast("int")))
_per_line("txt_10", X.email)
_per_line("txt_11", X.dominant_script, every=True)
_per_line("txt_12", X.script_tag, every=True)
_per_line("txt_13", X.reread_route, every=True)
_per_line("txt_14", lambda c: X.unit_category(X.quantity_of(c)["unit"], F.lit("unknown")), every=True)
_per_line("txt_15", lambda c: X.values_agree(c, F.coalesce(X.price_value(c), F.upper(X.email(c)), F.lit("Net"))).cast("int"), every=True)
_per_line("txt_16", lambda c: F.nullif(F.array_join(X.misleading_terms(c), ","), F.lit("")))


def _merged_fields(spark, d) -> DataFrame:
    return E.to_long(_merged_few(spark, d))


@query("txt_17")
def txt_17(spark, d):
    return _merged_fields(spark, d).select("scan_id", "field_name", X.provenance_note(
        F.col("source"), F.col("disagreement_note")).alias("result"))


@query("txt_18")
def txt_18(spark, d):
    r = T.rule_results(spark, d)
    return r.select("scan_id", "rule_no", X.join_notes(F.col("notes"), F.lit(""), F.col("evidence.extracted_value"))
                    .alias("result"))


# ---- anchors ---------------------------------------------------------------------------------

@query("anc_1")
def anc_1(spark, d):
    return A.anchor_exact(T.label_regions(spark, d))


@query("anc_2")
def anc_2(spark, d):
    return A.anchor_fuzzy(T.label_regions(spark, d))


@query("anc_3")
def anc_3(spark, d):
    return A.anchor_stray(T.label_regions(spark, d))


@query("anc_4")
def anc_4(spark, d):
    return A.anchor_match(T.label_regions(spark, d)).drop("text")


@query("anc_5")
def anc_5(spark, d):
    return A.first_anchor(T.label_regions(spark, d))


@query("anc_6")
def anc_6(spark, d):
    r = T.label_regions(spark, d)
    return A.unanchored(r, A.anchor_match(r)).select("scan_id", "region_idx", "text")


@query("anc_7")
def anc_7(spark, d):
    r = T.label_regions(spark, d)
    return A.anchored(r, A.anchor_match(r)).select("scan_id", "region_idx", "text")


# ---- layout ----------------------------------------------------------------------------------

def _words(spark, d) -> DataFrame:
    return readers.clean_words(T.label_words(spark, d))


@query("lay_1")
def lay_1(spark, d):
    return L.cluster_lines(_words(spark, d)).select("scan_id", "word_idx", "line_no")


@query("lay_2")
def lay_2(spark, d):
    return L.merge_words(L.cluster_lines(_words(spark, d))).select(
        "scan_id", "region_idx", "text", "x", "y", "width", "height", "confidence")


def _row_parts(spark, d):
    r = T.label_regions(spark, d)
    names = list(E.ROW_FIELDS)
    anchors = E.row_anchors(E.first_boxes(r, names=names), names=names)
    return anchors, L.row_companions(anchors, r), r


@query("lay_3")
def lay_3(spark, d):
    return _row_parts(spark, d)[1].select("scan_id", "anchor_key", "region_idx")


@query("lay_4")
def lay_4(spark, d):
    anchors, companions, _ = _row_parts(spark, d)
    return L.row_text(anchors, L.row_summary(companions)).select("scan_id", "anchor_key", "row_text")


@query("lay_5")
def lay_5(spark, d):
    anchors, companions, _ = _row_parts(spark, d)
    return L.row_box(anchors, L.row_summary(companions)).filter("x IS NOT NULL")


@query("lay_6")
def lay_6(spark, d):
    r = T.label_regions(spark, d)
    names = list(E.ROW_FIELDS)
    return E.match_in_row(E.row_anchors(E.first_boxes(r, names=names), names=names), r).select(
        "scan_id", "anchor_key", "value", "region.text", "region.x", "region.y", "region.width", "region.height")


def _declared(spark, d) -> DataFrame:
    return E.extract_declarations(T.label_regions(spark, d))


@query("lay_7")
def lay_7(spark, d):
    return L.text_heights(T.label_regions(spark, d), _declared(spark, d))


@query("lay_8")
def lay_8(spark, d):
    return L.ref_height(L.text_heights(T.label_regions(spark, d), _declared(spark, d)))


@query("lay_9")
def lay_9(spark, d):
    return _ready(spark, d).select("scan_id", "calibration_available", F.round("px_per_mm", 6).alias("px_per_mm"),
                                   F.round("pdp_area_cm2", 6).alias("pdp_area_cm2"), "font_size_tier",
                                   F.round(F.col("mrp_height") / F.col("px_per_mm"), 6).alias("mrp_height_mm"))


# ---- extraction ------------------------------------------------------------------------------

FIELD_KEYS = {
    "fld_1": ["mrp_value"], "fld_2": ["mrp_inclusive_of_taxes_stated"],
    "fld_3": ["net_quantity_value", "net_quantity_unit"], "fld_4": ["mfg_month_year"],
    "fld_5": ["best_before_use_by"], "fld_6": ["manufacturer_name", "manufacturer_address"],
    "fld_7": ["country_of_origin"], "fld_8": ["common_generic_name"],
    "fld_9": [f"consumer_care_{p}" for p in ("name", "address", "phone", "email")],
    "fld_11": ["unit_sale_price"]}


def _flat_fields(df: DataFrame) -> DataFrame:
    return df.select("scan_id", "field_name", "value", "raw_text_span", "bounding_box.x", "bounding_box.y",
                     "bounding_box.width", "bounding_box.height", "ocr_confidence", "language")


def _field_query(key: str, names: list[str]):
    @query(key)
    def run(spark, d):
        return _flat_fields(E.field_rows(_declared(spark, d), *names))


for _key, _names in FIELD_KEYS.items():
    _field_query(_key, _names)


@query("fld_0")
def fld_0(spark, d):
    return E.to_long(_declared(spark, d)).select("scan_id", "field_name", "found", "value", "source")


@query("fld_10")
def fld_10(spark, d):
    """Contacts of labels without a consumer-care heading."""
    r = T.label_regions(spark, d)
    with_heading = A.first_anchor(r).filter("grp = 'consumer_care'").select("scan_id")
    fields = E.field_rows(_declared(spark, d), "consumer_care_phone", "consumer_care_email")
    return _flat_fields(fields.join(with_heading, "scan_id", "left_anti"))


@query("fld_12")
def fld_12(spark, d):
    wide = E.assemble_declarations(E.to_long(_declared(spark, d)))
    return wide.select("scan_id", *[F.col(f"{f}.value").alias(f) for f in K.DECLARATION_FIELDS])


@query("fld_13")
def fld_13(spark, d):
    return E.with_unread_scans(T.label_meta(spark, d), _declared(spark, d)).select(
        "scan_id", "n_regions", "image_quality_warning")


@query("fld_14")
def fld_14(spark, d):
    return _ready(spark, d).select("scan_id", "commodity_category", "is_imported", "is_perishable_category",
                                   "is_medical_device")


# ---- reconciliation --------------------------------------------------------------------------

def _declared_by(spark, d, reader: str) -> DataFrame:
    if reader == "v":
        return readers.parse_reader_answers(T.reader_answers(spark, d))
    found = E.extract_declarations(T.label_regions(spark, d, reader))
    return E.with_unread_scans(T.label_meta(spark, d), found) if reader == "p" else found


def _declared_stored(spark, d, reader: str) -> tuple[DataFrame, str]:
    return T.bucketed(spark, d, f"declared_{reader}", lambda: _declared_by(spark, d, reader))


def _declared_table(spark, d, reader: str) -> DataFrame:
    """One reader's declarations as a stored table, bucketed by scan: what reconciliation reads."""
    return _declared_stored(spark, d, reader)[0]


def _declared_ids(spark, d) -> DataFrame:
    """Every scan that any reader has declarations of."""
    return T.bucketed(spark, d, "declared_ids", lambda: all_ids(spark, *[_declared_stored(spark, d, r)[1] for r in ("p", "s", "v")]))[0]


def _catalogue(spark, d) -> DataFrame:
    return T.bucketed(spark, d, "catalogue", lambda: T.label_meta(spark, d))[0]


def _passes(spark, d) -> DataFrame:
    primary = M.on_ids(_declared_ids(spark, d), _declared_table(spark, d, "p"))
    return M.merge_passes(primary, _declared_table(spark, d, "s"), covered=True)


def _declared_few(spark, d, reader: str) -> DataFrame:
    """What :func:`_declared_table` gives, derived where it is not stored: only what a query reads of it is made. Answers are dealt by scan
    before they are parsed, since a body is shorter than its fifteen fields."""
    if T.is_bucketed(spark, d, f"declared_{reader}"):
        return _declared_table(spark, d, reader)
    if reader == "v":
        return readers.parse_reader_answers(T.reader_answers(spark, d).repartition("scan_id"))
    return _declared_by(spark, d, reader)


def _ids_few(spark, d) -> DataFrame:
    """What :func:`_declared_ids` gives, from what readers read: catalogue and second boxes give each of their scans a declaration,
    answers those that can be used."""
    if T.is_bucketed(spark, d, "declared_ids"):
        return _declared_ids(spark, d)
    boxed = T.label_regions(spark, d, "s").select("scan_id").filter("scan_id IS NOT NULL")
    usable = readers.usable_answers(T.reader_answers(spark, d)).select("scan_id")
    return T.label_meta(spark, d).select("scan_id").unionByName(boxed).unionByName(usable).distinct()


def _passes_few(spark, d) -> DataFrame:
    """What :func:`_passes` gives, derived where it is not stored: extraction leaves its rows dealt by scan and outer joins to one side
    keep them so, so that no declaration is moved."""
    return M.merge_passes(M.on_ids(_ids_few(spark, d), _declared_few(spark, d, "p")), _declared_few(spark, d, "s"), covered=True)


def _merged_few(spark, d) -> DataFrame:
    """What :func:`_merged` gives, derived where it is not stored."""
    return M.merge_vision(_passes_few(spark, d), _declared_few(spark, d, "v"), covered=True)


def _merged(spark, d) -> DataFrame:
    return M.merge_vision(_passes(spark, d), _declared_table(spark, d, "v"), covered=True)


@query("mrg_1")
def mrg_1(spark, d):
    """Scans that a pass has read, field by field."""
    p, s = _declared_table(spark, d, "p"), _declared_table(spark, d, "s")
    read = M.on_ids(_declared_ids(spark, d), p.withColumn("in_p", F.lit(True))).join(
        s.select("scan_id", F.lit(True).alias("in_s")), "scan_id", "left").filter("in_p OR in_s").select(p.columns)
    return E.to_long(M.merge_passes(read, s, covered=True)).select("scan_id", "field_name", "value", "ocr_confidence", "found")


@query("mrg_2")
def mrg_2(spark, d):
    return _passes_few(spark, d).select("scan_id", F.col("net_quantity_unit.value").alias("unit"), "commodity_category")


@query("mrg_3")
def mrg_3(spark, d):
    return _merged_fields(spark, d).select("scan_id", "field_name", "value", "raw_text_span", "source",
                                           "disagreement_note", "found")


@query("mrg_4")
def mrg_4(spark, d):
    return _merged_few(spark, d).select("scan_id", "is_imported", "commodity_category")


@query("mrg_5")
def mrg_5(spark, d):
    return M.trust_flags(_merged_fields(spark, d)).select(
        "scan_id", "field_name", "corroborated", "contested", "low_confidence", "needs_manual_check")


# ---- rules -----------------------------------------------------------------------------------

def _ready(spark, d) -> DataFrame:
    return PL.declarations_of(T.label_regions(spark, d), T.label_meta(spark, d))


def _full(spark, d) -> DataFrame:
    return L.calibrate(E.apply_overrides(_merged(spark, d), _catalogue(spark, d)))


def _flat_results(results: DataFrame) -> DataFrame:
    return results.select("scan_id", "rule_id", "rule_reference", "status", "notes",
                          F.col("evidence.extracted_value").alias("value"), F.col("evidence.source").alias("source"),
                          F.col("evidence.bounding_box.x").alias("box_x"),
                          F.col("evidence.bounding_box.height").alias("box_h"))


def _rule_query(rule_id: str):
    @query(rule_id.lower().replace("-", "_"))
    def run(spark, d):
        return _flat_results(PL.results_of(_ready(spark, d), T.label_regions(spark, d), RU.default_registry(rule_id)))


for _rule in K.RULES:
    _rule_query(_rule)


@query("rul_0")
def rul_0(spark, d):
    """Found-or-fail on every declaration of every label."""
    return RU.presence_results(_merged_fields(spark, d))


@query("r7_t")
def r7_t(spark, d):
    area = F.col("pdp_area_cm2")
    return L.calibrate(T.label_meta(spark, d)).filter("calibration_available").select(
        "scan_id", F.round(area, 6).alias("area"), RU.min_height_mm(area).alias("min_mm"))


def _full_results(spark, d) -> DataFrame:
    return PL.results_of(_full(spark, d), T.label_regions(spark, d))


@query("rul_all")
def rul_all(spark, d):
    return _flat_results(_full_results(spark, d))


# ---- roll-ups --------------------------------------------------------------------------------

@query("agg_1")
def agg_1(spark, d):
    return R.status_counts(T.rule_results(spark, d))


@query("agg_2")
def agg_2(spark, d):
    return R.compliance_score(T.rule_results(spark, d))


@query("agg_3")
def agg_3(spark, d):
    return R.overall_status(T.rule_results(spark, d))


@query("agg_4")
def agg_4(spark, d):
    return R.evidence_boxes(T.rule_results(spark, d))


@query("agg_5")
def agg_5(spark, d):
    return R.clip_boxes(R.evidence_boxes(T.rule_results(spark, d)), T.label_meta(spark, d)).select(
        "scan_id", "label", "x1", "y1", "x2", "y2")


@query("agg_6")
def agg_6(spark, d):
    return R.total_scans(T.scans(spark, d))


@query("agg_7")
def agg_7(spark, d):
    return R.scans_by_status(T.scans(spark, d))


@query("agg_8")
def agg_8(spark, d):
    return R.daily_volume(T.scans(spark, d), NOW).select(F.col("day").cast("string").alias("day"), "n")


@query("agg_9")
def agg_9(spark, d):
    return R.daily_series(R.daily_volume(T.scans(spark, d), NOW), NOW).select(
        F.col("day").cast("string").alias("day"), "n")


@query("agg_10")
def agg_10(spark, d):
    return R.clearance(T.scans(spark, d))


@query("agg_11")
def agg_11(spark, d):
    return R.shares_and_peak(T.scans(spark, d), NOW)


def _expected(spark, d) -> DataFrame:
    return T.label_meta(spark, d).select("scan_id", "case_no").join(
        F.broadcast(T.expected_verdicts(spark)), "case_no").drop("case_no")


@query("agg_12")
def agg_12(spark, d):
    results = PL.results_of(_ready(spark, d), T.label_regions(spark, d))
    return R.golden_diff(results, _expected(spark, d)).select("scan_id", "rule_id", "expected", "actual", "outcome")


@query("agg_12_summary")
def agg_12_summary(spark, d):
    results = PL.results_of(_ready(spark, d), T.label_regions(spark, d))
    return R.golden_summary(R.golden_diff(results, _expected(spark, d)))


@query("agg_13")
def agg_13(spark, d):
    return R.score_bands(T.scans(spark, d))


def _days(spark, d) -> DailyTable:
    """Counts by day after a load a year; one load is repeated, and the first ones are summed up before the last come."""
    scans, days = T.scans(spark, d), DailyTable(spark, T.scratch(spark))
    span = scans.agg(F.min(F.year("created_at")).alias("first"), F.max(F.year("created_at")).alias("last")).first()
    if span["first"] is None:
        return days
    for year in range(span["first"], span["last"] + 1):
        days.add_scans(scans.filter(F.year("created_at") == year), year)
        if year == span["first"] + 3:
            days.compact()
            days.add_scans(scans.filter(F.year("created_at") == year), year)
    return days


@query("agg_days")
def agg_days(spark, d):
    return _days(spark, d).read().select(F.col("day").cast("string").alias("day"), "overall_status", "band", "n")


@query("agg_dashboard")
def agg_dashboard(spark, d):
    """The dashboard's payload from counts by day, a row an entry."""
    whole = dashboard.payload(_days(spark, d).read(), T.scans(spark, d), T.products(spark, d), NOW)
    def entries(part, items, name, n):
        return F.transform(items, lambda e: F.struct(F.lit(part).alias("part"), name(e).cast("string").alias("name"), n(e).cast("bigint").alias("n")))
    return whole.select(F.inline(F.concat(
        F.array(F.struct(F.lit("total").alias("part"), F.lit("scans").alias("name"), F.col("total_scans").cast("bigint").alias("n"))),
        entries("status", F.col("by_status"), lambda e: e["overall_status"], lambda e: e["n"]),
        entries("failure", F.col("recent_failures"), lambda e: e["product_name"], lambda e: e["id"]),
        entries("trend", F.col("trend"), lambda e: e["day"], lambda e: e["n"]))))


# ---- register --------------------------------------------------------------------------------

@query("qry_1")
def qry_1(spark, d):
    return Q.with_product(T.scans(spark, d), T.products(spark, d)).select("id", "product_name", "overall_status")


@query("qry_2")
def qry_2(spark, d):
    return Q.search_name(Q.with_product(T.scans(spark, d), T.products(spark, d)), "B_lT").select("id", "product_name")


@query("qry_3")
def qry_3(spark, d):
    return Q.filter_status(T.scans(spark, d), K.FAIL).select("id", "overall_status")


@query("qry_4")
def qry_4(spark, d):
    return Q.filter_dates(T.scans(spark, d), "1997-03-01", "1997-06-30").select("id", stamp("created_at"))


@query("qry_5")
def qry_5(spark, d):
    return Q.list_scans(_stored_register(spark, d), T.products(spark, d), q="ring", status=K.NEEDS_VERIFICATION,
                        date_from="1996-01-01", date_to="1999-12-31").select(
        "id", "product_name", "overall_status", "compliance_score", stamp("created_at"), "inspector_email")


@query("qry_6")
def qry_6(spark, d):
    """One scan in full: a row for each of its results."""
    scan = Q.scan_detail(_stored_register(spark, d), T.products(spark, d), 777)
    return scan.select("id", "product_name", "overall_status", "compliance_score", "font_size_tier", stamp("created_at"),
                       F.get_json_object("declarations_json", "$.mrp_value.value").alias("mrp"), F.inline("rule_results")).select(
        "id", "product_name", "overall_status", "compliance_score", "font_size_tier", "created_at", "mrp", "rule_no", "rule_id",
        "status", F.col("evidence.extracted_value").alias("value"), "notes")


@query("qry_7")
def qry_7(spark, d):
    return Q.recent_noncompliant(T.scans(spark, d), T.products(spark, d)).select(
        "id", "product_name", stamp("created_at"), "compliance_score")


@query("qry_8")
def qry_8(spark, d):
    return Q.by_severity(T.rule_results(spark, d)).select("scan_id", "rule_id", "status", "display_pos")


# ---- verification ----------------------------------------------------------------------------

def _results_table(spark, d) -> ResultsTable:
    """The stored results, written once per session; no query changes them."""
    made = T.written_as(spark, d, "results_table", lambda path: ResultsTable(spark, path).create(T.rule_results(spark, d)))
    return ResultsTable(spark, made)


def _classified(spark, d) -> DataFrame:
    requests = T.verify_requests(spark, d)
    return V.classify_requests(requests, T.scans(spark, d), _results_table(spark, d).near(requests))


def _accepted(spark, d) -> DataFrame:
    return V.accepted(_classified(spark, d))


def _accepted_stored(spark, d) -> DataFrame:
    return T.written(spark, d, "accepted", lambda: _accepted(spark, d))


def _changed(spark, d) -> DataFrame:
    """The load of changes that the accepted requests make, written and read back."""
    path = T.scratch(spark)
    _results_table(spark, d).write_changes(_accepted_stored(spark, d), path, 1)
    return spark.read.parquet(path)


VERIFIED = ("scan_id", "rule_id", "status", "original_status", "verified_by", "verified_at", "verification_note", "notes")


@query("ver_1")
def ver_1(spark, d):
    return _classified(spark, d).select("request_id", "scan_id", "rule_id", "code")


@query("ver_2")
def ver_2(spark, d):
    admins = T.verify_requests(spark, d).filter("role = 'admin'")
    return V.first_per_rule(admins)


@query("ver_3")
def ver_3(spark, d):
    """Stored rows with the load of changes put over them."""
    base, changed = _results_table(spark, d), _changed(spark, d)
    return base.over(changed).select(*VERIFIED)


@query("ver_3_compacted")
def ver_3_compacted(spark, d):
    """The same from a table that was created, changed in two loads and compacted."""
    table = ResultsTable(spark, T.scratch(spark)).create(T.rule_results(spark, d))
    accepted = _accepted_stored(spark, d)
    for load in range(2):
        table.apply(accepted.filter(F.pmod(F.xxhash64(*V.KEY), F.lit(2)) == load), load)
    table.compact()
    return table.read().select(*VERIFIED)


@query("ver_4")
def ver_4(spark, d):
    acc = _accepted_stored(spark, d)
    near = _results_table(spark, d).over(_changed(spark, d), _results_table(spark, d).buckets_of(acc))
    return V.recompute_rollups(near, acc).select("scan_id", "overall_status", "compliance_score")


@query("ver_5")
def ver_5(spark, d):
    return V.audit_rows(_accepted(spark, d)).withColumn("created_at", stamp("created_at"))


@query("ver_6")
def ver_6(spark, d):
    return V.untouched(_results_table(spark, d).read(), _accepted_stored(spark, d)).select("scan_id", "rule_id", "status")


@query("ver_6_redraw")
def ver_6_redraw(spark, d):
    acc = _accepted_stored(spark, d)
    near = _results_table(spark, d).over(_changed(spark, d), _results_table(spark, d).buckets_of(acc))
    return V.redraw_set(near, acc)


# ---- photo planning --------------------------------------------------------------------------

@query("img_1")
def img_1(spark, d):
    return imaging.quality_floor(T.image_metrics(spark, d)).select("image_id", "ok", "reason", "shorter_side_px")


@query("img_2")
def img_2(spark, d):
    return imaging.resolution_cap(T.image_metrics(spark, d)).select(
        "image_id", F.round("cap_factor", 6).alias("cap_factor"), "capped_width", "capped_height")


@query("img_3")
def img_3(spark, d):
    return imaging.skew_consensus(T.line_segments(spark, d)).select(
        "image_id", "n_lines", "n_agree", F.round("angle", 6).alias("angle"), F.round("rotation", 6).alias("rotation"))


@query("img_4")
def img_4(spark, d):
    return imaging.upscale_plan(T.image_metrics(spark, d), T.component_heights(spark, d)).select(
        "image_id", "median_height", F.round("upscale_factor", 6).alias("upscale_factor"))


@query("img_5")
def img_5(spark, d):
    plan = imaging.image_plan(T.image_metrics(spark, d), T.line_segments(spark, d), T.component_heights(spark, d))
    return plan.select("image_id", F.array_join("stages", " > ").alias("stages"))


# ---- streams and extension points ------------------------------------------------------------

@query("str_1")
def str_1(spark, d):
    return admission.rate_limit(T.arrivals(spark, d), **LIMITER)


@query("str_1_default")
def str_1_default(spark, d):
    """With the default window and limit."""
    return admission.rate_limit(T.arrivals(spark, d))


@query("str_1_stream")
def str_1_stream(spark, d):
    """The same arrivals as a stream that stops and goes on: a micro-batch for each quarter of the time, over one carried state."""
    from cartonscope.streaming.limiter import rate_limit_stream
    root = T.scratch(spark)
    rows = T.arrivals(spark, d).filter("arrival_id is not null")
    span = rows.agg(F.unix_micros(F.min("ts")).alias("low"), F.unix_micros(F.max("ts")).alias("high")).first()
    low, high = (span.low or 0), (span.high or 0)
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("ts") - low) * 4 / max(1, high - low)))
    for k in range(4):
        rows.filter(quarter == k).write.mode("append").parquet(f"{root}/in")
        live = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        with rocks(spark):
            handle = (rate_limit_stream(live, **LIMITER).writeStream.format("parquet").option("path", f"{root}/out")
                      .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
        handle.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("str_2")
def str_2(spark, d):
    from cartonscope.streaming import scans as SS
    root = T.scratch(spark)
    # two micro-batches whose days overlap: nothing may be lost as late
    SS.scan_records(spark, d).repartition(2, F.xxhash64("scan_id")).write.parquet(f"{root}/in")
    SS.run_available(spark, f"{root}/in", f"{root}/out", f"{root}/state", files_per_batch=1)
    return SS.read_records(spark, f"{root}/out").select(F.col("id").alias("scan_id"), "overall_status", "compliance_score", "font_size_tier")


def shelf_rule(row) -> RU.Cases:
    """A user's own rule: the label must carry a phone number unless the goods are liquid."""
    phone = row("consumer_care_phone")
    return [RU.Case(F.coalesce(row("commodity_category"), F.lit("")) == "liquid", K.NOT_APPLICABLE),
            RU.Case(phone["found"], K.PASS, "", RU.field_evidence(phone)), RU.Case(None, K.FAIL, "No phone.")]


@query("ext_1")
def ext_1(spark, d):
    registry = RU.default_registry().register("X-1", shelf_rule, "House rule 1", "A phone number is printed.")
    return R.rollup(PL.results_of(_ready(spark, d), T.label_regions(spark, d), registry))


EXTRA_TERMS = [("manufacturer", "eng", "imported by"), ("mrp", "eng", "batch no"), ("batch", "eng", "lic. no"),
               ("net_qty", "hin", "कुल वजन")]


@query("ext_2")
def ext_2(spark, d):
    extra = spark.createDataFrame(EXTRA_TERMS, "grp string, lang string, term string")
    return A.first_of_each(A.match_table(T.label_regions(spark, d), A.anchors_with(A.anchors(spark), extra)))


def store_inputs(spark: SparkSession, d: str) -> None:
    """Writes every derived table that queries read as stored."""
    configure(spark)
    T.label_base(spark, d), T.label_meta(spark, d), T.reader_answers(spark, d)
    both_readings(spark, d), _stored_register(spark, d)
    for reader in ("p", "s", "v"):
        _declared_table(spark, d, reader)
    _declared_ids(spark, d), _catalogue(spark, d), _results_table(spark, d)


@query("flagship")
def flagship(spark, d):
    """Share of labels passing, failing or undecided on the price rule."""
    return PL.price_rule_shares(T.label_regions(spark, d), T.label_meta(spark, d))

