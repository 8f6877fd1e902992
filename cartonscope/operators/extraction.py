"""Field extraction: text boxes of one reader -> fifteen declarations per scan.

One mergeable aggregate per scan (first matching box per group, tallest unmatched box, first phone,
e-mail and free-standing quantity) replaces ordered passes: it combines on the map side, so an
overlong scan costs no more than its share. Only labels whose value is not on the anchor's own box
go on to the label/value row search.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import patterns as P
from cartonscope.functions import text as X
from cartonscope.operators import anchors as A
from cartonscope.operators import layout as L
from cartonscope.schemas import EXTRACTED

ROW_FIELDS = {"mrp": "mrp", "net_qty": "net_qty", "mfg_date": "mfg_date", "best_before": "best_before"}
REGION_COLUMNS = ["region_idx", "text", "x", "y", "width", "height", "confidence", "language"]


def _region() -> Column:
    return F.struct(*REGION_COLUMNS)


def not_found() -> Column:
    return F.expr(NOT_FOUND_SQL)


def _norm(text: Column) -> Column:
    return X.normalize_digits(text)


def price_or_number(text: Column) -> Column:
    return F.coalesce(X.price_value(_norm(text)), X.first_number(_norm(text)))


def price_only(text: Column) -> Column:
    return X.price_value(_norm(text))


def date_in(text: Column) -> Column:
    return X.date_text(_norm(text))


def plain_phone(text: Column, shape: str) -> Column:
    """First phone-shaped hit, unless it is a licence or batch number (then none is tried again)."""
    hit = X.first_match(text, shape, 0)
    return F.when(hit.isNotNull() & ~X.is_reference_number(text, shape), hit)


EXTRA_BOXES = ["name", "any_qty", "phone", "email", "tallest"]
#: Tests of a box that one number holds.
FLAG_BITS = 60


def box_names(dictionary: A.Dictionary | None = None) -> list[str]:
    return [g for g, terms in (dictionary or A.compile_dictionary()).items() if terms] + EXTRA_BOXES


def first_boxes(regions: DataFrame, dictionary: A.Dictionary | None = None, names: list[str] | None = None) -> DataFrame:
    """One row per scan: ``boxes`` holds the first box of every group, the tallest unmatched box,
    the first boxes with a quantity, phone and e-mail, and the greatest height; ``n_regions`` counts.
    names: those of :func:`box_names` that the caller reads, all when left out.

    The boxes stay in one array column on purpose, and it asks for the count: every reader of this aggregate
    then needs the same columns, so the row search and the field builders share one shuffle of it.
    What a box is the first of is kept as bits of a number, since the rows are sorted by scan before they are aggregated.
    """
    d, names = dictionary or A.compile_dictionary(), names or box_names(dictionary)
    groups = [g for g, terms in d.items() if terms and (g in names or "name" in names)]
    # the explicit null test is what the row search's join would infer; stated here, both readers
    # of this aggregate keep the same plan below it
    flagged = A.with_hits(regions.filter("scan_id IS NOT NULL"), {g: d[g] for g in groups})
    text = F.col("text")
    tests = {**{g: F.col(f"hit_{g}") for g in groups},
             "any_qty": X.fix_unit_noise(X.normalize_digits(text)).rlike(P.QUANTITY),
             "phone": text.rlike(P.PHONE_STRICT) & ~X.is_reference_number(text, P.PHONE_STRICT),
             "email": text.contains("@") & text.rlike(P.EMAIL)}
    tested = [n for n in tests if n in groups or n in names]
    words = [tested[i:i + FLAG_BITS] for i in range(0, len(tested), FLAG_BITS)]
    bits = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(tests[n], F.lit(1 << i)).otherwise(0).cast("bigint") for i, n in enumerate(word)])
            for word in words]
    prepared = flagged.select("scan_id", _region().alias("region"), *[b.alias(f"bits_{w}") for w, b in enumerate(bits)])

    def any_of(wanted: list[str]) -> Column:
        masks = [sum(1 << i for i, n in enumerate(word) if n in wanted) for word in words]
        return reduce(lambda a, b: a | b, [F.col(f"bits_{w}").bitwiseAND(F.lit(m).cast("bigint")) != 0 for w, m in enumerate(masks) if m])

    idx, height = F.col("region.region_idx"), F.col("region.height")

    def box_of(name: str) -> Column:
        if name == "tallest":  # its height alone is read
            tallest = F.when(F.count_if(height.isNull()) == 0, F.max(height))
            return F.struct(*[(tallest if f.name == "height" else F.lit(None)).cast(f.dataType).alias(f.name)
                              for f in prepared.schema["region"].dataType.fields])
        if name == "name":
            return F.min_by("region", F.when(F.col("region.text").isNotNull() & ~any_of(groups),
                                             F.struct((-height).alias("h"), idx.alias("i"))))
        return F.min_by("region", F.when(any_of([name]), idx))

    return prepared.groupBy("scan_id").agg(
        F.when(F.count(F.lit(1)) > 0, F.array(*[box_of(n) for n in names])).alias("boxes"), F.count(F.lit(1)).alias("n_regions"))


def at(name: str, dictionary: A.Dictionary | None = None, names: list[str] | None = None) -> Column:
    return F.element_at("boxes", (names or box_names(dictionary)).index(name) + 1)


def unpacked(firsts: DataFrame, dictionary: A.Dictionary | None = None) -> DataFrame:
    """``at_<name>`` columns in place of the array."""
    return firsts.withColumns({f"at_{n}": at(n, dictionary) for n in box_names(dictionary)}).drop("boxes")


_OWN_MATCH = {"mrp": price_or_number, "net_qty": lambda t: X.quantity_of(t)["value"],
              "mfg_date": date_in, "best_before": date_in}

def row_anchors(firsts: DataFrame, dictionary: A.Dictionary | None = None, names: list[str] | None = None) -> DataFrame:
    """Anchors whose own box carries no value: at most four per scan, none where a scan has no
    other box. names: what :func:`first_boxes` was asked for."""
    def first(g: str) -> Column:
        return at(g, dictionary, names)
    options = F.array_compact(F.array(*[
        F.when(first(g).isNotNull() & own(first(g)["text"]).isNull(), F.struct(F.lit(g).alias("anchor_key"), first(g).alias("a")))
        for g, own in _OWN_MATCH.items()]))
    return firsts.filter("n_regions > 1").select("scan_id", F.inline(options)).select(
        "scan_id", "anchor_key", F.col("a.region_idx").alias("a_idx"),
        *[F.col(f"a.{c}").alias(f"a_{c}") for c in ("text", "x", "y", "width", "height", "confidence", "language")])


def match_in_row(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """(scan_id, anchor_key, value, region): the value printed on each anchor's row.

    The nearest companion that matches on its own wins; otherwise label and companions are read as
    one text, and the evidence is the companions without the label.
    """
    companions = L.row_companions(anchors, regions)
    def read_for_anchor(text: Column) -> Column:
        key = F.col("anchor_key")
        return (F.when(key == "mrp", price_only(text)).when(key == "net_qty", X.quantity_of(text)["value"])
                .otherwise(date_in(text)))
    own = read_for_anchor(F.col("text"))
    rows = L.row_summary(companions, ("near", own))
    rows = rows.withColumn("whole_value", read_for_anchor(F.concat_ws(" ", "anchor_text", "companion_text")))
    whole_value = F.col("whole_value")
    # a quantity found only across boxes must also be readable without the label
    value = F.when(F.col("anchor_key") == "net_qty",
                   F.when(whole_value.isNotNull(), X.quantity_of(F.col("companion_text"))["value"])
                   ).otherwise(whole_value)
    near = F.col("near")
    region = F.when(near.isNotNull(), F.struct(
        near["text"].alias("text"), near["box"]["x"].alias("x"), near["box"]["y"].alias("y"),
        near["box"]["width"].alias("width"), near["box"]["height"].alias("height"),
        near["confidence"].alias("confidence"), near["language"].alias("language"))).otherwise(F.struct(
            F.col("companion_text").alias("text"), F.col("c_x").alias("x"), F.col("c_y").alias("y"),
            (F.col("c_right") - F.col("c_x")).alias("width"), (F.col("c_bottom") - F.col("c_y")).alias("height"),
            F.col("c_confidence").alias("confidence"), F.col("c_language").alias("language")))
    return (rows.select("scan_id", "anchor_key", F.when(near.isNotNull(), near["match"]).otherwise(value)
                        .alias("value"), region.alias("region"))
            .filter("value IS NOT NULL"))


def with_row_matches(firsts: DataFrame, regions: DataFrame, dictionary: A.Dictionary | None = None) -> DataFrame:
    """Adds ``row_<group>`` = struct(value, region), NULL where no row value was needed or found."""
    found = match_in_row(row_anchors(firsts, dictionary), regions)
    wide = found.groupBy("scan_id").agg(*[
        F.min_by(F.struct("value", "region"), F.when(F.col("anchor_key") == g, F.lit(1))).alias(f"row_{g}")
        for g in ROW_FIELDS])
    return unpacked(firsts, dictionary).join(wide, "scan_id", "left")


# ---- declarations, built in three steps so that no expression is repeated ---------------------
# step 1 reads the value off each first box, step 2 picks box and value, step 3 wraps them

REGION_PARTS = ("text", "x", "y", "width", "height", "confidence", "language")


def _plain(box: str) -> str:
    """SQL: a box without its index, NULL when there is none."""
    parts = ", ".join(f"'{p}', {box}.{p}" for p in REGION_PARTS)
    return f"IF({box} IS NULL, NULL, named_struct({parts}))"


def field_sql(region: str, value: str) -> str:
    """SQL: the provenance struct of a named box and value."""
    return (f"IF({region} IS NOT NULL AND {value} IS NOT NULL, named_struct('value', {value}, 'raw_text_span', {region}.text, "
            f"'bounding_box', named_struct('x', {region}.x, 'y', {region}.y, 'width', {region}.width, 'height', {region}.height), "
            f"'ocr_confidence', {region}.confidence, 'language', {region}.language, 'found', true, 'source', 'ocr', "
            f"'disagreement_note', CAST(NULL AS STRING)), {NOT_FOUND_SQL})")


NOT_FOUND_SQL = ("named_struct('value', CAST(NULL AS STRING), 'raw_text_span', CAST(NULL AS STRING), 'bounding_box', "
                 "CAST(NULL AS STRUCT<x: INT, y: INT, width: INT, height: INT>), 'ocr_confidence', CAST(NULL AS DOUBLE), "
                 "'language', CAST(NULL AS STRING), 'found', false, 'source', 'ocr', 'disagreement_note', CAST(NULL AS STRING))")


def read_values(rows: DataFrame) -> DataFrame:
    def text(name):
        return F.col(f"at_{name}.text")
    return rows.withColumns({
        "own_mrp": price_or_number(text("mrp")), "own_mfg_date": date_in(text("mfg_date")),
        "own_best_before": date_in(text("best_before")), "own_unit_price": price_or_number(text("unit_sale_price")),
        "own_has_qty": X.quantity_of(text("net_qty")).isNotNull(), "yes": F.lit("yes"),
        **{f"all_{n}": X.strip(text(n)) for n in ("best_before", "manufacturer", "country_of_origin", "name", "consumer_care")},
        "care_phone": plain_phone(text("consumer_care"), P.PHONE_LOOSE), "care_email": X.email(text("consumer_care")),
        "loose_phone": X.phone_strict(text("phone")), "loose_email": X.email(text("email"))})


def pick_boxes(read: DataFrame) -> DataFrame:
    picked = {
        "box_mrp": f"IF(own_mrp IS NOT NULL, {_plain('at_mrp')}, row_mrp.region)",
        "val_mrp": "coalesce(own_mrp, row_mrp.value)",
        "box_qty": f"CASE WHEN at_net_qty IS NULL THEN {_plain('at_any_qty')} WHEN own_has_qty THEN {_plain('at_net_qty')} "
                   "ELSE row_net_qty.region END",
        "box_mfg": f"IF(own_mfg_date IS NOT NULL, {_plain('at_mfg_date')}, row_mfg_date.region)",
        "val_mfg": "coalesce(own_mfg_date, row_mfg_date.value)",
        "box_bb": f"IF(own_best_before IS NULL AND row_best_before IS NOT NULL, row_best_before.region, {_plain('at_best_before')})",
        "val_bb": "coalesce(own_best_before, row_best_before.value, all_best_before)",
        "box_phone": f"IF(at_consumer_care IS NOT NULL, {_plain('at_consumer_care')}, {_plain('at_phone')})",
        "val_phone": "IF(at_consumer_care IS NOT NULL, care_phone, loose_phone)",
        "box_email": f"IF(at_consumer_care IS NOT NULL, {_plain('at_consumer_care')}, {_plain('at_email')})",
        "val_email": "IF(at_consumer_care IS NOT NULL, care_email, loose_email)"}
    boxes = read.withColumns({n: F.expr(e) for n, e in picked.items()})
    q = X.quantity_of(F.col("box_qty.text"))
    return boxes.withColumn("qty", q).withColumns({"qty_value": F.col("qty.value"), "qty_unit": F.col("qty.unit")})


# declaration -> (box column, value column)
FIELD_SOURCES = {
    "manufacturer_name": ("at_manufacturer", "all_manufacturer"),
    "manufacturer_address": ("at_manufacturer", "all_manufacturer"),
    "country_of_origin": ("at_country_of_origin", "all_country_of_origin"),
    "common_generic_name": ("at_name", "all_name"),
    "net_quantity_value": ("box_qty", "qty_value"), "net_quantity_unit": ("box_qty", "qty_unit"),
    "mfg_month_year": ("box_mfg", "val_mfg"), "best_before_use_by": ("box_bb", "val_bb"),
    "mrp_value": ("box_mrp", "val_mrp"), "mrp_inclusive_of_taxes_stated": ("at_tax_inclusive", "yes"),
    "consumer_care_name": ("at_consumer_care", "all_consumer_care"),
    "consumer_care_address": ("at_consumer_care", "all_consumer_care"),
    "consumer_care_phone": ("box_phone", "val_phone"), "consumer_care_email": ("box_email", "val_email"),
    "unit_sale_price": ("at_unit_sale_price", "own_unit_price")}


def soft_quality_warning(n_regions: Column, found: list[Column]) -> Column:
    n_found = sum((f.cast("int") for f in found), F.lit(0))
    return (F.when(F.coalesce(n_regions, F.lit(0)) == 0, K.WARNING_NO_TEXT)
            .when((n_found == 0) & (n_regions < 4), X.fill(K.WARNING_FEW_REGIONS, n=n_regions)))


def extract_declarations(regions: DataFrame, dictionary: A.Dictionary | None = None) -> DataFrame:
    """One row per scan that has at least one box: the fifteen fields, inferred flags and heights."""
    dictionary = dictionary or A.compile_dictionary()
    rows = with_row_matches(first_boxes(regions, dictionary), regions, dictionary)
    picked = pick_boxes(read_values(rows))
    out = picked.select("scan_id", "n_regions", F.col("at_tallest.height").cast("double").alias("tallest"),
                      F.col("at_best_before").isNotNull().alias("has_best_before"),
                      F.col("at_country_of_origin").isNotNull().alias("has_country"),
                      *[F.expr(field_sql(*FIELD_SOURCES[f])).alias(f) for f in K.DECLARATION_FIELDS])
    unit = F.when(F.col("net_quantity_value.found"), F.col("net_quantity_unit.value"))
    named = {n: F.col(f"{f}.bounding_box.height").cast("double") for n, f in
             [("mrp_height", "mrp_value"), ("quantity_height", "net_quantity_value")]}
    return out.select(
        "scan_id", *K.DECLARATION_FIELDS,
        X.unit_category(unit, F.lit(None).cast("string")).alias("commodity_category"),
        F.when(F.col("has_best_before"), F.lit(True)).alias("is_perishable_category"),
        F.when(F.col("has_country"), F.lit(True)).alias("is_imported"),
        "n_regions", *[c.alias(n) for n, c in named.items()],
        F.greatest("tallest", *named.values()).alias("ref_height"),
        soft_quality_warning(F.col("n_regions"), [F.col(f"{f}.found") for f in K.QUALITY_FIELDS])
        .alias("image_quality_warning"))


def with_unread_scans(scans: DataFrame, declarations: DataFrame) -> DataFrame:
    """Every scan of ``scans``, with empty declarations where no box was read at all."""
    j = scans.select("scan_id").join(declarations, "scan_id", "left")
    return j.withColumns({
        **{f: F.coalesce(F.col(f), not_found()) for f in K.DECLARATION_FIELDS},
        "n_regions": F.coalesce("n_regions", F.lit(0)),
        "image_quality_warning": F.when(F.col("n_regions").isNull(), K.WARNING_NO_TEXT)
        .otherwise(F.col("image_quality_warning"))})


def to_long(declarations: DataFrame) -> DataFrame:
    """(scan_id, field_name, value, ... ) - fifteen rows per scan."""
    rows = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("f")) for f in K.DECLARATION_FIELDS])
    return declarations.select("scan_id", F.inline(rows)).select("scan_id", "field_name", "f.*")


def field_rows(declarations: DataFrame, *names: str) -> DataFrame:
    return to_long(declarations).filter(F.col("field_name").isin(*names) & F.col("found"))


def assemble_declarations(fields: DataFrame) -> DataFrame:
    """Long fields -> one row per scan (the inverse of :func:`to_long`)."""
    payload = F.struct(*[F.col(f.name) for f in EXTRACTED.fields])
    return fields.groupBy("scan_id").agg(*[
        F.coalesce(F.min_by(payload, F.when(F.col("field_name") == f, F.lit(1))), not_found()).alias(f)
        for f in K.DECLARATION_FIELDS])


def apply_overrides(declarations: DataFrame, meta: DataFrame) -> DataFrame:
    """Catalogue knowledge wins over what was read; unknown (NULL, or an empty category) does not."""
    known = meta.select(
        "scan_id", F.nullif("commodity_category", F.lit("")).alias("m_category"),
        F.col("is_imported").alias("m_imported"), F.col("is_perishable_category").alias("m_perishable"),
        "is_medical_device", "is_combination_or_multipiece_package", "reference_width_mm",
        "reference_height_mm", "image_width_px", "image_height_px")
    return (declarations.join(known, "scan_id", "left").withColumns({
        "commodity_category": F.coalesce("m_category", "commodity_category"),
        "is_imported": F.coalesce("m_imported", "is_imported"),
        "is_perishable_category": F.coalesce("m_perishable", "is_perishable_category")})
        .drop("m_category", "m_imported", "m_perishable"))
