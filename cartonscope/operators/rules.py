"""The fourteen tri-state rules as column expressions over one declarations row.

A rule is a function ``(row) -> [Case, ...]`` where ``row`` gives access to the declaration
columns; the registry evaluates all of them in a single projection. User rules register the same way
and are counted like the built-in ones.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import text as X
from cartonscope.operators.merging import trust_flags
from cartonscope.schemas import EVIDENCE, EXTRACTED

Row = Callable[[str], Column]
PASS, FAIL, NV, NA = K.PASS, K.FAIL, K.NEEDS_VERIFICATION, K.NOT_APPLICABLE


def evidence(value: Column | None = None, source: Column | str = "ocr", note: Column | None = None,
             box: Column | None = None, confidence: Column | None = None, language: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(*[c if c is not None else null for c in (
        value, F.lit(source) if isinstance(source, str) else source, note, box, confidence, language)]).cast(EVIDENCE)


def field_evidence(f: Column) -> Column:
    return evidence(f["value"], f["source"], f["disagreement_note"], f["bounding_box"], f["ocr_confidence"],
                    f["language"])


class Case:
    """One branch of a rule: condition (None = otherwise), status, notes, evidence, reference."""

    def __init__(self, when: Column | None, status: str | Column, notes: str | Column = "",
                 proof: Column | None = None, reference: str | None = None) -> None:
        def text(v):
            return F.lit(v) if isinstance(v, str) else v
        self.when, self.status, self.notes = when, text(status), text(notes)
        self.proof = proof if proof is not None else evidence()
        self.reference = F.lit(reference).cast("string")


Cases = list[Case]


def field_facts() -> dict[str, Column]:
    """``low__<field>`` and ``check__<field>``: trust flags the rules share."""
    out = {}
    for f in K.DECLARATION_FIELDS:
        low = f"({f}.source <> 'ocr+vision' AND coalesce({f}.ocr_confidence < {K.LOW_CONFIDENCE}, false))"
        out[f"low__{f}"] = F.expr(low)
        out[f"check__{f}"] = F.expr(f"{f}.disagreement_note IS NOT NULL OR {low}")
    return out


def found_or_fail(d: Row, name: str) -> Cases:
    f = d(name)
    low = F.when(d(f"low__{name}"), K.NOTE_LOW_CONFIDENCE).otherwise("")
    notes = X.join_notes(low, X.provenance_note(f["source"], f["disagreement_note"]))
    missing = ~f["found"] | (F.coalesce(f["value"], F.lit("")) == "")
    return [Case(missing, FAIL, K.NOTE_NOT_FOUND, field_evidence(f)),
            Case(None, F.when(d(f"check__{name}"), NV).otherwise(PASS), notes, field_evidence(f))]


def checked_value(d: Row, name: str) -> Case:
    """PASS, or a manual check with the low-confidence note."""
    doubtful = d(f"check__{name}")
    return Case(None, F.when(doubtful, NV).otherwise(PASS), F.when(doubtful, K.NOTE_LOW_CONFIDENCE).otherwise(""),
                field_evidence(d(name)))


def manufacturer(d: Row) -> Cases:
    name, address = d("manufacturer_name"), d("manufacturer_address")
    doubtful = ((name["found"] & d("check__manufacturer_name"))
                | (address["found"] & d("check__manufacturer_address")))
    proof = field_evidence(name)
    return [Case(~name["found"] & ~address["found"], FAIL, K.NOTE_MAKER_MISSING),
            Case(~name["found"] | ~address["found"], NV, K.NOTE_MAKER_PARTIAL, proof),
            Case(doubtful, NV, K.NOTE_MAKER_LOW, proof), Case(None, PASS, "", proof)]


def country(d: Row) -> Cases:
    imported = d("is_imported")
    return [Case(imported.isNull(), NV, K.NOTE_IMPORT_UNKNOWN), Case(~imported, NA, K.NOTE_DOMESTIC),
            *found_or_fail(d, "country_of_origin")]


def generic_name(d: Row) -> Cases:
    return found_or_fail(d, "common_generic_name")


def net_quantity(d: Row) -> Cases:
    value, unit_field = d("net_quantity_value"), d("net_quantity_unit")
    unit = F.lower(X.strip(F.coalesce(unit_field["value"], F.lit(""))))
    counted = unit.isin(*K.COUNT_UNITS)
    category = F.coalesce(d("commodity_category"), F.lit(""))
    proof = field_evidence(value)
    return [Case(~value["found"], FAIL, K.NOTE_QTY_MISSING), Case(~unit_field["found"], NV, K.NOTE_QTY_NO_UNIT, proof),
            Case((category == "liquid") & counted, FAIL, X.fill(K.NOTE_LIQUID_COUNT, unit=unit), proof),
            Case((category == "solid") & counted, NV, X.fill(K.NOTE_SOLID_COUNT, unit=unit), proof),
            checked_value(d, "net_quantity_value")]


def mfg_date(d: Row) -> Cases:
    return found_or_fail(d, "mfg_month_year")


def best_before(d: Row) -> Cases:
    perishable = d("is_perishable_category")
    return [Case(perishable.isNull(), NV, K.NOTE_PERISHABLE_UNKNOWN), Case(~perishable, NA, K.NOTE_NOT_PERISHABLE),
            *found_or_fail(d, "best_before_use_by")]


def mrp(d: Row) -> Cases:
    value = d("mrp_value")
    return [Case(~value["found"], FAIL, K.NOTE_MRP_MISSING),
            Case(~d("mrp_inclusive_of_taxes_stated")["found"], FAIL, K.NOTE_TAX_MISSING, field_evidence(value)),
            checked_value(d, "mrp_value")]


def consumer_care(d: Row) -> Cases:
    names = [f"consumer_care_{p}" for p in ("name", "address", "phone", "email")]
    n = sum((d(f)["found"].cast("int") for f in names), F.lit(0))
    proof = F.coalesce(*[F.when(d(f)["found"], field_evidence(d(f))) for f in names])
    return [Case(n == 0, FAIL, K.NOTE_CARE_MISSING),
            Case(n < len(names), NV, X.fill(K.NOTE_CARE_PARTIAL, n=n), proof), Case(None, PASS, "", proof)]


def unit_price(d: Row) -> Cases:
    price = d("unit_sale_price")
    return [Case(F.coalesce(d("is_combination_or_multipiece_package"), F.lit(False)), NA, K.NOTE_MULTIPIECE),
            Case(~price["found"], NV, K.NOTE_UNIT_PRICE_MISSING), Case(None, PASS, "", field_evidence(price))]


def not_misleading(d: Row) -> Cases:
    value, terms = d("net_quantity_value"), d("misleading")
    return [Case(~value["found"], NA, K.NOTE_NO_QTY_TO_CHECK),
            Case(terms != "", FAIL, X.fill(K.NOTE_MISLEADING, terms=terms), field_evidence(value)),
            Case(None, PASS, "", field_evidence(value))]


def min_height_mm(area: Column) -> Column:
    """Band lookup (above, up to and including]; areas at or below zero fall in the first band."""
    chain = None
    for _, upper, mm in K.HEIGHT_TABLE_MM:
        if upper is None:
            return chain.otherwise(F.lit(mm))
        chain = F.when(area <= upper, F.lit(mm)) if chain is None else chain.when(area <= upper, F.lit(mm))
    return chain


def height_facts(key: str, height_column: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Two steps of columns: measured mm and relative height, then their printed forms."""
    px = F.col(height_column)
    return ({f"mm__{key}": px / F.nullif(F.col("px_per_mm"), F.lit(0.0)),
             f"ratio__{key}": px / F.nullif(F.col("ref_height"), F.lit(0.0))},
            {f"shown__{key}": X.fixed(F.col(f"mm__{key}"), 2),
             f"pct__{key}": X.percent(F.col(f"ratio__{key}"))})


def _height_rule(key: str, height_column: str, label: str) -> Callable[[Row], Cases]:
    def rule(d: Row) -> Cases:
        need, shown, ratio, pct = d("need_mm"), d(f"shown__{key}"), d(f"ratio__{key}"), d(f"pct__{key}")
        calibrated = d("calibration_available") & d("pdp_area_cm2").isNotNull() & d(height_column).isNotNull()
        measured = X.fill(K.NOTE_HEIGHT, label=F.lit(label), min=need,
                          area=F.bround(d("pdp_area_cm2"), 0).cast("bigint"), mm=shown)
        return [Case(F.coalesce(d("is_medical_device"), F.lit(False)), NA, K.NOTE_MEDICAL, reference=K.MEDICAL_REFERENCE),
                Case(F.coalesce(calibrated, F.lit(False)), F.when(d(f"mm__{key}") >= need, PASS).otherwise(FAIL), measured,
                     evidence(X.fill(K.VALUE_HEIGHT, mm=shown))),
                Case(ratio.isNull(), NV, K.NOTE_HEIGHT_NO_DATA),
                Case(ratio < K.DISPROPORTION_RATIO, NV, X.fill(K.NOTE_HEIGHT_SMALL, label=F.lit(label), pct=pct)),
                Case(None, NV, X.fill(K.NOTE_HEIGHT_FINE, label=F.lit(label), pct=pct))]
    return rule


mrp_height = _height_rule("mrp", "mrp_height", K.LABEL_MRP_HEIGHT)
quantity_height = _height_rule("qty", "quantity_height", K.LABEL_QTY_HEIGHT)


def with_spread(ready: DataFrame) -> DataFrame:
    """Adds g_n, g_worst, g_name, g_mid: distances of at most seven box centres from their centroid,
    as shares of the photo's diagonal. One step per derived value, so nothing is evaluated twice."""
    def centre(i, name, f):
        cond = f"{f}.found AND {f}.bounding_box IS NOT NULL" + (" AND coalesce(is_imported, false)" if f == "country_of_origin" else "")
        return (f"IF({cond}, named_struct('name', '{name}', 'cx', {f}.bounding_box.x + {f}.bounding_box.width / 2, "
                f"'cy', {f}.bounding_box.y + {f}.bounding_box.height / 2, 'i', {i}), NULL)")
    centres = ", ".join(centre(i, n, f) for i, (n, f) in enumerate(K.GROUPED_DECLARATIONS))
    step = ready.withColumns({
        "g_centres": F.expr(f"array_compact(array({centres}))"),
        "g_diagonal": F.expr("sqrt(double(image_width_px) * image_width_px + double(image_height_px) * image_height_px)")})
    step = step.withColumn("g_n", F.size("g_centres"))
    step = step.withColumns({f"g_{a}": F.expr(f"aggregate(g_centres, 0D, (acc, c) -> acc + c.{a}) / nullif(g_n, 0)")
                             for a in ("cx", "cy")})
    step = step.withColumn("g_ranked", F.expr(
        "array_sort(transform(g_centres, c -> named_struct('r', sqrt((c.cx - g_cx) * (c.cx - g_cx) + (c.cy - g_cy) * "
        "(c.cy - g_cy)) / nullif(g_diagonal, 0D), 'i', c.i, 'name', c.name)))"))
    step = step.withColumns({"g_last": F.expr("try_element_at(g_ranked, -1)"),
                             "g_mid": F.expr("try_element_at(g_ranked, cast(floor(g_n / 2) + 1 AS INT)).r")})
    step = step.withColumns({"g_worst": F.col("g_last.r"), "g_name": F.col("g_last.name")})
    return step.withColumns({"g_pct": X.percent(F.col("g_worst")), "g_mid_pct": X.percent(F.col("g_mid"))})


def grouping(d: Row) -> Cases:
    n, worst, middle, name = d("g_n"), d("g_worst"), d("g_mid"), d("g_name")
    pct, mid_pct, tail = d("g_pct"), d("g_mid_pct"), F.lit(K.NOTE_PROXY)
    far = (worst > K.GROUPING_FAIL_RATIO) & ((middle == 0) | (worst > middle * K.GROUPING_OUTLIER_MULTIPLE))
    no_dims = (F.coalesce(d("image_width_px"), F.lit(0)) == 0) | (F.coalesce(d("image_height_px"), F.lit(0)) == 0)
    return [Case(n < 2, NV, F.concat(F.lit(K.NOTE_GROUP_FEW), tail)),
            Case(no_dims, NV, F.concat(F.lit(K.NOTE_GROUP_NO_DIMS), tail)),
            Case(worst <= K.GROUPING_PASS_RATIO, PASS, F.concat(X.fill(K.NOTE_GROUP_PASS, n=n, worst=pct), tail),
                 evidence(X.fill(K.VALUE_GROUP_PASS, worst=pct))),
            Case(far, FAIL, F.concat(X.fill(K.NOTE_GROUP_FAIL, name=name, worst=pct, median=mid_pct), tail),
                 evidence(X.fill(K.VALUE_GROUP_FAIL, name=name, worst=pct))),
            Case(None, NV, F.concat(X.fill(K.NOTE_GROUP_UNSURE, name=name, worst=pct), tail))]


def _in_clear_space(box: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a box lies in the clear space of the quantity's box without being part of it."""
    x2, y2, h = x + width, y + height, box["height"]
    qx2, qy2 = box["x"] + box["width"], box["y"] + h
    inside = (x >= box["x"]) & (y >= box["y"]) & (x2 <= qx2) & (y2 <= qy2)
    return (x2 > box["x"] - 2 * h) & (x < qx2 + 2 * h) & (y2 > box["y"] - h) & (y < qy2 + h) & ~inside


def with_clear_space(declarations: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds ``intruding``: quoted texts of the first three intruders, NULL when there are none.

    One declared row per scan meets that scan's boxes in an outer join that keeps only intruders, so declarations are
    computed once and nothing is staged; boxes never meet boxes. Intruders of a scan are then walked in box order: the
    first row of a scan sees the texts of the next two and is the one that stays.
    """
    quantity = F.col("net_quantity_value")
    box = quantity["bounding_box"]
    seen = regions.select(F.col("scan_id").alias("r_scan"), F.col("region_idx").alias("r_idx"), F.col("text").alias("r_text"),
                          *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "width", "height")])
    intrudes = quantity["found"] & (box["height"] > 0) & _in_clear_space(box, *[F.col(f"r_{c}") for c in ("x", "y", "width", "height")])
    met = declarations.join(seen, (F.col("scan_id") == F.col("r_scan")) & intrudes, "left")
    order = Window.partitionBy("scan_id").orderBy("r_idx")
    text = F.when(F.col("r_scan").isNotNull(), X.quoted(F.col("r_text")))
    first = met.withColumns({"r_at": F.row_number().over(order), "r_next": F.lead(text, 1).over(order), "r_third": F.lead(text, 2).over(order)})
    return first.filter("r_at = 1").select(
        *declarations.columns, F.when(F.col("r_scan").isNotNull(), F.concat_ws(", ", text, "r_next", "r_third")).alias("intruding"))


def clear_space(d: Row) -> Cases:
    q = d("net_quantity_value")
    tail = F.lit(K.NOTE_NUMERAL_APPROX)
    proof = evidence(q["value"], box=q["bounding_box"])
    return [Case(~q["found"] | q["bounding_box"].isNull(), NV, F.concat(F.lit(K.NOTE_CLEAR_NO_QTY), tail)),
            Case(q["bounding_box"]["height"] <= 0, NV, F.concat(F.lit(K.NOTE_CLEAR_BAD_HEIGHT), tail)),
            Case(d("intruding").isNull(), PASS, F.concat(F.lit(K.NOTE_CLEAR_PASS), tail), proof),
            Case(None, FAIL, F.concat(X.fill(K.NOTE_CLEAR_FAIL, texts=d("intruding")), tail), proof)]


class Registry:
    """Ordered rule set; every rule is ``name -> (reference, requirement, row -> cases)``."""

    def __init__(self) -> None:
        self._rules: OrderedDict[str, tuple[str, str, Callable[[Row], Cases]]] = OrderedDict()

    def register(self, rule_id: str, rule: Callable[[Row], Cases], reference: str = "", requirement: str = "") -> "Registry":
        self._rules[rule_id] = (reference, requirement, rule)
        return self

    @property
    def rule_ids(self) -> list[str]:
        return list(self._rules)

    def needs_clear_space(self) -> bool:
        return "R8-2" in self._rules

    def cases(self) -> dict[str, Cases]:
        return {r: rule(F.col) for r, (_, _, rule) in self._rules.items()}

    def result(self, position: int, rule_id: str, cases: Cases) -> Column:
        reference, requirement, _ = self._rules[rule_id]
        null = F.lit(None).cast("string")

        def chosen(part: str) -> Column:
            branch, expr = F.col(f"branch_{position}"), None
            for i, c in enumerate(cases[:-1]):
                value = getattr(c, part)
                expr = F.when(branch == i, value) if expr is None else expr.when(branch == i, value)
            last = getattr(cases[-1], part)
            return last if expr is None else expr.otherwise(last)
        return F.struct(
            F.lit(position).alias("rule_no"), F.lit(rule_id).alias("rule_id"),
            F.coalesce(chosen("reference"), F.lit(reference)).alias("rule_reference"),
            F.lit(requirement).alias("requirement_text"), chosen("status").alias("status"),
            chosen("proof").alias("evidence"), chosen("notes").alias("notes"), null.alias("original_status"),
            null.alias("verified_by"), null.alias("verified_at"), null.alias("verification_note"))


BUILT_IN: dict[str, Callable[[Row], Cases]] = {
    "R6-1": manufacturer, "R6-2": country, "R6-3": generic_name, "R6-4": net_quantity, "R6-5": mfg_date,
    "R6-6": best_before, "R6-7": mrp, "R6-9": consumer_care, "R6-10": unit_price, "R6-11": not_misleading,
    "R7-1": mrp_height, "R7-2": quantity_height, "R8-1": grouping, "R8-2": clear_space}


def default_registry(*only: str) -> Registry:
    registry = Registry()
    for rule_id, (reference, requirement) in K.RULES.items():
        if not only or rule_id in only:
            registry.register(rule_id, BUILT_IN[rule_id], reference, requirement)
    return registry


def with_facts(ready: DataFrame, registry: Registry) -> DataFrame:
    """Shared intermediate columns, each computed once; unused ones are pruned by the optimizer."""
    heights = [height_facts("mrp", "mrp_height"), height_facts("qty", "quantity_height")]
    terms = F.array_join(X.misleading_terms(F.col("net_quantity_value.raw_text_span")), ", ")
    out = ready.withColumns({**field_facts(), "misleading": terms, "need_mm": min_height_mm(F.col("pdp_area_cm2")),
                             **heights[0][0], **heights[1][0]})
    out = out.withColumns({**heights[0][1], **heights[1][1]})
    return with_spread(out) if "R8-1" in registry.rule_ids else out


def run_rules(ready: DataFrame, registry: Registry | None = None) -> DataFrame:
    """All registered rules in one pass: one input row becomes one row per rule.

    Each rule first settles which of its branches applies, then its result is written from that
    branch number. ``ready`` must carry ``intruding`` (see :func:`with_clear_space`) for R8-2."""
    registry = registry or default_registry()
    cases = registry.cases()

    def branch(rule: Cases) -> Column:
        expr = None
        for i, c in enumerate(rule[:-1]):
            expr = F.when(c.when, i) if expr is None else expr.when(c.when, i)
        return F.lit(0) if expr is None else expr.otherwise(len(rule) - 1)
    settled = with_facts(ready, registry).withColumns({f"branch_{i}": branch(cases[r]) for i, r in enumerate(cases)})
    results = F.array(*[registry.result(i, r, cases[r]) for i, r in enumerate(cases)])
    return settled.select("scan_id", F.inline(results))


def presence_results(fields: DataFrame) -> DataFrame:
    """Found-or-fail on long declaration rows: (scan_id, field_name, status, notes)."""
    flagged = trust_flags(fields).withColumn("f", F.struct(*[x.name for x in EXTRACTED.fields]))
    names = {"f": "f", "low__f": "low_confidence", "check__f": "needs_manual_check"}
    missing, present = found_or_fail(lambda n: F.col(names[n]), "f")
    return flagged.select("scan_id", "field_name", F.when(missing.when, missing.status).otherwise(present.status).alias("status"),
                          F.when(missing.when, missing.notes).otherwise(present.notes).alias("notes"))
