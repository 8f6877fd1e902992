"""Rule oracles: one SELECT per rule over a ``ready``-shaped block."""

from __future__ import annotations

from cartonscope import constants as K
from oracle.sql import block, fill, q, strip

P, F, NV, NA = (q(s) for s in ("PASS", "FAIL", "NEEDS_VERIFICATION", "NOT_APPLICABLE"))


def low(f): return f"({f}_src <> 'ocr+vision' AND coalesce({f}_conf < 60.0, false))"
def check(f): return f"({f}_note IS NOT NULL OR {low(f)})"


def prov(f):
    head, tail = K.NOTE_VISION_CONTESTED.split("{note}")
    return (f"CASE {f}_src WHEN 'ocr+vision' THEN {q(K.NOTE_BOTH_READERS)} WHEN 'vision' THEN CASE WHEN coalesce({f}_note, '') <> '' "
            f"THEN {q(head)} || {f}_note || {q(tail)} ELSE {q(K.NOTE_VISION_ONLY)} END END")


def ev(f): return (f"{f}_val", f"{f}_src", f"{f}_x", f"{f}_h")


NONE = ("NULL", "'ocr'", "NULL", "NULL")


def pick(cases, default):
    """cases: [(condition, status, notes, evidence 4-tuple)] -> column SQL"""
    out = []
    for i, name in enumerate(("status", "notes", "value", "source", "box_x", "box_h")):
        def part(c):
            return c[1] if i == 0 else c[2] if i == 1 else c[3][i - 2]
        whens = " ".join(f"WHEN {c[0]} THEN {part(c)}" for c in cases)
        typ = "INT" if name.startswith("box") else "VARCHAR"
        expr = f"CASE {whens} ELSE {part(default)} END" if cases else part(default)
        out.append(f"({expr})::{typ} AS {name}")
    return ", ".join(out)


def found_cases(f, guard="true"):
    notes = f"concat_ws(' ', CASE WHEN {low(f)} THEN {q(K.NOTE_LOW_CONFIDENCE)} END, {prov(f)})"
    return [(f"{guard} AND (NOT {f}_found OR coalesce({f}_val, '') = '')", F, q(K.NOTE_NOT_FOUND), ev(f))], \
        (None, f"CASE WHEN {check(f)} THEN {NV} ELSE {P} END", notes, ev(f))


def checked(f):
    return (None, f"CASE WHEN {check(f)} THEN {NV} ELSE {P} END",
            f"CASE WHEN {check(f)} THEN {q(K.NOTE_LOW_CONFIDENCE)} ELSE '' END", ev(f))


RULE: dict[str, str] = {}
m, a = "manufacturer_name", "manufacturer_address"
RULE["R6-1"] = pick([(f"NOT {m}_found AND NOT {a}_found", F, q(K.NOTE_MAKER_MISSING), NONE),
                     (f"NOT {m}_found OR NOT {a}_found", NV, q(K.NOTE_MAKER_PARTIAL), ev(m)),
                     (f"{check(m)} OR {check(a)}", NV, q(K.NOTE_MAKER_LOW), ev(m))], (None, P, "''", ev(m)))
c, d = found_cases("country_of_origin")
RULE["R6-2"] = pick([("is_imported = false", NA, q(K.NOTE_DOMESTIC), NONE),
                     ("is_imported IS NULL", NV, q(K.NOTE_IMPORT_UNKNOWN), NONE)] + c, d)
RULE["R6-3"] = pick(*found_cases("common_generic_name"))
n = "net_quantity_value"
u = f"lower({strip('net_quantity_unit_val')})"
counted = f"{u} IN ({', '.join(q(x) for x in K.COUNT_UNITS)})"
RULE["R6-4"] = pick([(f"NOT {n}_found", F, q(K.NOTE_QTY_MISSING), NONE),
                     ("NOT net_quantity_unit_found", NV, q(K.NOTE_QTY_NO_UNIT), ev(n)),
                     (f"commodity_category = 'liquid' AND {counted}", F, fill(K.NOTE_LIQUID_COUNT, unit=u), ev(n)),
                     (f"commodity_category = 'solid' AND {counted}", NV, fill(K.NOTE_SOLID_COUNT, unit=u), ev(n))], checked(n))
RULE["R6-5"] = pick(*found_cases("mfg_month_year"))
c, d = found_cases("best_before_use_by")
RULE["R6-6"] = pick([("is_perishable_category = false", NA, q(K.NOTE_NOT_PERISHABLE), NONE),
                     ("is_perishable_category IS NULL", NV, q(K.NOTE_PERISHABLE_UNKNOWN), NONE)] + c, d)
RULE["R6-7"] = pick([("NOT mrp_value_found", F, q(K.NOTE_MRP_MISSING), NONE),
                     ("NOT mrp_inclusive_of_taxes_stated_found", F, q(K.NOTE_TAX_MISSING), ev("mrp_value"))], checked("mrp_value"))
care = [f"consumer_care_{x}" for x in ("name", "address", "phone", "email")]
n_care = "(" + " + ".join(f"{x}_found::INT" for x in care) + ")"
first_care = tuple("CASE " + " ".join(f"WHEN {x}_found THEN {ev(x)[i]}" for x in care) + " END" for i in range(4))
RULE["R6-9"] = pick([(f"{n_care} = 0", F, q(K.NOTE_CARE_MISSING), NONE),
                     (f"{n_care} < 4", NV, fill(K.NOTE_CARE_PARTIAL, n=n_care), first_care)], (None, P, "''", first_care))
RULE["R6-10"] = pick([("is_combination_or_multipiece_package", NA, q(K.NOTE_MULTIPIECE), NONE),
                      ("NOT unit_sale_price_found", NV, q(K.NOTE_UNIT_PRICE_MISSING), NONE)], (None, P, "''", ev("unit_sale_price")))
terms = "concat_ws(', ', " + ", ".join(f"CASE WHEN contains(lower({n}_raw), {q(t)}) THEN {q(t)} END" for t in K.MISLEADING_TERMS) + ")"
RULE["R6-11"] = pick([(f"NOT {n}_found", NA, q(K.NOTE_NO_QTY_TO_CHECK), NONE),
                      (f"{terms} <> ''", F, fill(K.NOTE_MISLEADING, terms=terms), ev(n))], (None, P, "''", ev(n)))
BANDS = "CASE " + " ".join(f"WHEN area <= {hi} THEN {mm}" for _, hi, mm in K.HEIGHT_TABLE_MM if hi) + f" ELSE {K.HEIGHT_TABLE_MM[-1][2]} END"
BANDS = f"({BANDS})::DOUBLE"


def height(h, label):
    mm = f"({h} / px_per_mm)"
    shown = f"printf('%.2f', {mm})"
    pct = f"round_even({h} / ref_height * 100, 0)::INT"
    return pick([("is_medical_device", NA, q(K.NOTE_MEDICAL), NONE),
                 (f"calibrated AND {h} IS NOT NULL", f"CASE WHEN {mm} >= {BANDS} THEN {P} ELSE {F} END",
                  fill(K.NOTE_HEIGHT, label=q(label), min=BANDS, area="round_even(area, 0)::BIGINT", mm=shown),
                  (fill(K.VALUE_HEIGHT, mm=shown), "'ocr'", "NULL", "NULL")),
                 (f"{h} IS NULL OR ref_height IS NULL OR ref_height = 0", NV, q(K.NOTE_HEIGHT_NO_DATA), NONE),
                 (f"{h} / ref_height < 0.35", NV, fill(K.NOTE_HEIGHT_SMALL, label=q(label), pct=pct), NONE)],
                (None, NV, fill(K.NOTE_HEIGHT_FINE, label=q(label), pct=pct), NONE))


RULE["R7-1"] = height("mrp_height", K.LABEL_MRP_HEIGHT)
RULE["R7-2"] = height("quantity_height", K.LABEL_QTY_HEIGHT)
PROXY = q(K.NOTE_PROXY)
RULE["R8-1"] = pick([
    ("coalesce(g_n, 0) < 2", NV, f"{q(K.NOTE_GROUP_FEW)} || {PROXY}", NONE),
    ("coalesce(image_width_px, 0) = 0 OR coalesce(image_height_px, 0) = 0", NV, f"{q(K.NOTE_GROUP_NO_DIMS)} || {PROXY}", NONE),
    ("worst <= 0.35", P, f"{fill(K.NOTE_GROUP_PASS, n='g_n', worst='round_even(worst * 100, 0)::INT')} || {PROXY}",
     (fill(K.VALUE_GROUP_PASS, worst="round_even(worst * 100, 0)::INT"), "'ocr'", "NULL", "NULL")),
    ("worst > 0.45 AND (mid = 0 OR worst > mid * 2.5)", F,
     f"{fill(K.NOTE_GROUP_FAIL, name='worst_name', worst='round_even(worst * 100, 0)::INT', median='round_even(mid * 100, 0)::INT')} || {PROXY}",
     (fill(K.VALUE_GROUP_FAIL, name="worst_name", worst="round_even(worst * 100, 0)::INT"), "'ocr'", "NULL", "NULL"))],
    (None, NV, f"{fill(K.NOTE_GROUP_UNSURE, name='worst_name', worst='round_even(worst * 100, 0)::INT')} || {PROXY}", NONE))
AP = q(K.NOTE_NUMERAL_APPROX)
own = (f"{n}_val", "'ocr'", f"{n}_x", f"{n}_h")
RULE["R8-2"] = pick([(f"NOT {n}_found OR {n}_x IS NULL", NV, f"{q(K.NOTE_CLEAR_NO_QTY)} || {AP}", NONE),
                     (f"{n}_h <= 0", NV, f"{q(K.NOTE_CLEAR_BAD_HEIGHT)} || {AP}", NONE),
                     ("intruding IS NULL", P, f"{q(K.NOTE_CLEAR_PASS)} || {AP}", own)],
                    (None, F, f"{fill(K.NOTE_CLEAR_FAIL, texts='intruding')} || {AP}", own))

for src in ("ready", "entire"):
    centres = " UNION ALL ".join(
        f"SELECT scan_id, {i} AS i, {q(name)} AS name, {f}_x + {f}_w / 2.0 AS cx, {f}_y + {f}_h / 2.0 AS cy, "
        f"sqrt(image_width_px::DOUBLE * image_width_px + image_height_px::DOUBLE * image_height_px) AS diag "
        f"FROM {src} WHERE {f}_found AND {f}_x IS NOT NULL" + (" AND is_imported" if f == "country_of_origin" else "")
        for i, (name, f) in enumerate(K.GROUPED_DECLARATIONS))
    block(f"{src}_spread", f"""
SELECT scan_id, any_value(n) AS g_n, max(r) AS worst, arg_max(name, rn) AS worst_name, any_value(r) FILTER (WHERE rn = n // 2 + 1) AS mid
FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY r, i) AS rn FROM (
  SELECT c.scan_id, i, name, n, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) / diag AS r
  FROM ({centres}) c JOIN (SELECT scan_id, sum(cx) / count(*) AS mx, sum(cy) / count(*) AS my, count(*) AS n
    FROM ({centres}) GROUP BY 1) USING (scan_id))) GROUP BY 1""", src)
    block(f"{src}_g", f"SELECT * FROM {src} LEFT JOIN {src}_spread USING (scan_id)", src, f"{src}_spread")


def rule_select(rule_id: str, src: str = "ready_g") -> str:
    ref = q(K.RULES[rule_id][0])
    if rule_id.startswith("R7"):
        ref = f"CASE WHEN is_medical_device THEN {q(K.MEDICAL_REFERENCE)} ELSE {ref} END"
    return f"SELECT scan_id, {q(rule_id)} AS rule_id, {ref} AS rule_reference, {RULE[rule_id]} FROM {src}"


for src in ("ready", "entire"):
    block(f"{src}_results", " UNION ALL ".join(rule_select(r, f"{src}_g") for r in K.RULES), f"{src}_g")
