"""The oracle query of every catalogue key."""

from __future__ import annotations

from cartonscope import constants as K
from cartonscope.plans.catalog import EXTRA_TERMS, FIELD_KEYS, LIMITER, NOW
from oracle import rules as RS
from oracle import sql as S
from oracle.sql import block, compose, fill, norm, q, rx

ORACLE: dict[str, str] = {}
W, SP = S.W, S.SP
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
BOX = "x, y, width, height"


def put(key, final, *needs):
    ORACLE[key] = compose(final, *needs)


# ---- sources and sinks -----------------------------------------------------------------------
put("src_1", """SELECT scan_id, CASE reader WHEN 'p' THEN 'psm3' ELSE 'psm12' END AS reader,
  (row_number() OVER (PARTITION BY scan_id, reader ORDER BY region_idx) - 1)::INT AS region_idx, text, x, y, width, height, confidence
FROM (SELECT * FROM regions_p UNION ALL SELECT * FROM regions_s)""", "regions_p", "regions_s")
put("src_2", "SELECT scan_id, word_idx, text, x, y, width, height, confidence FROM clean_words", "clean_words")
put("src_3", """SELECT grp, lang, term, coalesce(n, 0)::BIGINT AS n_boxes FROM anchors LEFT JOIN (
  SELECT grp, term, count(*) AS n FROM regions_p JOIN exact_p USING (text) GROUP BY 1, 2) USING (grp, term)""", "anchors", "regions_p", "exact_p")
_ext = r"""lower(CASE WHEN regexp_matches(filename, '^[^.].*\.') THEN '.' || string_split(filename, '.')[-1] ELSE '' END)"""
put("src_4", f"""SELECT upload_id, ext AS extension, CASE
  WHEN ext <> '' AND ext NOT IN ({', '.join(q(x) for x in K.UPLOAD_EXTENSIONS)}) THEN 'extension'
  WHEN coalesce(content_type, '') <> '' AND content_type NOT IN ({', '.join(q(x) for x in K.UPLOAD_CONTENT_TYPES)}) THEN 'content_type'
  WHEN length = 0 THEN 'empty' WHEN length > 12582912 THEN 'too_large' END AS reason FROM (SELECT *, {_ext} AS ext FROM uploads)""", "uploads")
put("src_5", f"""SELECT scan_id, f.field_name, v.value, v.value IS NOT NULL AS found, CASE WHEN v.value IS NULL THEN 'ocr' ELSE 'vision' END AS source
FROM (SELECT scan_id FROM answers WHERE json_valid(body) AND json_type(body) = 'OBJECT')
CROSS JOIN (SELECT unnest([{', '.join(q(n) for n in K.DECLARATION_FIELDS)}]) AS field_name) f
LEFT JOIN vision v USING (scan_id, field_name)""", "answers", "vision")
block("coded", """
SELECT *, CASE WHEN code0 = 200 AND rn > 1 THEN 409 ELSE code0 END AS code FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id, code0 ORDER BY ts, request_id) AS rn FROM (
    SELECT r.*, CASE WHEN role <> 'admin' THEN 403 WHEN o_orderkey IS NULL THEN 404 WHEN t.status IS NULL THEN 404
      WHEN t.status <> 'NEEDS_VERIFICATION' THEN 409 ELSE 200 END AS code0
    FROM requests r LEFT JOIN orders ON o_orderkey = r.scan_id LEFT JOIN results t ON t.scan_id = r.scan_id AND t.rule_id = r.rule_id))""",
      "requests", "results")
block("accepted", "SELECT scan_id, rule_id, ts, email, nullif(trim(coalesce(note, '')), '') AS note FROM coded WHERE code = 200", "coded")
put("src_6", f"""SELECT s.id, brand, role, overall_status, coalesce(n, 0)::BIGINT AS n_audits, {TS.format(c='created_at')} AS created_at
FROM scans s LEFT JOIN products p ON p.id = product_id LEFT JOIN users u ON u.email = inspector_email
LEFT JOIN (SELECT scan_id, count(*) AS n FROM accepted GROUP BY 1) a ON a.scan_id = s.id""", "scans", "products", "users", "accepted")
block("rolled", """
SELECT scan_id, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAIL') AS f,
  count(*) FILTER (WHERE status = 'NEEDS_VERIFICATION') AS n, count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS na,
  count(*) AS total FROM results GROUP BY 1""", "results")
VERDICT = "CASE WHEN f > 0 THEN 'FAIL' WHEN n > 0 THEN 'NEEDS_VERIFICATION' ELSE 'PASS' END"
SCORE = "round(100.0 * p / nullif(p + f + n, 0), 1)::DOUBLE"
put("snk_1", f"""SELECT scan_id, product_id, inspector_email, {VERDICT} AS overall_status, {SCORE} AS compliance_score, ruleset_version,
  font_size_tier, total::INT AS n_results, coalesce(k, 0)::BIGINT AS n_boxes, mrp_value_val AS mrp, created_at::DATE::VARCHAR AS scan_date
FROM rolled JOIN scans ON id = scan_id LEFT JOIN base_p USING (scan_id)
LEFT JOIN (SELECT scan_id, count(*) AS k FROM (SELECT scan_id FROM regions_p UNION ALL SELECT scan_id FROM regions_s) GROUP BY 1) USING (scan_id)""",
    "rolled", "scans", "base_p", "regions_p", "regions_s")
put("snk_2_header", """SELECT s.id AS scan_id, coalesce(p.name, 'Unknown') AS product, coalesce(inspector_email, 'N/A') AS inspector,
  font_size_tier, ruleset_version, image_quality_warning AS warning
FROM scans s LEFT JOIN products p ON p.id = product_id LEFT JOIN base_p ON scan_id = s.id""", "scans", "products", "base_p")
put("snk_2_rows", """SELECT scan_id, rule_no, rule_id || ' (' || rule_reference || ')' AS rule, requirement_text AS requirement, status,
  coalesce(nullif(concat_ws(' / ', nullif(extracted_value, ''), nullif(notes, '')), ''), '—') AS evidence_notes FROM results""", "results")
put("snk_2_summary", f"""SELECT scan_id, {VERDICT} || ' — ' || p || ' PASS, ' || f || ' FAIL, ' || n || ' NEEDS VERIFICATION (' ||
  CASE WHEN p + f + n > 0 THEN printf('%.1f', {SCORE}) || '% of applicable checks passed' ELSE 'N/A' END || ').' AS summary FROM rolled""", "rolled")
_audit = f"""SELECT scan_id, rule_id, 'NEEDS_VERIFICATION' AS original_status, 'PASS' AS new_status, email AS verified_by, note,
  {TS.format(c='ts')} AS created_at FROM accepted"""
put("snk_3", f"{_audit} UNION ALL {_audit}", "accepted")

# ---- text ------------------------------------------------------------------------------------


def line(key, expr, every=False):
    put(key, f"SELECT * FROM (SELECT src, line_no, {expr} AS result FROM lines)" + ("" if every else " WHERE result IS NOT NULL"), "lines")


def changed(e): return f"CASE WHEN {e} <> line THEN {e} END"


line("txt_1", changed(norm("line")))
line("txt_2", changed(S.noise("line")))
line("txt_3", S.price(norm("line")))
line("txt_4", S.bare("line"))
line("txt_5", f"{S.qty('line')} || '|' || {S.unit('line')}")
line("txt_6", S.date("line"))
line("txt_7", S.loose("line"))
line("txt_8", S.strict("line"))
line("txt_9", f"CASE WHEN {S.loose('line')} IS NOT NULL THEN {S.refnum('line', S.LOOSE)}::INT END")
line("txt_10", S.email("line"))
_lat = "length(regexp_replace(line, '[^A-Za-z]', '', 'g'))"
_dev = "len(list_filter(regexp_extract_all(line, '[ऀ-ॿ]'), lambda c: regexp_matches(c, '\\p{L}')))"
_guj = "len(list_filter(regexp_extract_all(line, '[઀-૿]'), lambda c: regexp_matches(c, '\\p{L}')))"
_script = f"""CASE WHEN {_lat} + {_dev} + {_guj} = 0 THEN 'mixed' WHEN {_dev} + {_guj} = 0 THEN 'eng' WHEN {_lat} + {_guj} = 0 THEN 'hin'
  WHEN {_lat} + {_dev} = 0 THEN 'guj' WHEN {_lat} > {_dev} + {_guj} AND {_dev} + {_guj} <= 2 THEN 'eng' ELSE 'mixed' END"""
line("txt_11", _script, True)
line("txt_12", """CASE WHEN regexp_matches(line, '[ऀ-ॿ]') AND regexp_matches(line, '[઀-૿]') THEN 'mixed'
  WHEN regexp_matches(line, '[ऀ-ॿ]') THEN 'hin' WHEN regexp_matches(line, '[઀-૿]') THEN 'guj' ELSE 'eng' END""", True)
line("txt_13", f"""CASE WHEN length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) < 3 THEN 'keep'
  WHEN {_script} = 'mixed' THEN {q(K.COMBINED_READER)} ELSE {_script} END""", True)
line("txt_14", S.category(S.unit("line"), "'unknown'"), True)
line("txt_15", f"({S.agree('line', f'''coalesce({S.price('line')}, upper({S.email('line')}), 'Net')''')})::INT", True)
line("txt_16", "nullif(concat_ws(',', " + ", ".join(
    f"CASE WHEN contains(lower(line), {q(t)}) THEN {q(t)} END" for t in K.MISLEADING_TERMS) + "), '')")


def long_of(source, cols, extra=""):
    """fifteen rows per scan from a wide block; {f} is the field name"""
    return " UNION ALL ".join(f"SELECT scan_id, {q(n)} AS field_name, " + cols.replace("{f}", n) + f" FROM {source}" + extra
                              for n in K.DECLARATION_FIELDS)


def per_field(fn, source):
    return " UNION ALL ".join(f"SELECT scan_id, {q(n)} AS field_name, {fn(n)} FROM {source}" for n in K.DECLARATION_FIELDS)


put("txt_17", per_field(lambda n: f"coalesce({RS.prov(n)}, '') AS result", "merged"), "merged")
put("txt_18", """SELECT scan_id, rule_no, CASE WHEN notes <> '' AND extracted_value <> '' THEN notes || ' ' || extracted_value
  ELSE notes || coalesce(extracted_value, '') END AS result FROM results""", "results")

# ---- anchors ---------------------------------------------------------------------------------
for key, tier in (("anc_1", "exact"), ("anc_2", "fuzzy"), ("anc_3", "stray")):
    put(key, f"SELECT scan_id, region_idx, grp, term FROM regions_p JOIN {tier}_p USING (text)", "regions_p", f"{tier}_p")
put("anc_4", "SELECT scan_id, region_idx, grp, tier FROM matches_p", "matches_p")
put("anc_5", "SELECT scan_id, grp, region_idx FROM first_p", "first_p")
put("anc_6", "SELECT scan_id, region_idx, text FROM regions_p WHERE text NOT IN (SELECT text FROM tiers_p)", "regions_p", "tiers_p")
put("anc_7", "SELECT scan_id, region_idx, text FROM regions_p WHERE text IN (SELECT text FROM tiers_p)", "regions_p", "tiers_p")

# ---- layout ----------------------------------------------------------------------------------
block("by_y", "SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY y, word_idx) AS rn FROM clean_words", "clean_words")
block("line_walk", """RECURSIVE
SELECT scan_id, rn, word_idx, [{'y': y, 'h': height}] AS refs, 1::BIGINT AS line_pos FROM by_y WHERE rn = 1
UNION ALL
SELECT scan_id, rn, word_idx, CASE WHEN hit IS NULL THEN list_append(refs, {'y': y, 'h': height}) ELSE refs END,
  coalesce(hit, len(refs) + 1)
FROM (SELECT w.scan_id, w.rn, w.word_idx, w.y, w.height, l.refs,
        nullif(list_position(list_transform(l.refs, lambda r: abs(w.y - r.y) <= greatest(8.0, greatest(r.h, w.height) * 0.4)), true), 0) AS hit
      FROM line_walk l JOIN by_y w ON w.scan_id = l.scan_id AND w.rn = l.rn + 1)""", "by_y")
block("lined", "SELECT scan_id, word_idx, (line_pos - 1)::INT AS line_no FROM line_walk", "line_walk")
put("lay_1", "SELECT scan_id, word_idx, line_no FROM lined", "lined")
block("by_x", """SELECT *, row_number() OVER (PARTITION BY scan_id, line_no ORDER BY x, y, word_idx) AS rn
FROM clean_words JOIN lined USING (scan_id, word_idx)""", "clean_words", "lined")
block("merge_walk", """RECURSIVE
SELECT scan_id, line_no, rn, 1 AS part, text, x, y, x + width AS r, y + height AS b, confidence FROM by_x WHERE rn = 1
UNION ALL
SELECT w.scan_id, w.line_no, w.rn, CASE WHEN near THEN part ELSE part + 1 END,
  CASE WHEN near THEN m_text || ' ' || w.text ELSE w.text END, CASE WHEN near THEN least(m_x, w.x) ELSE w.x END,
  CASE WHEN near THEN least(m_y, w.y) ELSE w.y END, CASE WHEN near THEN greatest(m_r, w.x + w.width) ELSE w.x + w.width END,
  CASE WHEN near THEN greatest(m_b, w.y + w.height) ELSE w.y + w.height END,
  CASE WHEN near THEN least(m_conf, w.confidence) ELSE w.confidence END
FROM (SELECT n.*, m.part, m.text AS m_text, m.x AS m_x, m.y AS m_y, m.r AS m_r, m.b AS m_b, m.confidence AS m_conf,
        n.x - m.r <= greatest(40.0, greatest(m.b - m.y, n.height) * 2.5) AS near
      FROM merge_walk m JOIN by_x n ON n.scan_id = m.scan_id AND n.line_no = m.line_no AND n.rn = m.rn + 1) w""", "by_x")
put("lay_2", """SELECT scan_id, (row_number() OVER (PARTITION BY scan_id ORDER BY y, x, line_no, part) - 1)::INT AS region_idx,
  text, x, y, (r - x)::INT AS width, (b - y)::INT AS height, confidence
FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, line_no, part ORDER BY rn DESC) AS last FROM merge_walk) WHERE last = 1""", "merge_walk")
put("lay_3", "SELECT scan_id, grp AS anchor_key, region_idx FROM companions_p", "companions_p")
put("lay_4", """SELECT a.scan_id, a.grp AS anchor_key, concat_ws(' ', a.text, c_text) AS row_text
FROM need_p a JOIN (SELECT scan_id FROM boxes_p WHERE n_regions > 1) USING (scan_id)
LEFT JOIN rowtext_p t ON t.scan_id = a.scan_id AND t.grp = a.grp""", "need_p", "rowtext_p", "boxes_p")
put("lay_5", """SELECT a.scan_id, a.grp AS anchor_key, least(a.x, t.x) AS x, least(a.y, t.y) AS y,
  greatest(a.x + a.width, t.x + t.width) - least(a.x, t.x) AS width, greatest(a.y + a.height, t.y + t.height) - least(a.y, t.y) AS height,
  least(a.confidence, t.confidence) AS confidence, a.language
FROM need_p a JOIN (SELECT scan_id FROM boxes_p WHERE n_regions > 1) USING (scan_id)
LEFT JOIN rowtext_p t ON t.scan_id = a.scan_id AND t.grp = a.grp""", "need_p", "rowtext_p", "boxes_p")
put("lay_6", "SELECT scan_id, grp AS anchor_key, val AS value, text, x, y, width, height FROM rowval_p WHERE val IS NOT NULL", "rowval_p")
block("all_heights", """SELECT scan_id, 'region_' || region_idx AS key, height::DOUBLE AS height FROM regions_p
UNION ALL SELECT scan_id, CASE field_name WHEN 'common_generic_name' THEN 'brand' ELSE field_name END, height::DOUBLE FROM fields_p
WHERE field_name IN ('mrp_value', 'net_quantity_value', 'common_generic_name')""", "regions_p", "fields_p")
put("lay_7", "SELECT * FROM all_heights", "all_heights")
put("lay_8", "SELECT scan_id, max(height) AS ref_height FROM all_heights GROUP BY 1", "all_heights")
put("lay_9", """SELECT scan_id, calibrated AS calibration_available, round(px_per_mm, 6) AS px_per_mm, round(area, 6) AS pdp_area_cm2,
  font_size_tier, round(mrp_height / px_per_mm, 6) AS mrp_height_mm FROM ready0""", "ready0")

# ---- extraction ------------------------------------------------------------------------------
for key, names in FIELD_KEYS.items():
    put(key, f"""SELECT scan_id, field_name, value, text AS raw_text_span, {BOX}, confidence AS ocr_confidence, language FROM fields_p
WHERE field_name IN ({', '.join(q(n) for n in names)})""", "fields_p")
put("fld_0", per_field(lambda n: f"{n}_found AS found, {n}_val AS value, {n}_src AS source", "wide_p"), "wide_p")
put("fld_10", f"""SELECT scan_id, field_name, value, text AS raw_text_span, {BOX}, confidence AS ocr_confidence, language FROM fields_p
WHERE field_name IN ('consumer_care_phone', 'consumer_care_email')
  AND scan_id NOT IN (SELECT scan_id FROM first_p WHERE grp = 'consumer_care')""", "fields_p", "first_p")
put("fld_12", "SELECT scan_id, " + ", ".join(f"{n}_val AS {n}" for n in K.DECLARATION_FIELDS) + " FROM wide_p", "wide_p")
put("fld_13", "SELECT scan_id, n_regions::BIGINT AS n_regions, image_quality_warning FROM ready0", "ready0")
put("fld_14", "SELECT scan_id, commodity_category, is_imported, is_perishable_category, is_medical_device FROM ready0", "ready0")

# ---- reconciliation --------------------------------------------------------------------------
put("mrg_1", per_field(lambda n: f"{n}_val AS value, {n}_conf AS ocr_confidence, {n}_found AS found", "passes"), "passes")
put("mrg_2", "SELECT scan_id, net_quantity_unit_val AS unit, commodity_category FROM passes", "passes")
put("mrg_3", per_field(lambda n: f"{n}_val AS value, {n}_raw AS raw_text_span, {n}_src AS source, {n}_note AS disagreement_note, "
                                 f"{n}_found AS found", "merged"), "merged")
put("mrg_4", "SELECT scan_id, is_imported, commodity_category FROM merged", "merged")
put("mrg_5", per_field(lambda n: f"{n}_src = 'ocr+vision' AS corroborated, {n}_note IS NOT NULL AS contested, {RS.low(n)} AS low_confidence, "
                                 f"{RS.check(n)} AS needs_manual_check", "merged"), "merged")

# ---- rules -----------------------------------------------------------------------------------
for rule in K.RULES:
    put(rule.lower().replace("-", "_"), RS.rule_select(rule), "ready_g")
put("rul_0", " UNION ALL ".join(f"SELECT scan_id, {q(n)} AS field_name, status, notes FROM (SELECT scan_id, "
                                f"{RS.pick(*RS.found_cases(n))} FROM merged)" for n in K.DECLARATION_FIELDS), "merged")
put("r7_t", f"SELECT scan_id, round(area, 6) AS area, {RS.BANDS} AS min_mm FROM ready0 WHERE calibrated", "ready0")
put("rul_all", "SELECT * FROM entire_results", "entire_results")

# ---- roll-ups --------------------------------------------------------------------------------
put("agg_1", "SELECT scan_id, p AS pass_count, f AS fail_count, n AS needs_verification_count, na AS not_applicable_count FROM rolled", "rolled")
put("agg_2", f"SELECT scan_id, {SCORE} AS compliance_score FROM rolled", "rolled")
put("agg_3", f"SELECT scan_id, {VERDICT} AS overall_status FROM rolled", "rolled")


def drawn(src):
    return f"""SELECT scan_id, {BOX}, worst AS worst_status,
  string_agg(rule_id, '/' ORDER BY rule_no) FILTER (WHERE status = worst) || ' ' || worst AS label
FROM (SELECT *, min(status) OVER (PARTITION BY scan_id, {BOX}) AS worst FROM {src}
      WHERE status IN ('PASS', 'FAIL') AND x IS NOT NULL) GROUP BY scan_id, {BOX}, worst"""


block("drawn", drawn("results"), "results")
put("agg_4", "SELECT * FROM drawn", "drawn")
put("agg_5", """SELECT scan_id, label, greatest(0, least(x, image_width_px - 1)) AS x1, greatest(0, least(y, image_height_px - 1)) AS y1,
  greatest(0, least(x + width, image_width_px)) AS x2, greatest(0, least(y + height, image_height_px)) AS y2
FROM drawn JOIN meta USING (scan_id)""", "drawn", "meta")
put("agg_6", "SELECT count(*) AS total_scans FROM scans", "scans")
put("agg_7", "SELECT overall_status, count(*) AS n FROM scans GROUP BY 1", "scans")
block("volume", f"""SELECT created_at::DATE AS day, count(*) AS n FROM scans WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 30 DAY GROUP BY 1""", "scans")
block("series", f"""SELECT g::DATE AS day, coalesce(n, 0) AS n FROM generate_series(DATE '{NOW[:10]}' - INTERVAL 29 DAY, DATE '{NOW[:10]}', INTERVAL 1 DAY) t(g)
LEFT JOIN volume v ON v.day = g::DATE""", "volume")
put("agg_8", "SELECT day::VARCHAR AS day, n FROM volume", "volume")
put("agg_9", "SELECT day::VARCHAR AS day, n FROM series", "series")
put("agg_10", """SELECT passed, failed, floor(100.0 * passed / nullif(passed + failed, 0) + 0.5)::INT AS clearance FROM (
  SELECT count(*) FILTER (WHERE overall_status = 'PASS') AS passed, count(*) FILTER (WHERE overall_status = 'FAIL') AS failed FROM scans)""", "scans")
put("agg_11", """SELECT overall_status, count(*) AS n, floor(100.0 * count(*) / (SELECT count(*) FROM scans) + 0.5)::INT AS share_pct,
  coalesce((SELECT sum(n) FROM volume), 0)::BIGINT AS trend_total, greatest(1, (SELECT max(n) FROM series))::BIGINT AS peak
FROM scans GROUP BY 1""", "scans", "volume", "series")
block("expected", "SELECT * FROM (VALUES " + ", ".join(f"({c}, {q(r)}, {q(s)})" for c, r, s in S.L.EXPECTED) + ") e(case_no, rule_id, expected)")
block("golden", """SELECT scan_id, rule_id, expected, status AS actual,
  CASE WHEN status IS NULL THEN 'MISSING' WHEN status = expected THEN 'OK' ELSE 'MISMATCH' END AS outcome
FROM meta JOIN expected USING (case_no) LEFT JOIN ready_results USING (scan_id, rule_id)""", "meta", "expected", "ready_results")
put("agg_12", "SELECT * FROM golden", "golden")
put("agg_12_summary", """SELECT count(*) FILTER (WHERE ok) AS labels_matched, count(*) AS labels
FROM (SELECT scan_id, bool_and(outcome = 'OK') AS ok FROM golden GROUP BY 1)""", "golden")
put("agg_13", """SELECT CASE WHEN compliance_score >= 80 THEN 'high' WHEN compliance_score >= 50 THEN 'mid' ELSE 'low' END AS band, count(*) AS n
FROM scans WHERE compliance_score IS NOT NULL GROUP BY 1""", "scans")

put("agg_days", """SELECT created_at::DATE::VARCHAR AS day, overall_status,
  CASE WHEN compliance_score >= 80 THEN 'high' WHEN compliance_score >= 50 THEN 'mid' WHEN compliance_score IS NOT NULL THEN 'low' END AS band,
  count(*) AS n FROM scans GROUP BY ALL""", "scans")

# ---- register --------------------------------------------------------------------------------
block("named", "SELECT s.*, p.name, coalesce(p.name, 'Unknown') AS product_name FROM scans s LEFT JOIN products p ON p.id = product_id", "scans", "products")
put("agg_dashboard", """SELECT 'total' AS part, 'scans' AS name, count(*) AS n FROM scans
UNION ALL SELECT 'status', overall_status, count(*) FROM scans GROUP BY 2
UNION ALL SELECT 'failure', product_name, id FROM (SELECT * FROM named WHERE overall_status = 'FAIL' ORDER BY created_at DESC, id DESC LIMIT 10)
UNION ALL SELECT 'trend', day::VARCHAR, n FROM series""", "scans", "named", "series")
put("qry_1", "SELECT id, product_name, overall_status FROM named", "named")
put("qry_2", "SELECT id, product_name FROM named WHERE name ILIKE '%B_lT%'", "named")
put("qry_3", "SELECT id, overall_status FROM scans WHERE overall_status = 'FAIL'", "scans")
put("qry_4", f"""SELECT id, {TS.format(c='created_at')} AS created_at FROM scans
WHERE created_at >= TIMESTAMP '1997-03-01' AND created_at < TIMESTAMP '1997-07-01'""", "scans")
block("registered", f"""SELECT s.* EXCLUDE (overall_status, compliance_score), {VERDICT} AS overall_status, {SCORE} AS compliance_score
FROM named s JOIN rolled ON scan_id = s.id""", "named", "rolled")
put("qry_5", f"""SELECT id, product_name, overall_status, compliance_score, {TS.format(c='created_at')} AS created_at, inspector_email FROM registered
WHERE name ILIKE '%ring%' AND overall_status = 'NEEDS_VERIFICATION' AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '2000-01-01'""", "registered")
put("qry_6", f"""SELECT id, product_name, overall_status, compliance_score, font_size_tier, {TS.format(c='created_at')} AS created_at,
  mrp_value_val AS mrp, rule_no, rule_id, status, extracted_value AS value, notes
FROM registered s JOIN results r ON r.scan_id = s.id JOIN base_p b ON b.scan_id = s.id WHERE s.id = 777""", "registered", "results", "base_p")
put("qry_7", f"""SELECT id, product_name, {TS.format(c='created_at')} AS created_at, compliance_score FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM named WHERE overall_status = 'FAIL') WHERE rn <= 10""", "named")
put("qry_8", """SELECT scan_id, rule_id, status, (row_number() OVER (PARTITION BY scan_id ORDER BY
  CASE status WHEN 'FAIL' THEN 0 WHEN 'NEEDS_VERIFICATION' THEN 1 WHEN 'PASS' THEN 2 ELSE 3 END, rule_no))::INT AS display_pos FROM results""", "results")

# ---- verification ----------------------------------------------------------------------------
put("ver_1", "SELECT request_id, scan_id, rule_id, code FROM coded", "coded")
put("ver_2", """SELECT scan_id, rule_id, request_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY ts, request_id) AS rn
FROM requests WHERE role = 'admin') WHERE rn = 1""", "requests")
_who = "'Manually verified as compliant by ' || email || ' on ' || strftime(ts, '%Y-%m-%d %H:%M') || ' UTC (automated result: NEEDS_VERIFICATION).'"
block("verified", f"""
SELECT r.scan_id, rule_no, r.rule_id, CASE WHEN email IS NULL THEN status ELSE 'PASS' END AS status,
  CASE WHEN email IS NOT NULL THEN 'NEEDS_VERIFICATION' END AS original_status, email AS verified_by,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 > 0 THEN strftime(ts, '.%f') ELSE '' END || '+00:00' AS verified_at,
  note AS verification_note, CASE WHEN email IS NULL THEN notes ELSE trim({_who} || CASE WHEN note IS NULL THEN '' ELSE ' Verifier''s note: ' || note END
    || ' ' || notes) END AS notes, x, y, width, height
FROM results r LEFT JOIN accepted a ON a.scan_id = r.scan_id AND a.rule_id = r.rule_id""", "results", "accepted")
put("ver_3", "SELECT scan_id, rule_id, status, original_status, verified_by, verified_at, verification_note, notes FROM verified", "verified")
put("ver_4", f"""SELECT scan_id, {VERDICT} AS overall_status, {SCORE} AS compliance_score FROM (
  SELECT scan_id, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAIL') AS f,
    count(*) FILTER (WHERE status = 'NEEDS_VERIFICATION') AS n FROM verified
  WHERE scan_id IN (SELECT scan_id FROM accepted) GROUP BY 1)""", "verified", "accepted")
put("ver_5", _audit, "accepted")
ORACLE["ver_3_compacted"] = ORACLE["ver_3"]
put("ver_6", """SELECT r.scan_id, r.rule_id, r.status FROM results r LEFT JOIN accepted a ON a.scan_id = r.scan_id AND a.rule_id = r.rule_id
WHERE a.scan_id IS NULL""", "results", "accepted")
block("redrawn", "SELECT * FROM verified WHERE scan_id IN (SELECT scan_id FROM accepted)", "verified", "accepted")
put("ver_6_redraw", drawn("redrawn"), "redrawn")

# ---- photo planning --------------------------------------------------------------------------
put("img_1", f"""SELECT image_id, least(width, height) >= 320 AND laplacian_variance >= 100 AS ok,
  CASE WHEN least(width, height) < 320 THEN {fill(K.REASON_TOO_SMALL, w='width', h='height', s='least(width, height)', min='320')}
    WHEN laplacian_variance < 100 THEN {q(K.REASON_BLURRY)} END AS reason, least(width, height) AS shorter_side_px FROM metrics""", "metrics")
block("capped", """SELECT image_id, f AS cap_factor, CASE WHEN f < 1 THEN trunc(width * f)::INT ELSE width END AS width,
  CASE WHEN f < 1 THEN trunc(height * f)::INT ELSE height END AS height
FROM (SELECT *, CASE WHEN greatest(width, height) > 2200 THEN 2200.0::DOUBLE / greatest(width, height) ELSE 1.0::DOUBLE END AS f FROM metrics)""", "metrics")
put("img_2", "SELECT image_id, round(cap_factor, 6) AS cap_factor, width AS capped_width, height AS capped_height FROM capped", "capped")
block("angles", """SELECT image_id, a FROM (SELECT image_id, degrees(atan2(dy::DOUBLE, dx::DOUBLE)) AS a FROM segments WHERE dx <> 0)
WHERE a > -45 AND a < 45""", "segments")
block("skew", """SELECT image_id, n_lines, n_agree, CASE WHEN n_lines >= 8 AND n_agree / n_lines >= 0.6 THEN med ELSE 0.0 END AS angle FROM (
  SELECT a.image_id, count(*) AS n_lines, any_value(med) AS med, count(*) FILTER (WHERE abs(a - med) <= 1) AS n_agree
  FROM angles a JOIN (SELECT image_id, median(a) AS med FROM angles GROUP BY 1) USING (image_id) GROUP BY 1)""", "angles")
put("img_3", """SELECT image_id, n_lines, n_agree::BIGINT AS n_agree, round(angle, 6) AS angle,
  round(CASE WHEN abs(angle) >= 0.5 THEN angle ELSE 0.0 END, 6) AS rotation FROM skew""", "skew")


def upscale(src):
    return f"""SELECT image_id, med AS median_height, CASE WHEN med IS NULL OR med >= 25 THEN 1.0::DOUBLE
    WHEN greatest(width, height) * least(3.0, 25.0 / greatest(med, 1.0)) > 3200 THEN 3200.0::DOUBLE / greatest(width, height)
    ELSE least(3.0::DOUBLE, 25.0::DOUBLE / greatest(med, 1.0)) END AS upscale_factor
  FROM {src} LEFT JOIN (SELECT image_id, median(h)::DOUBLE AS med FROM heights JOIN {src} USING (image_id)
    WHERE h > 3 AND h < height * 0.3::DOUBLE GROUP BY 1) USING (image_id)"""


put("img_4", f"SELECT image_id, median_height, round(upscale_factor, 6) AS upscale_factor FROM ({upscale('metrics')})", "metrics", "heights")
put("img_5", f"""SELECT image_id, concat_ws(' > ', CASE WHEN cap_factor < 1 THEN 'resolution_cap(x' || printf('%.3f', cap_factor) || ')' END,
  CASE WHEN abs(angle) >= 0.5 THEN 'deskew(' || printf('%.1f', angle) || ' deg)' END, 'clahe_contrast',
  CASE WHEN upscale_factor > 1 THEN 'upscale(x' || printf('%.2f', upscale_factor) || ')' END) AS stages
FROM capped JOIN ({upscale('capped')}) USING (image_id) LEFT JOIN skew USING (image_id)""", "capped", "heights", "skew")

# ---- streams and extension points ------------------------------------------------------------
SPAN, LIMIT = LIMITER["window_seconds"] * 1_000_000, LIMITER["limit"]
block("queue", "SELECT *, row_number() OVER (PARTITION BY identity ORDER BY t, arrival_id) AS rn FROM arrivals", "arrivals")
block("gate", f"""RECURSIVE
SELECT identity, rn, arrival_id, [t] AS kept, true AS admitted, 0::BIGINT AS retry_after FROM queue WHERE rn = 1
UNION ALL
SELECT identity, rn, arrival_id, CASE WHEN len(live) < {LIMIT} THEN list_append(live, t) ELSE live END, len(live) < {LIMIT},
  CASE WHEN len(live) < {LIMIT} THEN 0 ELSE greatest(1, ({SPAN} - (t - live[1])) // 1000000) END
FROM (SELECT a.identity, a.rn, a.arrival_id, a.t, list_filter(g.kept, lambda k: k > a.t - {SPAN}) AS live
      FROM gate g JOIN queue a ON a.identity = g.identity AND a.rn = g.rn + 1)""", "queue")
put("str_1", "SELECT arrival_id, identity, admitted, retry_after FROM gate", "gate")
block("gate_default", S.BLOCK["gate"][1].replace("gate", "gate_default").replace(str(SPAN), "60000000")
      .replace(f"< {LIMIT} ", "< 12 ").replace(f"< {LIMIT},", "< 12,"), "queue")
put("str_1_default", "SELECT arrival_id, identity, admitted, retry_after FROM gate_default", "gate_default")
put("str_1_stream", "SELECT arrival_id, identity, admitted, retry_after FROM gate", "gate")
block("entire_rolled", """SELECT scan_id, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAIL') AS f,
  count(*) FILTER (WHERE status = 'NEEDS_VERIFICATION') AS n FROM entire_results GROUP BY 1""", "entire_results")
put("str_2", f"""SELECT scan_id, {VERDICT} AS overall_status, {SCORE} AS compliance_score, font_size_tier
FROM entire_rolled JOIN entire0 USING (scan_id)""", "entire_rolled", "entire0")
block("ext_results", """SELECT scan_id, status FROM ready_results UNION ALL
SELECT scan_id, CASE WHEN commodity_category = 'liquid' THEN 'NOT_APPLICABLE' WHEN consumer_care_phone_found THEN 'PASS' ELSE 'FAIL' END FROM ready0""",
      "ready_results", "ready0")
put("ext_1", f"""SELECT scan_id, p AS pass_count, f AS fail_count, n AS needs_verification_count, na AS not_applicable_count,
  {SCORE} AS compliance_score, {VERDICT} AS overall_status FROM (
  SELECT scan_id, count(*) FILTER (WHERE status = 'PASS') AS p, count(*) FILTER (WHERE status = 'FAIL') AS f,
  count(*) FILTER (WHERE status = 'NEEDS_VERIFICATION') AS n, count(*) FILTER (WHERE status = 'NOT_APPLICABLE') AS na
  FROM ext_results GROUP BY 1)""", "ext_results")
S.anchor_blocks("p", S.TERMS + [(g, t) for g, _, t in EXTRA_TERMS], "_x")
put("ext_2", "SELECT scan_id, grp, region_idx FROM first_p_x", "first_p_x")
put("flagship", f"SELECT status AS overall_status, count(*) AS n FROM ({RS.rule_select('R6-7')}) GROUP BY 1", "ready_g")
