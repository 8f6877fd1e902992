"""Building blocks of the DuckDB oracle: each block is a named CTE with the blocks it needs.

The SQL takes other routes than the Spark plans where there is one: consuming guards instead of
lookarounds, edit distance over text windows instead of compiled neighbourhoods, running sums over
one window instead of bucket summaries, recursive walks instead of folds.
"""

from __future__ import annotations

import re

from cartonscope import constants as K
from cartonscope.plans import label_templates as L

W = r"\p{L}\p{N}_"
SP = r"[\s\p{Z}]"
BLOCKS = "A-Za-zऀ-ॿ઀-૿"
NUM = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
LOOSE = r"(?:\+?91[-\s\p{Z}]?)?\p{Nd}[\p{Nd}\-\s\p{Z}]{8,13}\p{Nd}"
STRICT = r"(?:\+?91[-\s\p{Z}]?)?(?:1800[-\s\p{Z}]?\p{Nd}{3}[-\s\p{Z}]?\p{Nd}{3,4}|[6-9]\p{Nd}{9})"
RULE_IDS = list(K.RULES)


def q(s) -> str:
    """SQL literal."""
    if s is None:
        return "NULL"
    if isinstance(s, bool):
        return "true" if s else "false"
    if isinstance(s, (int, float)):
        return str(s)
    return "'" + s.replace("'", "''") + "'"


def rx(c, pattern, group=1):
    return f"nullif(regexp_extract({c}, {q(pattern)}, {group}), '')"


def norm(c): return f"translate({c}, {q(K.INDIC_DIGITS)}, {q(K.ASCII_DIGITS)})"
def noise(c): return f"regexp_replace({c}, {q(rf'(^|[^{W}])mi($|[^{W}])')}, {q(chr(92) + '1ml' + chr(92) + '2')}, 'gi')"
def price(c): return rx(c, rf"(?i)(?:rs\.?|₹|inr){SP}*({NUM})")
def bare(c): return rx(c, f"({NUM})")
QTY = rf"(?i)(?:^|[^{W}])({NUM}){SP}*({'|'.join(K.QUANTITY_UNITS)})(?:$|[^{W}])"
def qty(c): return rx(noise(norm(c)), QTY, 1)
def unit(c): return f"lower({rx(noise(norm(c)), QTY, 2)})"
DATE = r"(\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}|[A-Za-z]{3,9}[\s\p{Z}]?\p{Nd}{4}|\p{Nd}{1,2}[/-]\p{Nd}{2,4})"
def date(c): return rx(c, DATE)
def loose(c): return rx(c, LOOSE, 0)
def strict(c): return rx(c, rf"({STRICT})(?:$|[^{W}])")
def email(c): return rx(c, rf"[{W}.+-]+@[{W}-]+\.[{W}.-]+", 0)
def strip(c): return f"regexp_replace({c}, {q(f'^{SP}+|{SP}+$')}, '', 'g')"


def refnum(c, shape):
    word = (rf"(?i)(?:^|[^{W}])(?:lic|licen[cs]e|fssai|reg|regd|registration|batch|lot|gstin|gst)(?:$|[^{W}])")
    lead = rf"(?i)(?:^|[^{W}])no\.?{SP}*,?{SP}*$"
    tail = "" if shape is LOOSE else rf"(?:$|[^{W}])"
    before = f"regexp_extract({c}, {q(rf'(?s)^(.*?)(?:{shape}){tail}')}, 1)"
    return f"(regexp_matches({c}, {q(word)}) OR regexp_matches({before}, {q(lead)}))"


def category(u, prior="NULL"):
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.UNIT_CATEGORY.items())
    return f"coalesce(CASE lower({u}) {cases} END, {prior})"


def canon(c): return f"lower(regexp_replace({norm(c)}, {q(f'[^{W}]')}, '', 'g'))"
def agree(a, b): return (f"coalesce({canon(a)} <> '' AND {canon(b)} <> '' AND (contains({canon(a)}, {canon(b)}) "
                         f"OR contains({canon(b)}, {canon(a)})), false)")
def quoted(c): return (f"CASE WHEN contains({c}, '''') AND NOT contains({c}, '\"') THEN '\"' || {c} || '\"' "
                       f"ELSE '''' || replace({c}, '''', chr(92) || '''') || '''' END")


def fill(template, **values):
    out = q(template)
    for name, v in values.items():
        out = f"replace({out}, '{{{name}}}', ({v})::VARCHAR)"
    return out


BLOCK: dict[str, tuple[list[str], str]] = {}


def block(name, sql, *needs):
    BLOCK[name] = (list(needs), sql)


def compose(final: str, *needs: str) -> str:
    """WITH clause holding ``needs`` and everything below them, then ``final``."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in BLOCK[n][0]:
            visit(d)
        order.append(n)
    for n in needs:
        visit(n)
    ctes = []
    for n in order:
        head = n if not BLOCK[n][1].lstrip().startswith("RECURSIVE") else n
        body = BLOCK[n][1].lstrip()
        if body.startswith("RECURSIVE"):
            ctes.append(f"{head} AS ({body[len('RECURSIVE'):]})")
        else:
            ctes.append(f"{head} AS MATERIALIZED ({body})")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


# ---- derived label tables --------------------------------------------------------------------
block("label_base", """
SELECT o_orderkey AS scan_id, (o_orderkey % 24)::INT AS case_no, coalesce(p_name, 'plain carton') AS name,
  coalesce(replace(s_name, '#', ' '), 'Unlisted Maker') AS maker, coalesce(replace(n_name, '_', ' '), 'NATION X') AS nation,
  (coalesce(p_size, 9) * 5)::VARCHAR AS qty,
  (paise // 100)::VARCHAR || '.' || lpad((paise % 100)::VARCHAR, 2, '0') AS price,
  strftime(o_orderdate, '%m/%Y') AS month, strftime(o_orderdate, '%d/%m/%y') AS date,
  '1800-' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') || '-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS phone,
  lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS digits5
FROM (SELECT *, coalesce(round(p_retailprice * 100)::BIGINT, 9950) AS paise
      FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk, min(l_suppkey) AS sk FROM lineitem GROUP BY 1)
        ON l_orderkey = o_orderkey
      LEFT JOIN part ON p_partkey = pk LEFT JOIN supplier ON s_suppkey = sk
      LEFT JOIN nation ON n_nationkey = s_nationkey)""")
block("template", "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(q(v) for v in r) + ")" for r in L.TEMPLATE) + ") t(case_no, region_idx, tpl, tx, ty, width, height)")
_slots = "tpl"
for _s in ("name", "maker", "nation", "qty", "price", "month", "date", "phone", "digits5"):
    _slots = f"replace({_slots}, '{{{_s}}}', {_s})"
block("regions_p", f"""
SELECT scan_id, 'p' AS reader, region_idx, {_slots} AS text, (tx + scan_id % 7)::INT AS x, (ty + scan_id % 5)::INT AS y,
  width, height, CASE WHEN case_no < 12 THEN 92.0::DOUBLE ELSE (40 + (scan_id * 17 + region_idx * 13) % 60)::DOUBLE END AS confidence,
  'eng' AS language FROM label_base JOIN template USING (case_no)""", "label_base", "template")
block("regions_s", """
SELECT scan_id, 's' AS reader, region_idx,
  CASE (scan_id + region_idx) % 7 WHEN 1 THEN replace(text, ' Rs. ', ' Rs ') WHEN 3 THEN replace(text, ' g', ' kg')
    WHEN 5 THEN replace(text, 'Packed on', 'Pkd') ELSE text END AS text,
  x, y, width, height, ((scan_id * 17 + region_idx * 29) % 101)::DOUBLE AS confidence, language
FROM regions_p WHERE (scan_id + region_idx * 3) % 10 <> 0""", "regions_p")
_meta = ", ".join("(" + ", ".join(q(v) if v is not None else "NULL" for v in (c, *L.CATALOGUE[c], *L.image_size(c))) + ")"
                  for c in range(L.CASES))
block("meta", f"""
SELECT o_orderkey AS scan_id, case_no, commodity_category::VARCHAR AS commodity_category, is_imported::BOOLEAN AS is_imported,
  is_perishable_category::BOOLEAN AS is_perishable_category, is_medical_device::BOOLEAN AS is_medical_device,
  multipiece::BOOLEAN AS is_combination_or_multipiece_package, image_width_px, image_height_px,
  CASE WHEN case_no >= 12 AND (o_orderkey // 24) % 2 = 0 THEN (40 + o_orderkey % 200)::DOUBLE END AS reference_width_mm,
  CASE WHEN case_no >= 12 AND (o_orderkey // 24) % 2 = 0 THEN (30 + o_orderkey % 310)::DOUBLE END AS reference_height_mm
FROM orders JOIN (SELECT * FROM (VALUES {_meta}) c(case_no, commodity_category, is_imported, is_perishable_category,
  is_medical_device, multipiece, image_width_px, image_height_px)) ON case_no = o_orderkey % 24""")
block("words", """
SELECT scan_id, reader, (region_idx * 100 + pos)::INT AS word_idx,
  CASE WHEN (scan_id + pos) % 17 = 0 THEN '  ' ELSE ' ' || word END AS text,
  CASE WHEN (scan_id + pos) % 13 = 5 THEN '-1' WHEN (scan_id + pos) % 13 = 7 THEN 'n/a'
    ELSE (30 + (scan_id * 3 + pos * 11 + region_idx) % 70)::VARCHAR END AS conf,
  (x + length(array_to_string(ws[1:pos], ' ')) * 10 + pos * ((scan_id + region_idx) % 9) * 8)::INT AS "left",
  (y + (pos * 7 + scan_id) % 11 - 5)::INT AS top, (length(word) * 10)::INT AS width, (height + pos % 3)::INT AS height
FROM (SELECT *, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS word
      FROM (SELECT *, string_split(text, ' ') AS ws FROM regions_p))""", "regions_p")
block("clean_words", rf"""
SELECT scan_id, reader, word_idx, {strip('text')} AS text, coalesce(try_cast(conf AS DOUBLE), -1.0) AS confidence,
  "left" AS x, top AS y, width, height FROM words
WHERE {strip('text')} <> '' AND coalesce(try_cast(conf AS DOUBLE), -1.0) >= 0""", "words")
_json = [
    """'"manufacturer_name": "' || CASE scan_id % 3 WHEN 0 THEN 'Manufactured by ' || maker WHEN 1 THEN maker ELSE ' Null ' END || '"'""",
    """'"manufacturer_address": "' || CASE scan_id % 2 WHEN 0 THEN nation ELSE 'not printed' END || '"'""",
    """CASE scan_id % 5 WHEN 0 THEN '"country_of_origin": "Product of ' || nation || '"' ELSE '"country_of_origin": null' END""",
    """'"common_generic_name": "' || CASE scan_id % 4 WHEN 0 THEN 'Snack' ELSE upper(name) END || '"'""",
    """CASE scan_id % 7 WHEN 0 THEN '"net_quantity_value": ' || qty ELSE '"net_quantity_value": "' || qty || '"' END""",
    """'"net_quantity_unit": "' || CASE scan_id % 6 WHEN 0 THEN 'ml' WHEN 1 THEN 'KG' WHEN 2 THEN 'bunch' ELSE 'g' END || '"'""",
    """'"mfg_month_year": "' || CASE scan_id % 8 WHEN 0 THEN 'N/A' ELSE month END || '"'""",
    """'"mrp_value": "' || CASE scan_id % 9 WHEN 0 THEN '25.00' ELSE price END || '"'""",
    """'"mrp_inclusive_of_taxes_stated": "yes"'""",
    """'"consumer_care_phone": "' || phone || '"'""",
    """'"unit_sale_price": "' || CASE scan_id % 10 WHEN 0 THEN '  Rs. 0.62/g ' ELSE '' END || '"'"""]
block("answers", f"""
SELECT scan_id, CASE WHEN scan_id % 11 = 0 THEN substr(whole, 1, 40) WHEN scan_id % 37 = 1 THEN '["not", "an object"]' ELSE whole END AS body
FROM (SELECT scan_id, '{{' || {" || ', ' || ".join(_json)} || '}}' AS whole FROM label_base WHERE scan_id % 13 <> 12)""", "label_base")
block("scans", f"""
SELECT o_orderkey AS id, pk AS product_id, 'inspector' || o_custkey || '@example.org' AS inspector_email,
  CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'NEEDS_VERIFICATION' ELSE 'PASS' END AS overall_status,
  CASE WHEN o_orderkey % 50 <> 0 THEN ((o_orderkey * 37) % 1001)::DOUBLE / 10 END AS compliance_score,
  CASE WHEN o_orderkey % 3 = 0 THEN 'tier2' ELSE 'tier1' END AS font_size_tier, {q(K.RULESET_VERSION)} AS ruleset_version,
  o_orderdate::TIMESTAMP + to_seconds(o_orderkey % 86400) AS created_at
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
block("products", "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category FROM part")
block("users", """SELECT c_custkey AS id, 'inspector' || c_custkey || '@example.org' AS email,
  CASE WHEN c_custkey % 20 = 0 THEN 'admin' ELSE 'inspector' END AS role FROM customer""")
block("rules_list", "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {q(r)}, {q(K.RULES[r][0])}, {q(K.RULES[r][1])})" for i, r in enumerate(RULE_IDS)) +
    ") r(rule_no, rule_id, rule_reference, requirement_text)")
block("results", """
SELECT o_orderkey AS scan_id, rule_no, rule_id, rule_reference, requirement_text,
  ['FAIL', 'NEEDS_VERIFICATION', 'PASS', 'NOT_APPLICABLE'][((o_orderkey * 7 + rule_no * (o_orderkey % 3 + 1)) % 4 + 1)::INT] AS status,
  CASE WHEN (o_orderkey + rule_no) % 4 <> 0 THEN 'v' || rule_no END AS extracted_value,
  CASE WHEN (o_orderkey + rule_no) % 6 <> 0 THEN (((o_orderkey * 3 + rule_no) % 5) * 140 - 20)::INT END AS x,
  CASE WHEN (o_orderkey + rule_no) % 6 <> 0 THEN (((o_orderkey * 3 + rule_no) % 5) * 55 + o_orderkey % 9)::INT END AS y,
  CASE WHEN (o_orderkey + rule_no) % 6 <> 0 THEN (120 + ((o_orderkey * 3 + rule_no) % 5) * 10)::INT END AS width,
  CASE WHEN (o_orderkey + rule_no) % 6 <> 0 THEN 20 END AS height,
  CASE WHEN (o_orderkey + rule_no) % 3 = 0 THEN '' ELSE 'note ' || rule_no END AS notes
FROM orders, rules_list""", "rules_list")
block("requests", f"""
SELECT event_id AS request_id, ts, ((event_id // 2) * 7919) % (SELECT max(o_orderkey) * 21 // 20 FROM orders) AS scan_id,
  [{', '.join(q(r) for r in RULE_IDS + ['R6-8', 'R9-9'])}][((event_id // 2) % 16 + 1)::INT] AS rule_id,
  'user' || user_id || '@example.org' AS email, CASE WHEN user_id % 3 = 2 THEN 'inspector' ELSE 'admin' END AS role,
  CASE event_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN ' checked ' || event_id END AS note FROM events""")
block("arrivals", """
SELECT event_id AS arrival_id, ts, CASE WHEN user_id % 5 <> 0 THEN 'user:user' || user_id || '@example.org'
  WHEN user_id % 10 <> 0 THEN 'ip:10.0.0.' || user_id ELSE 'ip:unknown' END AS identity, epoch_us(ts) AS t FROM events""")
block("uploads", """
SELECT doc_id AS upload_id, 'photo' || doc_id || ['.jpg', '.JPEG', '.png', '.webp', '.bmp', '.tif', '.tiff', '.gif', '', '.pdf', '.v2.jpg'][(doc_id % 11 + 1)::INT] AS filename,
  [NULL, 'image/jpeg', 'image/png', 'text/html', '', 'image/webp', 'image/gif'][((doc_id // 11) % 7 + 1)::INT] AS content_type,
  CASE WHEN doc_id % 29 = 0 THEN 0 ELSE n_chars * 4096 END AS length FROM documents""")
block("lines", """
SELECT 'd' || doc_id AS src, (generate_subscripts(ls, 1) - 1)::INT AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
UNION ALL SELECT 's' || scan_id, region_idx, text FROM regions_p""", "regions_p")
block("metrics", """
SELECT image_id, (200 + (q * 7) % 3300)::INT AS width, (240 + (q * 11 + n * 97) % 2900)::INT AS height,
  (q % 173 + n * 4)::DOUBLE AS laplacian_variance
FROM (SELECT l_partkey AS image_id, sum(l_quantity::BIGINT)::BIGINT AS q, count(*) AS n FROM lineitem GROUP BY 1)""")
block("segments", """
SELECT image_id, dx, (floor(dx * (image_id % 9) / 50.0)::BIGINT + wobble) AS dy FROM (
  SELECT l_partkey AS image_id, CASE WHEN l_partkey % 17 = 3 THEN -(l_quantity::BIGINT) * 5 ELSE l_quantity::BIGINT * 13 % 400 END AS dx,
    CASE WHEN (l_linenumber + l_quantity::BIGINT) % (2 + l_partkey % 6) = 0 THEN 40 + l_quantity::BIGINT ELSE 0 END AS wobble
  FROM lineitem)""")
block("heights", "SELECT l_partkey AS image_id, ((l_quantity::BIGINT * (1 + l_partkey % 4)) % 97)::INT AS h FROM lineitem")

# ---- anchors ---------------------------------------------------------------------------------
block("anchors", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(g)}, {q(lang)}, {q(t)})" for g, langs in K.ANCHOR_TERMS.items() for lang, ts in langs.items() for t in ts) +
    ") a(grp, lang, term)")


TERMS = [(g, t) for g, langs in K.ANCHOR_TERMS.items() for ts in langs.values() for t in ts]


def anchor_blocks(reader: str, terms: list[tuple[str, str]] = TERMS, suffix: str = "") -> None:
    """exact / fuzzy / stray hits per (text, term), then per box, for one reader's boxes."""
    s = f"_{reader}{suffix}"
    block(f"texts{s}", f"SELECT DISTINCT text, lower(text) AS low FROM regions_{reader}", f"regions_{reader}")

    # a hit needs the term itself as a substring; the guards are then tested by pattern
    def guarded(left, right, chosen):
        return " UNION ALL ".join(
            f"SELECT text, {q(g)} AS grp, {q(t)} AS term FROM texts{s} WHERE contains(low, {q(t)}) "
            f"AND regexp_matches(low, {q(left + re.escape(t) + right)})" for g, t in chosen)
    letter = r"\p{L}"
    block(f"exact{s}", guarded(f"(?:^|[^{BLOCKS}])", f"(?:$|[^{BLOCKS}])", terms), f"texts{s}")
    block(f"stray{s}", guarded(f"(?:^|[^{letter}]|(?:^|[^{letter}]){letter})", f"(?:$|[^{letter}]|{letter}(?:$|[^{letter}]))",
                               [(g, t) for g, t in terms if len(t) >= 5]), f"texts{s}")
    # one edit leaves a half of the term intact, which pins the window's start or its end
    long = " UNION ALL ".join(
        f"SELECT text, low, {q(g)} AS grp, {q(t)} AS term, {q(t[:len(t) // 2])} AS h1, {q(t[len(t) // 2:])} AS h2 FROM texts{s} "
        f"WHERE contains(low, {q(t[:len(t) // 2])}) OR contains(low, {q(t[len(t) // 2:])})" for g, t in terms if len(t) >= 10)
    block(f"fuzzy{s}", f"""
SELECT DISTINCT text, grp, term FROM (
  SELECT *, start + length(term) + d AS stop FROM (
    SELECT *, unnest(range(1, length(low) + 1)) AS start FROM ({long})), (VALUES (-1), (0), (1)) w(d))
WHERE stop <= length(low) + 1 AND CASE
  WHEN substr(low, start, length(h1)) <> h1 AND substr(low, stop - length(h2), length(h2)) <> h2 THEN false
  ELSE levenshtein(substr(low, start, stop - start), term) <= 1
    AND NOT (start > 1 AND regexp_matches(substr(low, start - 1, 1), '{letter}'))
    AND NOT regexp_matches(substr(low, stop, 1), '{letter}') END""", f"texts{s}")
    block(f"tiers{s}", f"""
SELECT text, grp, CASE min(k) WHEN 1 THEN 'exact' WHEN 2 THEN 'fuzzy' ELSE 'stray' END AS tier FROM (
  SELECT text, grp, 1 AS k FROM exact{s} UNION ALL SELECT text, grp, 2 FROM fuzzy{s} UNION ALL SELECT text, grp, 3 FROM stray{s})
GROUP BY text, grp""", f"exact{s}", f"fuzzy{s}", f"stray{s}")
    block(f"matches{s}", f"SELECT scan_id, region_idx, grp, tier FROM regions_{reader} JOIN tiers{s} USING (text)",
          f"regions_{reader}", f"tiers{s}")
    block(f"first{s}", f"""
SELECT m.scan_id, m.grp, r.region_idx, r.text, r.x, r.y, r.width, r.height, r.confidence, r.language
FROM (SELECT scan_id, grp, min(region_idx) AS region_idx FROM matches{s} GROUP BY 1, 2) m
JOIN regions_{reader} r ON r.scan_id = m.scan_id AND r.region_idx = m.region_idx""", f"matches{s}", f"regions_{reader}")


# ---- extraction ------------------------------------------------------------------------------
BOXC = "text, x, y, width, height, confidence, language"


def row_match(key, c):
    return (f"CASE {key} WHEN 'mrp' THEN {price(norm(c))} WHEN 'net_qty' THEN {qty(c)} ELSE {date(norm(c))} END")


def own_match(key, c):
    return (f"CASE {key} WHEN 'mrp' THEN coalesce({price(norm(c))}, {bare(norm(c))}) WHEN 'net_qty' THEN {qty(c)} "
            f"ELSE {date(norm(c))} END")


def extraction_blocks(reader: str) -> None:
    s = f"_{reader}"
    anchor_blocks(reader)
    block(f"need{s}", f"""
SELECT * FROM first{s} WHERE grp IN ('mrp', 'net_qty', 'mfg_date', 'best_before') AND {own_match('grp', 'text')} IS NULL""", f"first{s}")
    block(f"companions{s}", f"""
SELECT * FROM (SELECT *, sum(brk) OVER (PARTITION BY scan_id, grp ORDER BY x, region_idx) AS breaks FROM (
  SELECT r.*, a.grp, a.text AS a_text, a.x AS a_x, a.y AS a_y, a.width AS a_width, a.height AS a_height, a.confidence AS a_conf,
    CASE WHEN r.x - coalesce(lag(r.x + r.width) OVER (PARTITION BY a.scan_id, a.grp ORDER BY r.x, r.region_idx), a.x + a.width)
      > a.height * 8.0 THEN 1 ELSE 0 END AS brk
  FROM need{s} a JOIN regions_{reader} r ON r.scan_id = a.scan_id AND r.region_idx <> a.region_idx
  WHERE a.height > 0 AND r.x >= a.x + a.width
    AND r.y + r.height / 2.0 BETWEEN a.y - a.height * 0.5 AND a.y + a.height + a.height * 0.5)) WHERE breaks = 0""",
          f"need{s}", f"regions_{reader}")
    block(f"rowtext{s}", f"""
SELECT scan_id, grp, any_value(a_text) AS a_text, string_agg(text, ' ' ORDER BY x, region_idx) AS c_text, min(x) AS x, min(y) AS y,
  (max(x + width) - min(x))::INT AS width, (max(y + height) - min(y))::INT AS height, min(confidence) AS confidence,
  arg_min(language, x * 1000000 + region_idx) AS language
FROM companions{s} GROUP BY 1, 2""", f"companions{s}")
    block(f"near{s}", f"""
SELECT scan_id, grp, val, {BOXC} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, grp
    ORDER BY abs((y + height / 2.0) - (a_y + a_height / 2.0)), x, region_idx) AS rn
  FROM (SELECT *, {row_match('grp', 'text')} AS val FROM companions{s}) WHERE val IS NOT NULL) WHERE rn = 1""", f"companions{s}")
    block(f"rowval{s}", f"""
SELECT * FROM near{s} UNION ALL
SELECT scan_id, grp, CASE WHEN grp = 'net_qty' THEN {qty('c_text')} ELSE {row_match('grp', "a_text || ' ' || c_text")} END AS val,
  c_text AS text, x, y, width, height, confidence, language
FROM rowtext{s} t WHERE NOT EXISTS (SELECT 1 FROM near{s} n WHERE n.scan_id = t.scan_id AND n.grp = t.grp)
  AND {row_match('grp', "a_text || ' ' || c_text")} IS NOT NULL""", f"near{s}", f"rowtext{s}")
    block(f"valued{s}", f"""
SELECT scan_id, grp, {own_match('grp', 'text')} AS val, {BOXC} FROM first{s}
WHERE grp IN ('mrp', 'net_qty', 'mfg_date', 'best_before') AND {own_match('grp', 'text')} IS NOT NULL
UNION ALL SELECT scan_id, grp, val, {BOXC} FROM rowval{s} WHERE val IS NOT NULL""", f"first{s}", f"rowval{s}")
    block(f"qtyat{s}", f"""
SELECT scan_id, {BOXC} FROM valued{s} WHERE grp = 'net_qty' UNION ALL
SELECT scan_id, {BOXC} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY region_idx) AS rn FROM regions_{reader} r
  WHERE {qty('text')} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM first{s} f WHERE f.scan_id = r.scan_id AND f.grp = 'net_qty')) WHERE rn = 1""",
          f"valued{s}", f"first{s}", f"regions_{reader}")
    block(f"nocare{s}", f"""
SELECT r.* FROM regions_{reader} r WHERE NOT EXISTS (SELECT 1 FROM first{s} f WHERE f.scan_id = r.scan_id AND f.grp = 'consumer_care')""",
          f"first{s}", f"regions_{reader}")

    def one(field, value, src, cond="true"):
        return f"SELECT scan_id, {q(field)} AS field_name, {value} AS value, {BOXC} FROM {src} WHERE {cond}"
    f = f"first{s}"
    st = strip("text")
    care = f"grp = 'consumer_care'"
    parts = [
        one("manufacturer_name", st, f, "grp = 'manufacturer'"), one("manufacturer_address", st, f, "grp = 'manufacturer'"),
        one("country_of_origin", st, f, "grp = 'country_of_origin'"),
        one("common_generic_name", st, f"""(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY height DESC, region_idx) AS rn
          FROM regions_{reader} r WHERE NOT EXISTS (SELECT 1 FROM tiers{s} t WHERE t.text = r.text))""", "rn = 1"),
        one("net_quantity_value", qty("text"), f"qtyat{s}", f"{qty('text')} IS NOT NULL"),
        one("net_quantity_unit", unit("text"), f"qtyat{s}", f"{qty('text')} IS NOT NULL"),
        one("mfg_month_year", "val", f"valued{s}", "grp = 'mfg_date'"),
        one("best_before_use_by", "val", f"valued{s}", "grp = 'best_before'"),
        one("best_before_use_by", st, f"{f} a", f"grp = 'best_before' AND NOT EXISTS (SELECT 1 FROM valued{s} v WHERE v.scan_id = a.scan_id AND v.grp = 'best_before')"),
        one("mrp_value", "val", f"valued{s}", "grp = 'mrp'"),
        one("mrp_inclusive_of_taxes_stated", "'yes'", f, "grp = 'tax_inclusive'"),
        one("consumer_care_name", st, f, care), one("consumer_care_address", st, f, care),
        one("consumer_care_phone", loose("text"), f, f"{care} AND {loose('text')} IS NOT NULL AND NOT {refnum('text', LOOSE)}"),
        one("consumer_care_email", email("text"), f, f"{care} AND {email('text')} IS NOT NULL"),
        one("consumer_care_phone", strict("text"), f"""(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY region_idx) AS rn FROM nocare{s}
          WHERE {strict('text')} IS NOT NULL AND NOT {refnum('text', STRICT)})""", "rn = 1"),
        one("consumer_care_email", email("text"), f"""(SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY region_idx) AS rn FROM nocare{s}
          WHERE {email('text')} IS NOT NULL)""", "rn = 1"),
        one("unit_sale_price", f"coalesce({price(norm('text'))}, {bare(norm('text'))})", f,
            f"grp = 'unit_sale_price' AND coalesce({price(norm('text'))}, {bare(norm('text'))}) IS NOT NULL")]
    block(f"fields{s}", "\nUNION ALL ".join(parts), f"first{s}", f"valued{s}", f"qtyat{s}", f"nocare{s}", f"tiers{s}", f"regions_{reader}")
    cols = []
    for n in K.DECLARATION_FIELDS:
        w = f"FILTER (WHERE field_name = {q(n)})"
        cols += [f"any_value(value) {w} AS {n}_val", f"any_value(text) {w} AS {n}_raw",
                 *[f"any_value({c}) {w} AS {n}_{a}" for c, a in (("x", "x"), ("y", "y"), ("width", "w"), ("height", "h"),
                                                               ("confidence", "conf"), ("language", "lang"))],
                 f"coalesce(bool_or(true) {w}, false) AS {n}_found", f"'ocr' AS {n}_src", f"NULL::VARCHAR AS {n}_note"]
    block(f"boxes{s}", f"SELECT scan_id, count(*) AS n_regions, max(height) AS tallest FROM regions_{reader} GROUP BY 1", f"regions_{reader}")
    block(f"wide{s}", f"""
SELECT w.*, {category('net_quantity_unit_val')} AS commodity_category, n_regions,
  CASE WHEN EXISTS (SELECT 1 FROM first{s} f WHERE f.scan_id = w.scan_id AND grp = 'best_before') THEN true END AS is_perishable_category,
  CASE WHEN country_of_origin_found THEN true END AS is_imported,
  mrp_value_h::DOUBLE AS mrp_height, net_quantity_value_h::DOUBLE AS quantity_height,
  greatest(tallest, mrp_value_h, net_quantity_value_h)::DOUBLE AS ref_height,
  CASE WHEN NOT ({' OR '.join(f'{n}_found' for n in K.QUALITY_FIELDS)}) AND n_regions < 4
    THEN {fill(K.WARNING_FEW_REGIONS, n='n_regions')} END AS image_quality_warning
FROM (SELECT b.scan_id, any_value(n_regions) AS n_regions, any_value(tallest) AS tallest, {', '.join(cols)}
      FROM boxes{s} b LEFT JOIN fields{s} USING (scan_id) GROUP BY 1) w""".replace("SELECT w.*, ", "SELECT w.* EXCLUDE (n_regions, tallest), "),
          f"boxes{s}", f"fields{s}", f"first{s}")


block("vision", rf"""
SELECT scan_id, field_name, value FROM (
  SELECT scan_id, field_name, {strip("json_extract_string(body, '$.' || field_name)")} AS value,
    json_type(body, '$.' || field_name) AS kind
  FROM (SELECT * FROM answers WHERE json_valid(body)), (SELECT unnest([{', '.join(q(n) for n in K.DECLARATION_FIELDS)}]) AS field_name)
  WHERE json_type(body) = 'OBJECT')
WHERE kind = 'VARCHAR' AND value <> '' AND lower(value) NOT IN ({', '.join(q(a) for a in K.ABSENT_ANSWERS)})""", "answers")
for _r in ("p", "s"):
    extraction_blocks(_r)

PARTS = ("val", "raw", "x", "y", "w", "h", "conf", "lang", "found", "src", "note")
OTHER = ["n_regions", "is_perishable_category", "mrp_height", "quantity_height", "ref_height", "image_quality_warning"]


def _merged_passes():
    cols = []
    for n in K.DECLARATION_FIELDS:
        take = f"(coalesce(s.{n}_found, false) AND (NOT p.{n}_found OR coalesce(s.{n}_conf, 0) > coalesce(p.{n}_conf, 0)))"
        cols += [f"CASE WHEN {take} THEN s.{n}_{a} ELSE p.{n}_{a} END AS {n}_{a}" for a in PARTS]
    return (f"SELECT * EXCLUDE (prior), {category('net_quantity_unit_val', 'prior')} AS commodity_category FROM ("
            f"SELECT p.scan_id, {', '.join(cols)}, p.commodity_category AS prior, p.is_imported, {', '.join('p.' + o for o in OTHER)} "
            "FROM base_p p LEFT JOIN wide_s s USING (scan_id))")


# every label, also those without a single box
block("base_p", "SELECT o_orderkey AS scan_id, w.* EXCLUDE (scan_id, image_quality_warning, n_regions, "
      + ", ".join(f"{n}_found, {n}_src" for n in K.DECLARATION_FIELDS) + "), "
      + ", ".join(f"coalesce({n}_found, false) AS {n}_found, coalesce({n}_src, 'ocr') AS {n}_src" for n in K.DECLARATION_FIELDS)
      + f", coalesce(n_regions, 0) AS n_regions, CASE WHEN w.scan_id IS NULL THEN {q(K.WARNING_NO_TEXT)} ELSE image_quality_warning END "
      "AS image_quality_warning FROM orders LEFT JOIN wide_p w ON w.scan_id = o_orderkey", "wide_p")
block("passes", _merged_passes(), "base_p", "wide_s")
block("vision_wide", "SELECT scan_id, " + ", ".join(
    f"any_value(value) FILTER (WHERE field_name = {q(n)}) AS {n}_v" for n in K.DECLARATION_FIELDS) + " FROM vision GROUP BY 1", "vision")


def _with_vision():
    cols = []
    for n in K.DECLARATION_FIELDS:
        v, o = f"{n}_v", f"{n}_val"
        ag = agree(o, v)
        cols += [f"CASE WHEN {v} IS NULL THEN {o} WHEN NOT {n}_found THEN {v} WHEN {ag} THEN {o} ELSE {v} END AS {n}_val",
                 f"CASE WHEN {v} IS NOT NULL AND NOT {n}_found THEN {v} ELSE {n}_raw END AS {n}_raw",
                 *[f"{n}_{a}" for a in ("x", "y", "w", "h", "conf", "lang")],
                 f"({n}_found OR {v} IS NOT NULL) AS {n}_found",
                 f"CASE WHEN {v} IS NULL THEN {n}_src WHEN NOT {n}_found THEN 'vision' WHEN {ag} THEN 'ocr+vision' ELSE 'vision' END AS {n}_src",
                 f"CASE WHEN {v} IS NOT NULL AND {n}_found AND NOT {ag} THEN {q(K.NOTE_DISAGREEMENT)} || {quoted(o)} END AS {n}_note"]
    return (f"SELECT * EXCLUDE (prior, imported), {category('net_quantity_unit_val', 'prior')} AS commodity_category, "
            "CASE WHEN country_of_origin_found THEN true ELSE imported END AS is_imported FROM ("
            f"SELECT scan_id, {', '.join(cols)}, commodity_category AS prior, is_imported AS imported, {', '.join(OTHER)} "
            "FROM passes LEFT JOIN vision_wide USING (scan_id))")


block("merged", _with_vision(), "passes", "vision_wide")


def ready_block(name: str, source: str) -> None:
    """Every scan of the catalogue with overrides, calibration and clear-space intruders applied."""
    field_cols = []
    for n in K.DECLARATION_FIELDS:
        for a in PARTS:
            field_cols.append(f"coalesce(d.{n}_found, false) AS {n}_found" if a == "found" else
                              f"coalesce(d.{n}_src, 'ocr') AS {n}_src" if a == "src" else f"d.{n}_{a}")
    known = "(reference_width_mm IS NOT NULL AND reference_height_mm IS NOT NULL)"
    block(f"{name}0", f"""
SELECT m.scan_id, m.case_no, {', '.join(field_cols)}, coalesce(nullif(m.commodity_category, ''), d.commodity_category) AS commodity_category,
  coalesce(m.is_imported, d.is_imported) AS is_imported, coalesce(m.is_perishable_category, d.is_perishable_category) AS is_perishable_category,
  m.is_medical_device, m.is_combination_or_multipiece_package, m.image_width_px, m.image_height_px,
  mrp_height, quantity_height, ref_height, coalesce(n_regions, 0) AS n_regions,
  CASE WHEN d.scan_id IS NULL THEN {q(K.WARNING_NO_TEXT)} ELSE image_quality_warning END AS image_quality_warning,
  {known} AS calibrated, reference_width_mm * reference_height_mm / 100.0 AS area,
  (image_width_px / reference_width_mm + image_height_px / reference_height_mm) / 2 AS px_per_mm,
  CASE WHEN {known} THEN 'tier2' ELSE 'tier1' END AS font_size_tier
FROM meta m LEFT JOIN {source} d USING (scan_id)""", "meta", source)
    nq = "net_quantity_value"
    block(f"{name}_intruders", f"""
SELECT scan_id, string_agg({quoted('text')}, ', ' ORDER BY region_idx) AS intruding FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.scan_id ORDER BY r.region_idx) AS rn
  FROM {name}0 d JOIN regions_p r USING (scan_id)
  WHERE {nq}_found AND {nq}_h > 0
    AND NOT (x >= {nq}_x AND y >= {nq}_y AND x + width <= {nq}_x + {nq}_w AND y + height <= {nq}_y + {nq}_h)
    AND NOT (x + width <= {nq}_x - 2 * {nq}_h OR x >= {nq}_x + {nq}_w + 2 * {nq}_h
      OR y + height <= {nq}_y - {nq}_h OR y >= {nq}_y + {nq}_h + {nq}_h)) WHERE rn <= 3 GROUP BY 1""", f"{name}0", "regions_p")
    block(name, f"SELECT * FROM {name}0 LEFT JOIN {name}_intruders USING (scan_id)", f"{name}0", f"{name}_intruders")


ready_block("ready", "base_p")
ready_block("entire", "merged")
