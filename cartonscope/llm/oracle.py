"""DuckDB SQL for the queries of this package that SQL can express on whole tables.

None is given for op1, op5 and op10 (fitted models), op3 (the draw hangs on a hash) and op8 (the weak kinds
need look-behind); tests hold these against plain code, held-out labels or exact round trips.
"""

from __future__ import annotations

from cartonscope.llm import chat_format as C

LOW = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({c}, '[^\x20\x09-\x0D]+')"
DOCS = "docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NEAR = f"""
WITH RECURSIVE {DOCS},
worded AS MATERIALIZED (SELECT r, doc_id, {WORDS.format(c=LOW.format(c='text'))} AS w FROM docs),
shingles AS MATERIALIZED (
  SELECT DISTINCT r, doc_id, array_to_string(w[k:k + 3], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM worded WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.r AS ra, b.r AS rb, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.r < b.r AND a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY 1, 2),
links AS MATERIALIZED (SELECT ra AS a, rb AS b FROM pairs JOIN sizes x ON x.r = ra JOIN sizes y ON y.r = rb
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT x.a, y.b FROM reach x JOIN edges y ON x.b = y.a),
least AS (SELECT a, min(doc_id) AS m FROM reach JOIN docs ON r = b GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id,
  coalesce(least(doc_id, m), doc_id) = doc_id AS kept
FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least ON a = r"""

_ESCAPED = "replace({c}, chr(92), chr(92) || chr(92))"
for _control in C.CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, {_quoted(_control)}, {_quoted(_control[0])} || chr(92) || {_quoted(_control[1:])})"
_FRAME = len(C.START) + len(C.SEP) + len(C.STOP)

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, role)),
placed AS (
  SELECT *, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({_FRAME} + length({_ESCAPED.format(c='role')}) + length({_ESCAPED.format(c='text')})) OVER o AS so_far
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(so_far) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id"""


def _covered(n: int) -> str:
    """Words inside n-word windows that a text holds twice or more."""
    return f"""SELECT r, count(DISTINCT k + d) AS c FROM (
    SELECT r, k, count(*) OVER (PARTITION BY r, g) AS many FROM (
      SELECT r, k, array_to_string(w[k:k + {n - 1}], ' ') AS g FROM (
        SELECT r, w, unnest(range(1, len(w) - {n - 1} + 1)) AS k FROM worded WHERE len(w) >= {n}))),
    (SELECT unnest(range({n})) AS d) WHERE many > 1 GROUP BY r"""


def _bytes(kind: str) -> str:
    return f"length(regexp_replace(text, '[^{kind}]', '', 'g'))"


RULES = f"""
WITH {DOCS},
worded AS MATERIALIZED (SELECT r, doc_id, text, {WORDS.format(c='text')} AS w FROM docs),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
most AS (SELECT r, max(n) AS n_most FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM worded) GROUP BY 1, 2) GROUP BY r),
three AS ({_covered(3)}), four AS ({_covered(4)}),
stats AS (
  SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {_bytes('#*$%&|<>')} AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(three.c, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_most, 0) AS n_most,
    coalesce(four.c, 0) AS n_four, {_bytes('A-Z')} AS upper, {_bytes('a-z')} AS lower, {_bytes('!')} AS bangs, {_bytes('0-9')} AS digits
  FROM worded LEFT JOIN lines USING (r) LEFT JOIN most USING (r) LEFT JOIN three USING (r) LEFT JOIN four USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * upper > upper + lower
    OR 2 * bangs > n_words OR 10 * digits > 3 * word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > n_lines OR 10 * n_most > 3 * n_words OR 10 * n_four > 4 * n_words) AS kept
FROM stats"""

LINES = f"""
WITH {DOCS},
lines AS MATERIALIZED (SELECT r, pos, line, {LOW.format(c="trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs))),
common AS (SELECT key FROM (SELECT DISTINCT r, key FROM lines WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM lines JOIN docs USING (r) LEFT JOIN common c ON c.key = lines.key GROUP BY r"""

_ALNUM = r"regexp_extract_all({c}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = f"""
WITH {DOCS},
worded AS MATERIALIZED (SELECT r, doc_id, {_ALNUM.format(c=LOW.format(c='text'))} AS w FROM docs),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (
  SELECT item_id, {_ALNUM.format(c=LOW.format(c="coalesce(text, '')"))} AS w FROM benchmark) WHERE len(w) > 0),
asked AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
found AS MATERIALIZED (SELECT r, k, s.n, item_id FROM (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM worded, (SELECT DISTINCT n FROM asked) WHERE len(w) >= n)) s
  JOIN asked a ON a.g = s.g AND a.n = s.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits USING (r) LEFT JOIN named USING (r)"""

def _hashed(n_chars: str) -> str:
    """Digest of a row; fields are written as length, colon, value."""
    def field(c: str) -> str:
        return f"coalesce(strlen(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


#: crc32, bit by bit: a character is xored in, then eight shifts follow, each written as -1.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({c}, ''),
    lambda ch: list_prepend(ascii(ch)::BIGINT, list_transform(range(8), lambda z: -1::BIGINT))))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""


def _levels(name: str, base: str) -> str:
    """All levels of the trees over base (g, pos, n, node)."""
    return f"""{name} AS (SELECT g, 0 AS lvl, pos, n, node FROM {base}
  UNION ALL SELECT g, lvl + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(beside, ''))
  FROM (SELECT *, lead(node) OVER (PARTITION BY g ORDER BY pos) AS beside FROM {name} WHERE n > 1) WHERE pos % 2 = 0)"""


MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, {_hashed('n_chars')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC.format(c="coalesce(doc_id, 0)::VARCHAR")} % 7 = 0 THEN {_hashed('n_chars + 1')} ELSE {_hashed('n_chars')} END AS seen
  FROM documents),
langs AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM leaves)),
placed AS MATERIALIZED (SELECT r, doc_id, leaf, leaf AS node, seen, g, count(*) OVER (PARTITION BY g) AS n,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang),
{_levels('low', 'placed')},
subroots AS MATERIALIZED (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, node FROM low WHERE n = 1),
{_levels('high', 'subroots')},
tree AS MATERIALIZED (
  SELECT 0 AS part, g, lvl, pos, n, node FROM low UNION ALL SELECT 1, g, lvl, pos, n, node FROM high),
climb AS (
  SELECT r, 0 AS part, g, 0 AS lvl, pos, n, seen AS node, '' AS proof FROM placed
  UNION ALL
  SELECT r, c.part + d.up, CASE WHEN d.up = 1 THEN 0 ELSE c.g END, CASE WHEN d.up = 1 THEN 0 ELSE c.lvl + 1 END,
    CASE WHEN d.up = 1 THEN c.g ELSE c.pos // 2 END, CASE WHEN d.up = 1 THEN d.langs ELSE (c.n + 1) // 2 END,
    CASE WHEN d.up = 1 THEN c.node WHEN c.pos % 2 = 1 THEN sha256(t.node || c.node) ELSE sha256(c.node || coalesce(t.node, '')) END,
    c.proof || CASE WHEN d.up = 1 THEN '' ELSE coalesce(t.node, '') END
  FROM climb c JOIN (SELECT up, (SELECT count(*) FROM langs) AS langs FROM (VALUES (0), (1)) v(up)) d ON d.up = CASE WHEN c.n = 1 THEN 1 ELSE 0 END
  LEFT JOIN tree t ON t.part = c.part AND t.g = c.g AND t.lvl = c.lvl AND t.pos = xor(c.pos, 1)
  WHERE NOT (c.part = 1 AND c.n = 1))
SELECT p.doc_id, p.leaf, s.node AS subroot, h.node AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = h.node AS verified
FROM climb c JOIN placed p USING (r) JOIN subroots s ON s.pos = p.g, (SELECT node FROM high WHERE n = 1) h
WHERE c.part = 1 AND c.n = 1"""

ORACLE: dict[str, str] = {
    "op2_near_duplicates": NEAR, "op4_chat_format": CHAT, "op6_quality_rules": RULES, "op7_line_dedup": LINES,
    "op9_decontamination": LEAKS, "op12_merkle_manifest": MERKLE}
