"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are reported wherever they match. Three weak kinds say little alone:
a long mixed token (`key`), an account or user name given as a setting (`ident`), and an address of a
service (`endpoint`). All spans are put on one line per text, and each is joined with the spans that
it overlaps or that lie within `scope` code points of it, from the end of the one to the start of the
other, however long they are: frames over the line carry, for each sort of part, the furthest end of
those that start no later and the nearest start of those that start no earlier. A weak key is
reported only next to an identifier or an endpoint, an identifier only next to a secret, an endpoint
only next to both. Weak spans that overlap a base span add nothing and go.

Places come from the texts between matches: their lengths and the lengths of the matches are summed
along the matches, in rows, so that a text with very many matches stays linear.

Defined cases: a null or empty text has no spans; equal rows are scanned each and share their result;
null ids are kept; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartonscope.llm.common import shared_folder, stored

#: Kinds in the order in which spans of equal start are listed: pattern, and the group whose length counts, with its least.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{32})(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
    "ident": (r"""(?i:\b(user(?:name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    "endpoint": (r"""\b(?:https?|wss?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+""", 0, 10),
}
KINDS = list(BASE) + list(WEAK)
SECRETS, IDENTIFIERS, ENDPOINTS = ("assign", "hex", "key"), ("access", "ident"), ("endpoint",)
#: Code points at most between the end of one part of a credential and the start of the next.
SCOPE = 240


def _matches(text: Column, kind: str) -> Column:
    """Matches of a kind in order: text since the last one, length, length of the group that counts."""
    pattern, group, _ = (BASE | WEAK)[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    lengths = lambda x: F.transform(x, lambda s: F.length(s))
    counted = lengths(F.regexp_extract_all(text, p, F.lit(group))) if group else lengths(whole)
    # Most texts hold no match, and then one search is all that is done.
    return F.when(F.regexp_like(text, p), F.zip_with(
        F.arrays_zip(lengths(whole).alias("length"), counted.alias("counted")), gaps,
        lambda m, gap: F.when(m.isNotNull(), F.struct(gap.alias("gap"), m["length"].alias("length"), m["counted"].alias("counted")))))


def scanned(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """columns of docs and `spans`: array of (start, kind, end), kinds by number in KINDS, sorted."""
    shared_folder(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Equal texts have equal spans, so a text is known by its hashes.
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    found = stored(docs.select(*columns, key.alias("secret_key"), F.array(*[_matches(text, k) for k in KINDS]).alias("secret_found")), "secret-matches")
    one = found.filter(F.exists("secret_found", lambda m: m.isNotNull())).select("secret_key", "secret_found").dropDuplicates(["secret_key"])
    rows = (one.select("secret_key", F.posexplode("secret_found").alias("kind", "matches"))
            .select("secret_key", "kind", F.posexplode("matches").alias("at", "m")).filter("m is not null")
            .select("secret_key", "kind", "at", "m.*"))
    along = Window.partitionBy("secret_key", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(along)).withColumn("start", F.col("end") - F.col("length"))
    least = F.element_at(F.array(*[F.lit((BASE | WEAK)[k][2]) for k in KINDS]), F.col("kind") + 1)
    spans = spans.filter(F.col("counted") >= least).select("secret_key", "kind", "start", "end")

    # Both frames grow from one end of the line, so that a text with very many spans stays linear.
    so_far = Window.partitionBy("secret_key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    from_here = Window.partitionBy("secret_key").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    is_base = F.col("kind") < len(BASE)
    parts = {"secret": SECRETS, "identifier": IDENTIFIERS, "address": ENDPOINTS}
    sort = {"overlaps": is_base} | {k: F.col("kind").isin([KINDS.index(p) for p in kinds]) for k, kinds in parts.items()}
    carried = spans.select("*", *[F.max(F.when(test, F.col("end"))).over(so_far).alias(f"{k}_end") for k, test in sort.items()],
                           *[F.min(F.when(test, F.col("start"))).over(from_here).alias(f"{k}_start") for k, test in sort.items()])
    near = lambda k: F.coalesce((F.col("start") - F.col(f"{k}_end") <= scope) | (F.col(f"{k}_start") - F.col("end") <= scope), F.lit(False))
    covered = F.coalesce((F.col("overlaps_end") > F.col("start")) | (F.col("overlaps_start") < F.col("end")), F.lit(False))
    spans = carried.select("secret_key", "kind", "start", "end", *[near(k).alias(k) for k in parts], covered.alias("overlaps"))
    number = lambda k: F.col("kind") == KINDS.index(k)
    linked = (F.when(number("key"), F.col("identifier") | F.col("address")).when(number("ident"), F.col("secret"))
              .otherwise(F.col("secret") & F.col("identifier")))
    kept = spans.filter(is_base | (linked & ~F.col("overlaps")))
    of_text = kept.groupBy("secret_key").agg(F.array_sort(F.collect_list(
        F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))).alias("spans"))
    out = found.select(*columns, "secret_key").join(of_text, "secret_key", "left")
    return out.select(*columns, F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < len(BASE))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
