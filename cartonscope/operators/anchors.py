"""Dictionary matching over text boxes.

The built-in dictionary, and any other that is configuration, is compiled into literal patterns, so
matching is a per-row expression: no join, no shuffle, nothing broadcast that grows with the data. A
dictionary of any size that is a table stays one: :func:`match_table` finds the terms that may stand in
a text by an equi-join on short pieces of both, and puts only those to the same three tests.
"""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import patterns as P

GROUPS = list(K.ANCHOR_TERMS)
Dictionary = dict[str, list[str]]


def default_rows() -> list[tuple[str, str, str]]:
    return [(g, lang, t) for g, langs in K.ANCHOR_TERMS.items() for lang, terms in langs.items() for t in terms]


def anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(default_rows(), "grp string, lang string, term string")


def anchors_with(base: DataFrame, extra: DataFrame) -> DataFrame:
    """The dictionary extended by user terms per group and language."""
    return base.unionByName(extra.select("grp", "lang", "term"))


def compile_dictionary(terms: DataFrame | None = None) -> Dictionary:
    """group -> terms. These are configuration and become part of the plan; a dictionary that is data goes
    to :func:`match_table` instead."""
    rows = default_rows() if terms is None else [tuple(r) for r in terms.select("grp", "lang", "term").collect()]
    out: Dictionary = OrderedDict((g, []) for g in GROUPS)
    for grp, _, term in rows:
        out.setdefault(grp, []).append(term)
    return out


def _fuzzy_terms(terms: list[str]) -> list[str]:
    return [t for t in terms if len(t) >= K.FUZZY_MIN_TERM_LENGTH]


def _stray_terms(terms: list[str]) -> list[str]:
    return [t for t in terms if len(t) >= K.STRAY_MIN_TERM_LENGTH]


def _lower(terms: list[str]) -> list[str]:
    return [t.lower() for t in terms]


def quoted(text: str) -> str:
    """A text as a SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string literal; a single quote in it is written by its number."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


FOLDS = ("ſıK", "sik")
FOLDED, LOWER = f"translate(lower({{c}}), '{FOLDS[0]}', '{FOLDS[1]}')", "lower({c})"
#: Columns of :func:`with_parts`, on which the tests below run.
LOW, FOLD, MAYBE = "text_low", "text_folded", "text_groups"


def exact_sql(terms: list[str]) -> str:
    return f"{FOLD} RLIKE {literal(P.exact(_lower(terms)))}"


def fuzzy_sql(terms: list[str]) -> str:
    long = _lower(_fuzzy_terms(terms))
    if not long:
        return "false"
    return f"({LOW} RLIKE {literal(P.halves(long))} AND {LOW} RLIKE {literal(P.fuzzy(long))})"


def stray_sql(terms: list[str]) -> str:
    mid = _lower(_stray_terms(terms))
    return f"{LOW} RLIKE {literal(P.stray(mid))}" if mid else "false"


def hit_sql(terms: list[str]) -> str:
    """Any tier; the cheap tiers come first so the costly one runs only where they fail."""
    return f"({exact_sql(terms)} OR {stray_sql(terms)} OR {fuzzy_sql(terms)})"


def is_exact(column: str, terms: list[str]) -> Column:
    return F.expr(exact_sql(terms).replace(FOLD, FOLDED.format(c=column)))


def is_fuzzy(column: str, terms: list[str]) -> Column:
    return F.expr(fuzzy_sql(terms).replace(LOW, LOWER.format(c=column)))


def is_stray(column: str, terms: list[str]) -> Column:
    return F.expr(stray_sql(terms).replace(LOW, LOWER.format(c=column)))


def needles(terms: list[str]) -> list[str]:
    """Parts of which a folded text holds at least one where any tier fires: the terms themselves, and their halves where one
    character may be wrong. A part that holds another one is left out."""
    low = _lower(terms)
    parts = {p.translate(str.maketrans(*FOLDS)) for t in low for p in (
        (t, t[:len(t) // 2], t[len(t) // 2:]) if len(t) >= K.FUZZY_MIN_TERM_LENGTH else (t,))}
    return sorted(p for p in parts if not any(q != p and q in p for q in parts))


def with_parts(regions: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Adds the text in lower case, folded, and the numbers of the groups of which it holds a part: one walk over a text for all
    groups tells which of them can match at all, and only these are put to the tests."""
    of_group = [needles(t) for t in dictionary.values()]
    every = list(dict.fromkeys(p for own in of_group for p in own))
    regions = regions.withColumn(LOW, F.expr(LOWER.format(c="text")))
    if not every:
        return regions.withColumns({FOLD: F.col(LOW), MAYBE: F.expr("array()")})
    # plain ASCII holds none of the folded letters
    folded = f"IF(octet_length({LOW}) = length({LOW}), {LOW}, {FOLDED.format(c='text')})"
    # of several parts that begin at one place the walk gives the longest, which stands for the others too
    shown = ", ".join(f"{quoted(p)}, array({', '.join(str(i) for i, own in enumerate(of_group) if any(p.startswith(q) for q in own))})"
                      for p in every)
    return regions.withColumn(FOLD, F.expr(folded)).withColumn(
        MAYBE, F.expr(f"flatten(transform(regexp_extract_all({FOLD}, {literal(P.places(every))}, 1), p -> element_at(map({shown}), p)))"))


def may_hit_sql(dictionary: Dictionary, group: str) -> str:
    return f"array_contains({MAYBE}, {list(dictionary).index(group)})"


def _terms_found(dictionary: Dictionary, qualifies, test) -> Column:
    """array(struct(grp, term)) of the terms that pass ``test``; a group's terms are tried one by
    one only where the group's combined pattern has matched."""
    per_group = []
    for grp, terms in dictionary.items():
        chosen = qualifies(terms)
        if chosen:
            found = ", ".join(f"IF({test([t])}, named_struct('grp', {quoted(grp)}, 'term', {quoted(t)}), NULL)" for t in chosen)
            per_group.append(f"IF({may_hit_sql(dictionary, grp)} AND {test(chosen)}, array_compact(array({found})), NULL)")
    return F.expr(f"flatten(array_compact(array({', '.join(per_group)})))")


def _explode_terms(regions: DataFrame, dictionary: Dictionary | None, qualifies, test) -> DataFrame:
    d = dictionary or compile_dictionary()
    return with_parts(regions, d).select("scan_id", "region_idx", F.inline(_terms_found(d, qualifies, test)))


def anchor_exact(regions: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    return _explode_terms(regions, dictionary, lambda t: t, exact_sql)


def anchor_fuzzy(regions: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    return _explode_terms(regions, dictionary, _fuzzy_terms, fuzzy_sql)


def anchor_stray(regions: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    return _explode_terms(regions, dictionary, _stray_terms, stray_sql)


def with_hits(regions: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """Adds one boolean ``hit_<group>`` per dictionary group."""
    d = dictionary or compile_dictionary()
    return with_parts(regions, d).withColumns({
        f"hit_{g}": F.expr(f"{may_hit_sql(d, g)} AND {hit_sql(t)}") for g, t in d.items() if t}).drop(LOW, FOLD, MAYBE)


def anchor_match(regions: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """(scan, box, group) with the first tier that fired: exact, then fuzzy, then stray."""
    d = dictionary or compile_dictionary()
    tiers = ", ".join(
        f"IF({may_hit_sql(d, g)}, named_struct('grp', {quoted(g)}, 'tier', CASE WHEN {exact_sql(t)} THEN 'exact' "
        f"WHEN {fuzzy_sql(t)} THEN 'fuzzy' WHEN {stray_sql(t)} THEN 'stray' END), NULL)"
        for g, t in d.items() if t)
    return (with_parts(regions, d).select("scan_id", "region_idx", "text", F.expr(f"inline(array_compact(array({tiers})))"))
            .filter("tier IS NOT NULL"))


#: Characters of the pieces on which texts and terms meet.
PIECE = 5


def _pieces(text: Column) -> Column:
    """All distinct runs of 1 to PIECE characters."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))
    return F.flatten(F.array(*[F.when(F.length(text) >= n, cut(n)).otherwise(F.array().cast("array<string>")) for n in range(1, PIECE + 1)]))


def match_table(regions: DataFrame, terms: DataFrame) -> DataFrame:
    """What :func:`anchor_match` finds, for a dictionary table (grp, term) of any size.

    A term is looked up by its first PIECE characters, or by all of a shorter one; a term long enough for
    the fuzzy test also by the start of its second half, since one wrong character leaves one half whole.
    Equal texts are matched once."""
    term, n = F.lower("term"), F.length(F.lower("term"))
    start = lambda at: F.substr(term, at, F.lit(PIECE))
    keyed = terms.select("grp", term.alias("term"), F.explode(F.when(
        n >= K.FUZZY_MIN_TERM_LENGTH, F.array(start(F.lit(1)), start(F.floor(n / 2).cast("int") + 1)))
        .otherwise(F.array(start(F.lit(1))))).alias("piece")).filter("length(piece) > 0")
    low, folded = F.expr(LOWER.format(c="text")), F.expr(FOLDED.format(c="text"))
    texts = regions.select("text").distinct().withColumns({"low": low, "folded": folded})
    pieces = texts.select("text", "low", "folded", F.explode(F.array_distinct(F.concat(_pieces(F.col("low")), _pieces(F.col("folded"))))).alias("piece"))
    tried = pieces.join(keyed, "piece").select("text", "low", "folded", "grp", "term").distinct()
    quoted = F.concat(F.lit(r"\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    around = lambda before, after: F.concat(F.lit(before), quoted, F.lit(after))
    exact = F.rlike("folded", around(f"(?<![{P.LETTER_BLOCKS}])", f"(?![{P.LETTER_BLOCKS}])"))
    stray = F.rlike("low", around(r"(?<!\p{L}{2})", r"(?!\p{L}{2})"))
    size = F.length("term")
    letter = lambda at: F.substr(F.col("low"), at, F.lit(1)).rlike(r"\p{L}")

    def near(at: Column, width: Column) -> Column:
        free = ~((at > 1) & letter(at - 1)) & ~((at + width <= F.length("low")) & letter(at + width))
        return free & (at + width - 1 <= F.length("low")) & (F.levenshtein(F.substr(F.col("low"), at, width), F.col("term"), 1) >= 0)

    fuzzy = F.exists(F.sequence(F.lit(1), F.length("low")), lambda at: F.exists(
        F.array(size - 1, size, size + 1), lambda width: near(at, width)))
    rank = (F.when(exact, 0).when((size >= K.FUZZY_MIN_TERM_LENGTH) & fuzzy, 1)
            .when((size >= K.STRAY_MIN_TERM_LENGTH) & stray, 2))
    found = tried.select("text", "grp", rank.alias("rank")).groupBy("text", "grp").agg(F.min("rank").alias("rank")).filter("rank is not null")
    tier = F.element_at(F.array(F.lit("exact"), F.lit("fuzzy"), F.lit("stray")), F.col("rank") + 1)
    return regions.select("scan_id", "region_idx", "text").join(found.select("text", "grp", tier.alias("tier")), "text").select(
        "scan_id", "region_idx", "text", "grp", "tier")


def first_of_each(matches: DataFrame) -> DataFrame:
    """First box in reading order of every group."""
    return matches.groupBy("scan_id", "grp").agg(F.min("region_idx").alias("region_idx"))


def first_anchor(regions: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """First box in reading order that matches the group on any tier."""
    return first_of_each(anchor_match(regions, dictionary))


def unanchored(regions: DataFrame, matches: DataFrame) -> DataFrame:
    return regions.join(matches.select("scan_id", "region_idx"), ["scan_id", "region_idx"], "left_anti")


def anchored(regions: DataFrame, matches: DataFrame) -> DataFrame:
    return regions.join(matches.select("scan_id", "region_idx"), ["scan_id", "region_idx"], "left_semi")
