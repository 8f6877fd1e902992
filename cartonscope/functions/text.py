"""Scalar text functions: ``Column -> Column``, all JVM-side expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.functions import patterns as P


def folded(c: Column) -> Column:
    """Lower case, with the letters that only case-insensitive matching equates to ASCII."""
    return F.translate(F.lower(c), "ſıK", "sik")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the leftmost hit, NULL when the pattern does not occur. No pattern used here
    matches the empty string, so an empty extract means no hit."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{P.SPACE}+|{P.SPACE}+\z", "")


def fixed(c: Column, digits: int) -> Column:
    """A double with so many decimals, rounded on its exact binary value: 2.675 prints as 2.67.

    Only a scaled value that ends in exactly one half can be a tie; which side the true product lies on is
    the rounding error of the scaling, got without error from the halves of the double."""
    scale, x = F.lit(10.0 ** digits), F.abs(c.cast("double"))
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    whole = F.floor(product).cast("double")
    part = product - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    rounded = (whole + up.cast("double")) / scale
    return F.format_string(f"%.{digits}f", F.when(c < 0, -rounded).otherwise(rounded))


def normalize_digits(c: Column) -> Column:
    return F.translate(c, K.INDIC_DIGITS, K.ASCII_DIGITS)


def fix_unit_noise(c: Column) -> Column:
    """Few texts hold the two letters at all, and only these are rewritten."""
    return F.when(c.rlike("(?iu)mi"), F.regexp_replace(c, P.UNIT_MISREAD, "ml")).otherwise(c)


def price_value(c: Column) -> Column:
    return first_match(c, P.PRICE)


def first_number(c: Column) -> Column:
    return first_match(c, P.FIRST_NUMBER)


def net_quantity(c: Column) -> Column:
    """struct(value, unit) of the first free-standing quantity, NULL when there is none."""
    return F.when(c.rlike(P.QUANTITY), F.struct(
        F.regexp_extract(c, P.QUANTITY, 1).alias("value"),
        F.lower(F.regexp_extract(c, P.QUANTITY, 2)).alias("unit")))


def quantity_of(c: Column) -> Column:
    return net_quantity(fix_unit_noise(normalize_digits(c)))


def date_text(c: Column) -> Column:
    return first_match(c, P.DATE)


def phone_loose(c: Column) -> Column:
    return first_match(c, P.PHONE_LOOSE, 0)


def phone_strict(c: Column) -> Column:
    return first_match(c, P.PHONE_STRICT, 0)


def email(c: Column) -> Column:
    return F.when(c.contains("@"), first_match(c, P.EMAIL, 0))


def is_reference_number(c: Column, phone_pattern: str) -> Column:
    """The first phone-shaped hit is introduced as a licence, batch or registration number."""
    before = F.regexp_extract(c, rf"(?s)\A(.*?)(?:{phone_pattern})", 1)
    return c.rlike(P.REFERENCE_WORD) | before.rlike(P.NUMBER_LEAD_IN)


def _count_of(c: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{char_class}]", ""))


def dominant_script(c: Column) -> Column:
    """Letters of each script are counted once; a text of ASCII alone has Latin letters or none."""
    counts = F.struct(_count_of(c, "A-Za-z").alias("latin"), _block_letters(c, r"ऀ-ॿ").alias("deva"),
                      _block_letters(c, r"઀-૿").alias("guj"))

    def of(n: Column) -> Column:
        latin, deva, guj = n["latin"], n["deva"], n["guj"]
        present = sum((F.when(k > 0, 1).otherwise(0) for k in (latin, deva, guj)), F.lit(0))
        minority = deva + guj
        return (F.when(present == 0, "mixed")
                .when(present == 1, F.when(latin > 0, "eng").when(deva > 0, "hin").otherwise("guj"))
                .when((latin > deva) & (latin > guj) & (latin > minority)
                      & (minority <= K.SCRIPT_NOISE_TOLERANCE), "eng")
                .otherwise("mixed"))
    return (F.when(F.octet_length(c) == F.length(c), F.when(c.rlike("[A-Za-z]"), "eng").otherwise("mixed"))
            .otherwise(_once(counts, of)))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _block_letters(c: Column, block: str) -> Column:
    """Letters (no signs, no digits) inside one Unicode block."""
    return F.when(c.rlike(f"[{block}]"), F.length(F.regexp_replace(c, rf"[^{block}]|\P{{L}}", ""))).otherwise(0)


def script_tag(c: Column) -> Column:
    deva, guj = c.rlike(r"[ऀ-ॿ]"), c.rlike(r"[઀-૿]")
    return (F.when(deva & guj, "mixed").when(deva, "hin").when(guj, "guj").otherwise("eng"))


def reread_route(c: Column) -> Column:
    alnum, rest = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"
    enough = c.rlike(f"{alnum}(?:{rest}*{alnum}){{{K.MIN_REREAD_ALNUM - 1}}}")
    return F.when(~enough, "keep").otherwise(_once(dominant_script(c), lambda script: F.when(
        script == "mixed", K.COMBINED_READER).otherwise(script)))


def unit_category(unit: Column, prior: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.UNIT_CATEGORY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(unit)), prior)


def values_agree(a: Column, b: Column) -> Column:
    def canon(c):
        return F.lower(F.regexp_replace(normalize_digits(c), rf"[^{P.WORD}]", ""))
    x, y = canon(a), canon(b)
    return F.coalesce((x != "") & (y != "") & (x.contains(y) | y.contains(x)), F.lit(False))


def misleading_terms(c: Column) -> Column:
    span = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in K.MISLEADING_TERMS]), lambda t: F.contains(span, t))


def join_notes(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def provenance_note(source: Column, note: Column) -> Column:
    head, tail = K.NOTE_VISION_CONTESTED.split("{note}")
    return (F.when(source == "ocr+vision", K.NOTE_BOTH_READERS)
            .when(source == "vision",
                  F.when(F.coalesce(note, F.lit("")) != "", F.concat(F.lit(head), note, F.lit(tail)))
                  .otherwise(K.NOTE_VISION_ONLY))
            .otherwise(""))


def fill(template: str, **values: Column) -> Column:
    """A fixed message with ``{name}`` slots filled from columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def quoted(c: Column) -> Column:
    """A value in quotes: single ones, double ones when the value itself holds a single quote."""
    body = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def percent(ratio: Column) -> Column:
    """Whole per cent, halves to even."""
    return F.bround(ratio * 100, 0).cast("int")
