"""Regular-expression builders in Java syntax.

Word characters follow the Unicode letter/number classes (combining marks are not word
characters), which neither the ASCII nor the ``(?U)`` flavour of Java's ``\\w`` gives, so every
boundary is written out as a lookaround over ``WORD``.
"""

from __future__ import annotations

import re

from cartonscope import constants as K

WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
LETTER_BLOCKS = r"A-Za-zऀ-ॿ઀-૿"
NOT_AFTER_WORD = rf"(?<![{WORD}])"
NOT_BEFORE_WORD = rf"(?![{WORD}])"
EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

# --- fixed values: value patterns -------------------------------------------------------------
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
PRICE = rf"(?iu)(?:rs\.?|₹|inr){SPACE}*({NUMBER})"
FIRST_NUMBER = rf"({NUMBER})"
# a lookahead on the first character spares most positions the tests around it
QUANTITY = (rf"(?iu)(?=\p{{Nd}}){NOT_AFTER_WORD}({NUMBER}){SPACE}*({'|'.join(K.QUANTITY_UNITS)}){NOT_BEFORE_WORD}")
DATE = (r"(\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}"
        rf"|[A-Za-z]{{3,9}}{SPACE}?\p{{Nd}}{{4}}"
        r"|\p{Nd}{1,2}[/-]\p{Nd}{2,4})")
_PHONE_LEAD = r"(?:\+?91[-\s\p{Z}]?)?"
PHONE_LOOSE = rf"{_PHONE_LEAD}\p{{Nd}}[\p{{Nd}}\-\s\p{{Z}}]{{8,13}}\p{{Nd}}"
PHONE_STRICT = (rf"{_PHONE_LEAD}(?:1800[-\s\p{{Z}}]?\p{{Nd}}{{3}}[-\s\p{{Z}}]?\p{{Nd}}{{3,4}}"
                rf"|[6-9]\p{{Nd}}{{9}}){NOT_BEFORE_WORD}")
REFERENCE_WORD = (rf"(?iu)(?=[lfrbg]){EDGE}(?:lic\.?|licen[cs]e|fssai|reg\.?|regd\.?|registration|batch|lot"
                  rf"|gstin|gst){EDGE}")
NUMBER_LEAD_IN = rf"(?iu){EDGE}no\.?{SPACE}*,?{SPACE}*\z"
EMAIL = rf"[{WORD}.+-]+@[{WORD}-]+\.[{WORD}.-]+"
UNIT_MISREAD = rf"(?iu){EDGE}mi{EDGE}"


def _alternatives(terms: list[str]) -> str:
    return "|".join(re.escape(t) for t in terms)


def _heads(terms: list[str]) -> str:
    """Lookahead on the first character, so most positions fail after one class test."""
    return f"(?=[{''.join(re.escape(c) for c in dict.fromkeys(t[0] for t in terms))}])"


def exact(terms: list[str]) -> str:
    """Any term (in lower-cased text), with no letter of the three scripts' blocks on either side."""
    return rf"{_heads(terms)}(?<![{LETTER_BLOCKS}])(?:{_alternatives(terms)})(?![{LETTER_BLOCKS}])"


def stray(terms: list[str]) -> str:
    """Any term with at most one letter welded to either side."""
    return rf"{_heads(terms)}(?<!\p{{L}}{{2}})(?:{_alternatives(terms)})(?!\p{{L}}{{2}})"


def _within_one_edit(term: str) -> str:
    """All strings at edit distance <= 1, factored as a chain so a wrong first letter fails fast.

    At each position the text either follows the term, or spends its single edit there
    (substitute, drop, insert) and must follow the rest exactly.
    """
    expr = "."  # an insertion after the last character; optional below
    expr = rf"(?:{expr})?"
    for i in range(len(term) - 1, -1, -1):
        here, rest, whole = re.escape(term[i]), re.escape(term[i + 1:]), re.escape(term[i:])
        expr = rf"(?:{here}{expr}|.{rest}|{rest}|.{whole})"
    return expr


def fuzzy(terms: list[str]) -> str:
    """Any term with one character wrong, missing or added, not flanked by letters."""
    chains = "|".join(_within_one_edit(t) for t in terms)
    return rf"(?s)(?<!\p{{L}})(?:{chains})(?!\p{{L}})"


def halves(terms: list[str]) -> str:
    """Cheap guard for :func:`fuzzy`: one edit leaves one half of the term intact."""
    parts = [p for t in terms for p in (t[: len(t) // 2], t[len(t) // 2:])]
    parts = list(dict.fromkeys(parts))
    return rf"{_heads(parts)}(?:{_alternatives(parts)})"


def _trie(texts: list[str]) -> str:
    """The longest of texts that stands at a place: what they begin with alike is tried once."""
    by_head: dict[str, list[str]] = {}
    for t in texts:
        if t:
            by_head.setdefault(t[0], []).append(t[1:])
    branches = [re.escape(head) + _trie(rest) for head, rest in by_head.items()]
    if not branches:
        return ""
    if "" in texts:
        return f"(?:{'|'.join(branches)})?"
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def places(texts: list[str]) -> str:
    """Group 1: at each place the longest of texts that begins there, also where they overlap."""
    kinds = [[t for t in texts if t[0].isascii()], [t for t in texts if not t[0].isascii()]]
    guards = [lambda k: _heads(k), lambda k: r"(?=[^\x00-\x7f])"]
    return f"(?=({'|'.join(guard(k) + _trie(k) for guard, k in zip(guards, kinds) if k)}))"
