"""Quality rules as a short-circuit cascade.

Each rule is timed and its rejections are counted on a random sample of the whole table, alone and from
the text on, over the texts that the base rule passes, since rules see no others. Rules then run in the order of rejections per unit of cost, and each sees only what all
before it have passed, so most rejected texts never reach a dear rule. The order moves cost, not verdicts:
a text is kept when it passes all rules.

Defined cases: null, empty and wordless texts have no words and fail the base rule; equal rows are
separate documents; null ids are kept as null; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cartonscope.llm import text_stats as S
from cartonscope.llm.common import bounded_batches, slices
from cartonscope.llm.text_stats import Texts

Rule = Callable[[Texts], np.ndarray]

#: Each says which texts it rejects.
RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "shouting": lambda t: 2 * t.kinds[:, S.UPPER] > t.kinds[:, S.UPPER] + t.kinds[:, S.LOWER],
    "exclaiming": lambda t: 2 * t.kinds[:, S.BANG] > t.n_words,
    "digits": lambda t: 10 * t.kinds[:, S.DIGIT] > 3 * t.word_chars,
    "word_length": lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 15 * t.n_words),
    "repeated_lines": lambda t: 2 * t.lines[1] > t.lines[0],
    "one_word": lambda t: 10 * t.vocabulary[1] > 3 * t.n_words,
    # Below the half of the base rule, which covers every word that this one counts.
    "repeated_phrases": lambda t: 10 * t.repeated(4) > 4 * t.n_words,
}
#: Rows of the sample that orders the rules, on average.
SAMPLE_ROWS = 2_000


def base_fails(texts: Texts) -> np.ndarray:
    return (texts.n_words < 50) | (100 * texts.repeated(3) > 50 * texts.n_words)


def _measure(batches: Iterator[pa.RecordBatch], rules: dict[str, Rule]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, bounds in slices(batch["text"]):
            took, rejected = [], []
            good = Texts(data, bounds)
            good = good.only(~base_fails(good))
            for rule in rules.values():
                texts, began = Texts(good.data, good.bounds), time.perf_counter_ns()
                rejected.append(int(rule(texts).sum()))
                took.append(time.perf_counter_ns() - began)
            yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(took), pa.array(rejected),
                                              pa.array([len(good)] * len(took))], ["rule", "took", "rejected", "texts"])


def order_rules(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per cost, from about sample_rows documents drawn from all files."""
    sample = docs.select("text").sample(min(1.0, sample_rows / max(docs.count(), 1)), seed=11)
    seen = (sample.mapInArrow(partial(_measure, rules=rules), "rule string, took long, rejected long, texts long")
            .groupBy("rule").agg({"took": "sum", "rejected": "sum", "texts": "sum"}).collect())
    # A rule that rejected nothing counts as half a rejection, so that cheap ones go first.
    worth = {r["rule"]: (r["sum(rejected)"] + 0.5) / (r["sum(took)"] + 1) for r in seen}
    return sorted(rules, key=lambda name: -worth.get(name, 0.0))


def cascade(texts: Texts, rules: dict[str, Rule], order: list[str]) -> np.ndarray:
    """Places of the texts that pass all rules."""
    alive = np.arange(len(texts))
    for name in order:
        if not len(alive):
            break
        bad = rules[name](texts)
        if bad.any():
            alive, texts = alive[~bad], texts.only(~bad)
    return alive


VERDICTS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, kept boolean")


def _judge(batches: Iterator[pa.RecordBatch], rules: dict[str, Rule], order: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, bounds in slices(batch["text"]):
            texts = Texts(data, bounds)
            n, repeated = texts.n_words, texts.repeated(3)
            failed = base_fails(texts)
            passed = np.zeros(len(texts), bool)
            good = np.flatnonzero(~failed)
            passed[good[cascade(texts.only(~failed), rules, order)]] = True
            columns = [n, texts.word_chars, texts.n_symbols, texts.lines[1], repeated, failed, passed]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, end - at), *map(pa.array, columns)], [
                "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])


def judge(docs: DataFrame, rules: dict[str, Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id (long), base statistics and verdict: one row per row of docs."""
    bounded_batches(docs.sparkSession)
    order = order_rules(docs, rules, sample_rows)
    return docs.select("doc_id", "text").mapInArrow(partial(_judge, rules=rules, order=order), VERDICTS)
