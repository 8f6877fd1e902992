"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of every document are computed in one pass. The cosine of D random projections of them
approximates a Gaussian kernel; partitions sum the normal equations, so the driver sees D x D numbers
whatever the number of labelled rows. Ridge scores are then made monotone with the share of good
rows: they are counted in a fixed number of score bins, and the bins' shares are pooled (pool adjacent
violators).

Learns from all labelled rows outside the held-out remainder. Labels, lang, source and doc_id are no inputs.

Defined cases: null, empty and wordless texts have zero statistics and get a score like any other;
null labels are left out; several labels of an id each count; equal rows are separate documents;
without any label to learn from the score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartonscope.llm import text_stats as S
from cartonscope.llm.common import bounded_batches, partition_sums, remainder, shared_folder, slices, stored
from cartonscope.llm.text_stats import Texts

#: Random features, width of the kernel over standardised statistics, ridge penalty per labelled row, score bins.
FEATURES, WIDTH, PENALTY, BINS = 256, 4.0, 1e-4, 400
LOW, HIGH = -0.5, 1.5


def statistics(texts: Texts) -> np.ndarray:
    """A row of bounded statistics for each text."""
    k = texts.kinds.astype(float)
    words, chars = texts.n_words.astype(float), np.maximum(texts.word_chars, 1).astype(float)
    per_word = lambda x: x / np.maximum(words, 1)
    lines, again = (x.astype(float) for x in texts.lines)
    distinct, most = (x.astype(float) for x in texts.vocabulary)
    letters = np.maximum(k[:, S.UPPER] + k[:, S.LOWER] + k[:, S.LEAD], 1)
    columns = [np.log1p(words), np.minimum(per_word(chars), 30), k[:, S.UPPER] / letters, k[:, S.LEAD] / letters,
               k[:, S.DIGIT] / chars, np.sqrt(per_word(k[:, S.SYMBOL])), np.sqrt(per_word(k[:, S.BANG])), per_word(k[:, S.STOP]),
               np.sqrt(k[:, S.OTHER] / chars), np.log1p(lines), per_word(lines), again / np.maximum(lines, 1),
               per_word(distinct), per_word(most), per_word(texts.repeated(2)), per_word(texts.repeated(4)),
               (k[:, S.BLANK] + k[:, S.BREAK]) / np.maximum(k.sum(1), 1)]
    return np.minimum(np.stack(columns, axis=1), 30.0)


N_STATISTICS = 17


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, bounds in slices(batch["text"]):
            found = statistics(Texts(data, bounds)).astype(np.float32)
            offsets = pa.array(np.arange(end - at + 1, dtype=np.int32) * N_STATISTICS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, end - at), batch["held"].slice(at, end - at),
                                              pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["doc_id", "held", "stats"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy().astype(float).reshape(-1, N_STATISTICS)


class Classifier:
    """Fitted parts; without labelled rows `weights` is None and every score 0.5."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.projection = rng.normal(size=(N_STATISTICS, FEATURES)) / WIDTH
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.mean, self.spread = np.zeros(N_STATISTICS), np.ones(N_STATISTICS)
        self.weights: np.ndarray | None = None
        self.centres = self.shares = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos((stats - self.mean) / self.spread @ self.projection + self.phase)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        return np.interp(self.features(stats) @ self.weights, self.centres, self.shares)

    def fit(self, labelled: DataFrame) -> Classifier:
        """labelled: stats and y (0 or 1)."""
        def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(1 + 2 * N_STATISTICS)
            for x in map(_matrix, batches):
                out += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
            return out

        n, *rest = partition_sums(labelled.select("stats"), moments)  # type: ignore[misc]
        if not n:
            return self
        rest = np.array(rest) / n
        self.mean = rest[:N_STATISTICS]
        self.spread = np.sqrt(np.maximum(rest[N_STATISTICS:] - self.mean ** 2, 1e-6))
        size = FEATURES + 1

        def equations(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            left, right = np.zeros((size, size)), np.zeros(size)
            for batch in batches:
                z, y = self.features(_matrix(batch)), batch["y"].to_numpy().astype(float)
                left += z.T @ z
                right += z.T @ y
            return np.concatenate([left.ravel(), right])

        total = partition_sums(labelled, equations)
        left, right = total[:-size].reshape(size, size), total[-size:]
        penalty = np.full(size, PENALTY * n)
        penalty[-1] = 1e-9
        self.weights = np.linalg.solve(left + np.diag(penalty), right)

        def binned(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros((2, BINS))
            for batch in batches:
                raw = self.features(_matrix(batch)) @ self.weights
                at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
                out += [np.bincount(at, minlength=BINS), np.bincount(at, batch["y"].to_numpy().astype(float), BINS)]
            return out.ravel()

        count, good = partition_sums(labelled, binned).reshape(2, BINS)
        self.centres, self.shares = isotonic(count, good)
        return self


def isotonic(count: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the bins in use and their pooled, rising shares."""
    used = np.flatnonzero(count)
    pools: list[list[float]] = []
    for k in used:
        pools.append([count[k], good[k], 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, g, m = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + g, pools[-1][2] + m]
    shares = np.concatenate([np.full(int(m), g / n) for n, g, m in pools])
    return LOW + (used + 0.5) * (HIGH - LOW) / BINS, shares


def document_statistics(docs: DataFrame, modulus: int, held: int) -> DataFrame:
    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held")
    return docs.select("doc_id", "text", held_out).mapInArrow(_statistics, "doc_id long, held boolean, stats array<float>")


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Classifier:
    known = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    labelled = stored(stats.filter("not held").join(known, "doc_id").select("stats", "y"), "labelled")
    return Classifier().fit(labelled)


def _scores(batches: Iterator[pa.RecordBatch], model: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held"], pa.array(model.score(_matrix(batch)))], ["doc_id", "held_out", "score"])


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score: one row per row of docs (doc_id long, text)."""
    bounded_batches(docs.sparkSession)
    shared_folder(docs.sparkSession)
    stats = stored(document_statistics(docs, modulus, held), "statistics")
    return stats.mapInArrow(partial(_scores, model=fit(stats, labels)), "doc_id long, held_out boolean, score double")


def _accept(batches: Iterator[pa.RecordBatch], model: Classifier, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = [model.score(statistics(Texts(data, bounds))) for _, _, data, bounds in slices(batch["text"])]
        if score:
            yield batch.filter(pa.array(np.concatenate(score) >= threshold))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held: int = 0) -> DataFrame:
    """The rows of docs whose score reaches the threshold, unchanged."""
    bounded_batches(docs.sparkSession)
    shared_folder(docs.sparkSession)
    model = fit(document_statistics(docs, modulus, held), labels)
    return docs.mapInArrow(partial(_accept, model=model, threshold=threshold), docs.schema)
