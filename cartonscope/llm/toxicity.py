"""Toxicity by weak supervision.

Many voters look at each text: a fixed lexicon, lexicons and word-beginning patterns mined from a
bounded sample of labelled training rows, and patterns over how dense and how varied such hits are.
Each votes toxic or not. A generative label model then explains the votes of all documents by a
hidden class: it estimates each voter's accuracies by expectation-maximisation over the counts of
vote patterns, and from what pairs of voters still share within a class how correlated they are;
correlated voters are discounted. Its posteriors label all documents, and a logistic regression over
hit rates, fitted to them by Newton steps on partition sums, gives the scores.

Defined cases: null, empty and wordless texts have no hits and a low score; null labels are left
out; equal rows are separate documents; null ids count as empty text in the split; without labelled
rows only the fixed lexicon speaks; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartonscope.llm.common import NOT_ALNUM, Words, bounded_batches, mix, partition_sums, remainder, shared_folder, slices, stored, sums

#: Common English insults.
LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "trash", "garbage", "scum", "clown", "fool", "worthless", "pathetic",
           "disgusting", "imbecile", "jerk", "vermin", "filth", "freak", "coward", "liar")
#: Labelled rows from which patterns are mined, and how clearly a pattern must speak (twice the log likelihood ratio, and precision).
MINING_ROWS, MIN_SUPPORT, MIN_PRECISION = 8_192, 20.0, 0.85
#: Bytes of the word beginnings that count as patterns.
BEGINNINGS = (4, 5, 6)
GROUPS = 1 + 3 * (1 + len(BEGINNINGS))
VOTERS = GROUPS + 2
_WORDS = Words(NOT_ALNUM)


def patterns(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern hashes of every word, a row per kind (whole word, then each beginning), and words per text.
    A word too short for a beginning has 0 there."""
    hashes, starts, per_text = _WORDS(data, bounds)
    length = _WORDS.last_bytes(data, bounds) - starts + 1 if len(hashes) else starts
    rows = [hashes]
    padded = np.concatenate([_WORDS.fold[data], np.zeros(max(BEGINNINGS), np.uint8)])
    for n in BEGINNINGS:
        code = np.full(len(hashes), n, np.uint64)
        for k in range(n):
            code = code << np.uint64(8) | padded[starts + k]
        rows.append(np.where(length > n, mix(code), np.uint64(0)))
    return np.stack(rows), per_text


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of the partition each pattern stands."""
    keys, labels = [], []
    for batch in batches:
        y = batch["y"].to_numpy()
        for at, end, data, bounds in slices(batch["text"]):
            found, per_text = patterns(data, bounds)
            edges = np.concatenate([[0], np.cumsum(per_text)])
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                for kind, row in enumerate(found):
                    own = np.unique(row[a:b])
                    own = own[own != 0]
                    keys.append(own << np.uint64(2) | np.uint64(kind))
                    labels.append(np.full(len(own), y[at + i], np.int64))
    if keys:
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        label = np.concatenate(labels)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at[label == 1], minlength=len(key))),
                                          pa.array(np.bincount(at[label != 1], minlength=len(key)))], ["key", "bad", "good"])


def mined_patterns(docs: DataFrame, labels: DataFrame, modulus: int, held: int, rows: int) -> np.ndarray:
    """Sorted keys (hash and kind) of the patterns that mark toxic texts. At most `rows` ids, taken by hash, are
    read; they are broadcast, which that number bounds."""
    known = labels.filter(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), modulus) != held))
    picked = known.select("doc_id", F.col("toxic").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y")
    found = sample.mapInArrow(_mine, "key long, bad long, good long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = picked.agg(F.avg("y")).first()[0]
    if not share or share == 1:
        return np.zeros(0, np.uint64)
    precise = F.col("bad") / (F.col("bad") + F.col("good"))
    other = F.when(F.col("good") > 0, F.col("good") * F.log((1 - precise) / (1 - share))).otherwise(0.0)
    support = 2 * (F.col("bad") * F.log(precise / share) + other)
    keys = found.filter((F.col("bad") > 0) & (precise >= MIN_PRECISION) & (support >= MIN_SUPPORT)).select("key").collect()
    return np.sort(np.array([k.key for k in keys], np.int64).view(np.uint64))


def _lexicon() -> np.ndarray:
    joined = " ".join(LEXICON).encode()
    return np.sort(_WORDS(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))[0])


def group_hits(data: np.ndarray, bounds: np.ndarray, mined: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits of each group of patterns, texts' words, and distinct hits of texts (counted by their hashes)."""
    found, per_text = patterns(data, bounds)
    hits = np.zeros((len(per_text), GROUPS), np.int64)
    hit_any = np.zeros(found.shape[1], bool)

    def member(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return table[at] == keys

    listed = member(found[0], _LEXICON)
    hits[:, 0] = sums(listed.astype(np.int64), per_text)
    hit_any |= listed
    for kind, row in enumerate(found):
        hit = member(row << np.uint64(2) | np.uint64(kind), mined) & (row != 0)
        hit_any |= hit
        third = (row % np.uint64(3)).astype(int)
        for g in range(3):
            hits[:, 1 + 3 * kind + g] = sums((hit & (third == g)).astype(np.int64), per_text)
    row = np.repeat(np.arange(len(per_text)), per_text)[hit_any]
    pairs = np.unique(np.stack([row.astype(np.uint64), found[0][hit_any]]), axis=1)
    return hits, per_text, np.bincount(pairs[0].astype(int), minlength=len(per_text))


_LEXICON = _lexicon()


def _votes(batches: Iterator[pa.RecordBatch], mined: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end, data, bounds in slices(batch["text"]):
            hits, words, distinct = group_hits(data, bounds, mined)
            total = hits.sum(1)
            votes = np.concatenate([hits > 0, (distinct >= 2)[:, None], (100 * total > words)[:, None]], axis=1)
            mask = (votes << np.arange(VOTERS)).sum(1)
            features = np.concatenate([np.log1p(hits), np.log1p(distinct)[:, None], np.sqrt(total / np.maximum(words, 1))[:, None]], axis=1)
            offsets = pa.array(np.arange(end - at + 1, dtype=np.int32) * VOTERS)
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(at, end - at), batch["held"].slice(at, end - at), pa.array(mask.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(features.astype(np.float32).ravel()))], ["doc_id", "held", "mask", "features"])


class LabelModel:
    """Hidden class, voters' accuracies and pairwise correlations, from the counts of vote patterns."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, prior: float = 0.1, rounds: int = 60):
        votes = (masks[:, None] >> np.arange(VOTERS) & 1).astype(float)
        n = counts.sum()
        # A start that says what a vote means: toxic texts draw votes, others hardly any.
        on = np.array([np.full(VOTERS, 0.01), np.full(VOTERS, 0.5)])
        self.prior, self.weight = prior, np.ones(VOTERS)
        for _ in range(rounds):
            self.on = on
            post = self.posterior_of(votes)
            mass = np.array([counts * (1 - post), counts * post])
            # A light pull to the start keeps voters that never vote defined.
            on = (mass @ votes + np.array([[0.02], [1.0]])) / (mass.sum(1, keepdims=True) + 2)
            self.prior = float(np.clip(mass[1].sum() / max(n, 1), 1e-3, 0.5))
            self.weight = self._discounts(votes, mass, on)
        self.on = on

    def _discounts(self, votes: np.ndarray, mass: np.ndarray, on: np.ndarray) -> np.ndarray:
        """1 / (1 + correlations with other voters within the classes)."""
        self.correlation = np.zeros((VOTERS, VOTERS))
        for c in (0, 1):
            residual = (votes - on[c]) * np.sqrt(mass[c])[:, None]
            cover = residual.T @ residual
            scale = np.sqrt(np.maximum(np.diag(cover), 1e-9))
            self.correlation += np.where(np.minimum.outer(scale, scale) > 1e-3, cover / np.outer(scale, scale), 0) / 2
        return 1 / (1 + np.maximum(self.correlation - np.eye(VOTERS), 0).clip(max=1).sum(1))

    def posterior_of(self, votes: np.ndarray) -> np.ndarray:
        on = np.clip(self.on, 1e-4, 1 - 1e-4)
        odds = votes * np.log(on[1] / on[0]) + (1 - votes) * np.log((1 - on[1]) / (1 - on[0]))
        return 1 / (1 + np.exp(-np.clip(odds @ self.weight + np.log(self.prior / (1 - self.prior)), -30, 30)))

    def posterior(self, masks: np.ndarray) -> np.ndarray:
        return self.posterior_of((masks[:, None] >> np.arange(VOTERS) & 1).astype(float))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch["features"].flatten().to_numpy().astype(float).reshape(-1, VOTERS)
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def fit_linear(votes: DataFrame, labels: LabelModel, steps: int = 8, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression on posterior labels by Newton steps; each step sums over all rows of all partitions."""
    size = VOTERS + 1
    w = np.zeros(size)
    for _ in range(steps):
        def newton(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> np.ndarray:
            slope, curve = np.zeros(size), np.zeros((size, size))
            for batch in batches:
                x, y = _matrix(batch), labels.posterior(batch["mask"].to_numpy())
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                slope += x.T @ (y - p)
                curve += (x * (p * (1 - p))[:, None]).T @ x
            return np.concatenate([slope, curve.ravel()])

        found = partition_sums(votes, newton)
        if found is None:
            break
        ridge = np.diag(np.append(np.full(VOTERS, penalty), 1e-3))
        step = np.linalg.solve(found[size:].reshape(size, size) + ridge, found[:size] - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _scores(batches: Iterator[pa.RecordBatch], w: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = 1 / (1 + np.exp(-np.clip(_matrix(batch) @ w, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held"], pa.array(score)], ["doc_id", "held_out", "score"])


def score(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, mining_rows: int = MINING_ROWS) -> DataFrame:
    """doc_id, held_out, score: one row per row of docs (doc_id long, text)."""
    bounded_batches(docs.sparkSession)
    shared_folder(docs.sparkSession)
    mined = mined_patterns(docs, labels, modulus, held, mining_rows)
    held_out = (remainder(F.col("doc_id"), modulus) == held).alias("held")
    votes = stored(docs.select("doc_id", "text", held_out).mapInArrow(
        partial(_votes, mined=mined), "doc_id long, held boolean, mask long, features array<float>"), "votes")
    # At most 2 ** VOTERS patterns come to the driver.
    seen = votes.groupBy("mask").count().collect()
    model = LabelModel(np.array([r["mask"] for r in seen], np.int64), np.array([r["count"] for r in seen], float))
    w = fit_linear(votes.select("mask", "features"), model)
    return votes.select("doc_id", "held", "features").mapInArrow(partial(_scores, w=w), "doc_id long, held_out boolean, score double")
