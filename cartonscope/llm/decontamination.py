"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: a shard holds a few hundred whole documents and, for each term in
them, the sorted list of places where it stands. Nothing of it is shuffled, and a term in a third of
all documents is spread over all shards. The benchmark is the query set, taken in blocks of bounded
size; each block goes to every shard. Terms of a window are taken from the rarest in the corpus:
its list, moved back by the term's place in the window, gives the candidates, which every further
list then thins out. With slop 0 what is left are exact phrases; with slop s, windows for which there is
a start such that all terms, the rarest too, stand within s places of where the phrase would have them
(proximity matches): the rarest term's list is then moved to every start within s of it.

Defined cases: null, empty or wordless texts have no words and no hits; items without words match
nothing; an item shorter than a window is one window; repeated items, documents and ids each count
for themselves; an empty benchmark leaves every document clean. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartonscope.llm.common import NOT_ALNUM, Words, bounded_batches, shared_folder, slices, stored

#: Characters of benchmark text in one block of queries; a block is broadcast.
BLOCK_CHARS = 8 << 20
SHARD = "shard long, bench_row array<long>, n_words array<int>, term binary, size binary, place binary"


def _terms(sorted_terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted_terms, -1 where it is not there."""
    if not len(sorted_terms):
        return np.full(len(hashes), -1)
    at = np.searchsorted(sorted_terms, hashes)
    at[at == len(sorted_terms)] = 0
    return np.where(sorted_terms[at] == hashes, at, -1)


def index(docs: DataFrame, window: int, slop: int = 0, terms: np.ndarray | None = None, row_col: str = "bench_row") -> DataFrame:
    """Shards of postings. `terms`: the only ones that will be asked for; None keeps all.

    Places count through the shard, with a gap after each document that no window spans. A row of docs is known by
    its shard's number, which holds from when the shards are written, and its place in the shard."""
    words = Words(NOT_ALNUM)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch["bench_row"].to_pylist()
            for at, end, data, bounds in slices(batch["text"]):
                hashes, _, per_text = words(data, bounds)
                gap = np.repeat(np.arange(end - at) * (window + 2 * slop), per_text)
                place = (np.arange(len(hashes)) + gap).astype(np.int32)
                if terms is not None:
                    known = _terms(terms, hashes) >= 0
                    hashes, place = hashes[known], place[known]
                order = np.argsort(hashes, kind="stable")
                term, size = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard]), pa.array([ids[at:end]], pa.list_(pa.int64())), pa.array([per_text.astype(np.int32)], pa.list_(pa.int32())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (term, size.astype(np.int32), place[order]))],
                    ["shard", "bench_row", "n_words", "term", "size", "place"])
                shard += 1

    return docs.select(F.col(row_col).alias("bench_row"), F.col("text")).mapInArrow(build, SHARD)


def term_counts(shards: DataFrame) -> DataFrame:
    """How often each term stands in the corpus, summed map-side in each task's shards."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in batch["term"]])
            size = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in batch["size"]])
            term, of = np.unique(term, return_inverse=True)
            total = np.bincount(of, size, len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(total)], ["term", "n"])

    return shards.select("term", "size").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def query_windows(items: list[tuple[object, str | None]], window: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of items: item ids, item number of each window, its length, and its terms (0-padded)."""
    words = Words(NOT_ALNUM)
    ids, number, lengths, rows = [], [], [], []
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        hashes, _, _ = words(data, np.array([0, len(data)]))
        if not len(hashes):
            continue
        length = min(window, len(hashes))
        for row in np.lib.stride_tricks.sliding_window_view(hashes, length):
            rows.append(np.pad(row, (0, window - length)))
            number.append(len(ids))
            lengths.append(length)
        ids.append(item)
    return ids, np.array(number, np.int64), np.array(lengths, np.int64), np.array(rows, np.uint64).reshape(len(rows), window)


class WindowSearch:
    """The windows of one block, ready to be put to any shard."""

    def __init__(self, ids: list, number: np.ndarray, lengths: np.ndarray, rows: np.ndarray, counts: dict[int, int], slop: int):
        self.ids, self.number, self.lengths, self.slop = ids, number, lengths, slop
        width = rows.shape[1]
        inside = np.arange(width) < lengths[:, None]
        vocab, code = np.unique(rows, return_inverse=True)
        code = code.reshape(rows.shape)
        often = np.array([counts.get(int(v), 0) for v in vocab.view(np.int64)], np.int64)
        # Places of a window from its rarest term on; padding comes last.
        self.order = np.argsort(np.where(inside, often[code], np.iinfo(np.int64).max), axis=1, kind="stable")
        self.vocab, self.code, self.inside = vocab, code, inside
        self.alive = np.flatnonzero((often[code] > 0).__or__(~inside).all(axis=1))

    def matches(self, term: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, start and whether exact, for all matches in a shard."""
        begins = np.concatenate([[0], np.cumsum(size)])
        at = _terms(term, self.vocab)
        first, many = np.where(at >= 0, begins[at], 0), np.where(at >= 0, size[at] if len(size) else 0, 0)
        rows = self.alive
        here = ((many[self.code[rows]] > 0) | ~self.inside[rows]).all(axis=1)
        rows = rows[here]
        if not len(rows):
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        anchor = self.order[rows, 0]
        of = self.code[rows, anchor]
        n = many[of].astype(np.int64)
        window = np.repeat(rows, n)
        start = place[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of], n)].astype(np.int64) - np.repeat(anchor, n)
        if self.slop:
            # Lists whose places are close give the same start more than once.
            moves = np.arange(-self.slop, self.slop + 1)
            window, start = np.repeat(window, len(moves)), (start[:, None] + moves).ravel()
            order = np.lexsort((start, window))
            window, start = window[order], start[order]
            fresh = np.concatenate([[True], (window[1:] != window[:-1]) | (start[1:] != start[:-1])])
            window, start = window[fresh], start[fresh]
        exact = np.ones(len(window), bool)
        # One sorted key of code and place answers whether any term stands at any place.
        code_of = np.full(len(term), -1)
        code_of[at[at >= 0]] = np.flatnonzero(at >= 0)
        span = np.int64(place.max()) + 4 * (self.code.shape[1] + self.slop) + 4 if len(place) else np.int64(1)
        margin = self.code.shape[1] + self.slop + 1
        known = np.repeat(code_of, size)
        keys = known[known >= 0] * span + place[known >= 0] + margin
        keys.sort()
        # With slop the rarest term is looked up too, since only one of its starts has it in its exact place.
        for k in range(0 if self.slop else 1, self.code.shape[1]):
            if not len(window):
                break
            spot = self.order[window, k]
            asked = self.inside[window, spot]
            goal = self.code[window, spot] * span + start + spot + margin
            low = np.searchsorted(keys, goal - self.slop)
            low[low == len(keys)] = len(keys) - 1
            near = (keys[low] >= goal - self.slop) & (keys[low] <= goal + self.slop)
            if self.slop:
                here = np.minimum(np.searchsorted(keys, goal), len(keys) - 1)
                exact &= ~asked | (keys[here] == goal)
            keep = ~asked | near
            window, start, exact = window[keep], start[keep], exact[keep]
        return window, start, exact


FOUND = "shard long, at int, bench_row long, n_words int, hit binary, items array<string>, near_items array<string>"


def _search(search: WindowSearch, window: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, n_words = row["bench_row"], np.array(row["n_words"], np.int64)
                begin = np.cumsum(n_words) - n_words + np.arange(len(ids)) * (window + 2 * slop)
                found, start, exact = search.matches(*(np.frombuffer(row[c], t) for c, t in (
                    ("term", np.uint64), ("size", np.int32), ("place", np.int32))))
                doc = np.searchsorted(begin, start + (0 if slop == 0 else slop), "right") - 1
                hit, items, near = [None] * len(ids), [()] * len(ids), [()] * len(ids)
                for d in np.unique(doc):
                    mine = doc == d
                    w, s, e = found[mine], start[mine] - begin[d], exact[mine]
                    edge = np.zeros(n_words[d] + 1, np.int64)
                    np.add.at(edge, s[e], 1)
                    np.add.at(edge, s[e] + search.lengths[w[e]], -1)
                    places = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                    hit[d] = places.astype(np.int32).tobytes()
                    items[d] = [search.ids[i] for i in np.unique(search.number[w[e]])]
                    near[d] = [search.ids[i] for i in np.setdiff1d(search.number[w[~e]], search.number[w[e]])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(ids), pa.int64()), pa.array(range(len(ids)), pa.int32()), pa.array(ids, pa.int64()), pa.array(n_words.astype(np.int32)), pa.array(hit, pa.binary()),
                    pa.array(items, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))],
                    ["shard", "at", "bench_row", "n_words", "hit", "items", "near_items"])
    return run


def _union_of_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(set().union(*(np.frombuffer(h, np.int32).tolist() for h in hits if h))) for hits in batch["hits"].to_pylist()]
        keep = [c for c in batch.schema.names if c != "hits"]
        yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [pa.array(n, pa.int64())], [*keep, "n_hit"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int = 0, block_chars: int = BLOCK_CHARS,
                  row_col: str = "bench_row") -> DataFrame:
    """bench_row, n_words, n_hit, items (ids of exactly matching items), near_items (those matching only
    within slop): one row per row of docs, which must have row_col (long) and text.
    row_col is only passed on: rows that share it, or have none, stay rows of their own however many blocks there are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared_folder(spark)
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // block_chars
    found = None
    shards = counts = None
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        ids, number, lengths, rows = query_windows([tuple(r) for r in block.toLocalIterator()], window)
        terms = np.unique(rows)
        if shards is None:
            shards = stored(index(docs, window, slop, terms if blocks == 1 else None, row_col), "postings")
            counts = stored(term_counts(shards), "term-counts") if blocks > 1 else term_counts(shards)
        wanted = counts
        if blocks > 1:
            wanted = counts.join(F.broadcast(spark.createDataFrame([(int(t),) for t in terms.view(np.int64)], "term long")), "term")
        search = WindowSearch(ids, number, lengths, rows, {r.term: r.n for r in wanted.collect()}, slop)
        part = shards.mapInArrow(_search(search, window, slop), FOUND)
        found = part if found is None else found.unionByName(part)
    if blocks == 1:
        return found.select("bench_row", F.col("n_words").cast("long"),
                            F.coalesce(F.length("hit") / 4, F.lit(0)).cast("long").alias("n_hit"), "items", "near_items")
    merged = found.groupBy("shard", "at").agg(
        F.first("bench_row").alias("bench_row"), F.max("n_words").cast("long").alias("n_words"), F.collect_list("hit").alias("hits"),
        F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items")).drop("shard", "at")
    return merged.mapInArrow(_union_of_hits, "bench_row long, n_words long, items array<string>, near_items array<string>, n_hit long")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the rows that hold a benchmark window; other rows unchanged."""
    row = F.xxhash64("doc_id", "text")  # equal rows share their verdict
    dirty = contamination(docs.select(row.alias("bench_row"), "text"), benchmark, window).filter("n_hit > 0")
    key = "bench_row"
    while key in docs.columns:
        key += "_"
    return (docs.withColumn(key, row).join(dirty.select(F.col("bench_row").alias(key)).distinct(), key, "left_anti")
            .select(*docs.columns))
