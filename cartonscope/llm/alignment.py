"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in the corpus.

Tokenizer A reads a space and the text, tokenizer B the text, which adds that space itself. Tokens of both lie on one axis of
bytes: all are sorted by start (lexsort), the running maximum of their ends is taken, and a group of tokens begins where a start
reaches that maximum. Every token of A in a group is linked with every token of B in it.

Texts are cut before single spaces that end a token of both: A never carries a space's left neighbour into the next word, and no piece of B
holds a space behind another character (checked when B is loaded). A cut stands only between a character that is no space
and one that is neither white space nor begins like Unicode white space. So each distinct piece is encoded and aligned once for
a worker; results are those of whole texts (`tests/llm/test_tokens.py` compares them with plain code).

Counts over the corpus: a block of documents writes its distinct id pairs with the documents that hold each; these meet by pair in a
shuffle, are added up, and go back to their blocks, one row a block and pair. No pair has more rows than there are blocks, no table
of pairs is broadcast or collected. Links of a group are counted as distinct ids with multiplicities, never listed one by one.

Defined cases: null and empty texts, and texts whose tokens do not give back a space and the text (a literal U+2581 does that), have no tokens:
zeros and ''. Equal rows and ids are documents of their own. A document is held whole by its task, at some ten times its size. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartonscope.llm.common import bounded_batches, packed, shared_folder, slices, stored, unpacked
from cartonscope.llm.tokens import AT_ONCE, Remembered, flat, load_tokenizer, runs

#: Bytes of text whose documents form a block.
BLOCK_BYTES = 4 << 20
#: Distinct pieces that a worker remembers, some 200 bytes each.
REMEMBERED = 1 << 19
#: First bytes of characters among which there is white space beyond ASCII.
WIDE_BLANKS = (0xC2, 0xE1, 0xE2, 0xE3)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in entries of byte-level vocabularies: itself where it is printable, else the next
    free character from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A: ids of texts and the bytes of an id."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path, plain_specials=True)
        alphabet = byte_alphabet()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(c in alphabet for c in entry):
                self.bytes[i] = bytes(map(alphabet.__getitem__, entry))

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a space behind another character; texts cannot be cut at spaces")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def groups(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B: maximal runs of tokens, by start, in which each starts before the others' furthest end."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((end, start))
    furthest = np.maximum.accumulate(end[order])
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= furthest[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(begins) - 1
    return group[:len(a_start)], group[len(a_start):]


def _distinct(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) by group, and how often each occurs."""
    keys, counts = np.unique(group << 32 | ids, return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, counts


def _joined(texts: pa.Array, bounds: np.ndarray, by: str) -> pa.Array:
    """Runs of texts, each joined by `by`."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), texts.cast(pa.large_string())), pa.scalar(by, pa.large_string()))


class Aligned:
    """What is known of distinct pieces: whether they round-trip, counts, groups as text, linked id pairs with multiplicities."""

    def __init__(self, a: ByteLevel, b: Pieces, most: int = REMEMBERED):
        self.a, self.b = a, b
        self.a_len, self.b_len = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        self._forget()
        self.places = Remembered(self._learn, self._forget, most)

    def _forget(self) -> None:
        self.ok = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)
        self.texts = pa.array([], pa.large_string())
        self.pairs, self.times, self.bounds = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        found = [self._aligned(pieces[at:at + AT_ONCE]) for at in range(0, len(pieces), AT_ONCE)]
        ok, counts, texts, pairs, times, n_pairs = zip(*found)
        self.ok, self.counts = np.concatenate([self.ok, *ok]), np.concatenate([self.counts, *counts])
        self.texts = pa.concat_arrays([self.texts, *texts])
        self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(n_pairs))])

    def _aligned(self, pieces: list[str]) -> tuple:
        a_lists, b_lists = self.a(pieces), self.b(pieces)
        a_bytes, b_bytes = self.a.bytes.__getitem__, self.b.bytes.__getitem__
        ok = np.zeros(len(pieces), bool)
        for i, (piece, x, y) in enumerate(zip(pieces, a_lists, b_lists)):
            raw = piece.encode()
            ok[i] = b"".join(map(a_bytes, x)) == raw and b"".join(map(b_bytes, y)) == raw
            if not ok[i]:
                a_lists[i] = b_lists[i] = []
        (a, n_a), (b, n_b) = (flat(lists, lambda some: some) for lists in (a_lists, b_lists))
        a, b = a.astype(np.int64), b.astype(np.int64)
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        a_group, b_group = groups(a_end - self.a_len[a], a_end, b_end - self.b_len[b], b_end)
        n = int(a_group[-1]) + 1 if len(a) else 0
        edges = lambda g: np.searchsorted(g, np.arange(n + 1))  # noqa: E731  tokens stand in order, so groups do
        a_at, b_at = edges(a_group), edges(b_group)
        # Pieces lie one behind the other on the axis, so a group is of one piece: that of its first token of A.
        piece_of = np.repeat(np.arange(len(pieces)), n_a)[a_at[:-1]] if n else np.zeros(0, np.int64)
        n_groups = np.bincount(piece_of, minlength=len(pieces))
        n_links = np.bincount(piece_of, np.diff(a_at) * np.diff(b_at), len(pieces)).astype(np.int64)
        both = pc.binary_join_element_wise(_joined(pa.array(a), a_at, ","), _joined(pa.array(b), b_at, ","), pa.scalar("|", pa.large_string()))
        bounds = np.concatenate([[0], np.cumsum(n_groups)])
        texts = _joined(both, bounds, ";")
        # Links of a group: its distinct ids of A against its distinct ids of B.
        ga, ia, ca = _distinct(a_group, a)
        gb, ib, cb = _distinct(b_group, b)
        first, per = edges(gb)[ga], np.diff(edges(gb))[ga]
        right = runs(first, per)
        pairs, times = np.repeat(ia, per) << 32 | ib[right], np.repeat(ca, per) * cb[right]
        n_pairs = np.bincount(piece_of[np.repeat(ga, per)], minlength=len(pieces))
        return ok, np.stack([n_a, n_b, n_groups, n_links], 1), texts, pairs, times, n_pairs


@lru_cache(maxsize=1)
def aligned_pieces(a_path: str, b_path: str, most: int) -> Aligned:
    """The worker's pieces; it keeps them until it ends or reads other vocabularies."""
    return Aligned(ByteLevel(a_path), Pieces(b_path), most)


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of texts that each start with a space: at every text, and before spaces that both tokenizers keep with
    the next word."""
    may = np.zeros(len(data), bool)
    if len(data) > 2:
        after = np.ones(256, bool)
        after[:0x21] = False
        after[list(WIDE_BLANKS)] = False
        may[1:-1] = (data[1:-1] == 0x20) & (data[:-2] != 0x20) & after[data[2:]]
    # A space at the end of a text is followed by the next text's space, so that it is no cut.
    may[begins] = True
    return np.flatnonzero(may)


class Block:
    """Documents of one block: their pieces as places in what is known."""

    def __init__(self, known: Aligned, texts: list[str]):
        spaced = [" " + t for t in texts]
        raw = [t.encode() for t in spaced]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begins = np.cumsum(sizes) - sizes
        data = b"".join(raw)
        at = cuts(np.frombuffer(data, np.uint8), begins) if texts else np.zeros(0, np.int64)
        self.first = np.searchsorted(at, begins)
        self.per = np.diff(np.append(self.first, len(at)))
        offsets = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        coded = pa.LargeStringArray.from_buffers(len(at), offsets, pa.py_buffer(data)).dictionary_encode()
        distinct, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        place = known.places(distinct)
        bad = np.add.reduceat(~known.ok[place][code], self.first) > 0 if len(at) else np.zeros(0, bool)
        if bad.any():
            # Whole texts decide for documents with a piece that does not round-trip.
            whole = np.flatnonzero(bad)
            distinct = pa.concat_arrays([distinct, pa.array([spaced[i] for i in whole], pa.large_string())])
            kept = ~np.repeat(bad, self.per)
            per = np.where(bad, 1, self.per)
            new = np.empty(int(per.sum()), np.int64)
            slot = np.repeat(bad, per)
            new[~slot], new[slot] = code[kept], len(distinct) - len(whole) + np.arange(len(whole))
            code, self.per, self.first = new, per, np.cumsum(per) - per
            unique = distinct.dictionary_encode()
            code, distinct = unique.indices.to_numpy().astype(np.int64)[code], unique.dictionary
            place = known.places(distinct)
        self.known, self.place, self.code = known, place, code

    def counts(self) -> np.ndarray:
        """n_a, n_b, n_groups, n_links of every document."""
        of_piece = self.known.counts[self.place]
        return np.add.reduceat(of_piece[self.code], self.first) if len(self.code) else np.zeros((0, 4), np.int64)

    def digests(self, with_tokens: np.ndarray) -> list[str]:
        texts = self.known.texts.take(pa.array(self.place))
        out = []
        for first, n, some in zip(self.first.tolist(), self.per.tolist(), with_tokens.tolist()):
            if not some:
                out.append("")
                continue
            digest = hashlib.sha256()
            for at in range(first, first + n, 1 << 16):
                part = texts.take(pa.array(self.code[at:min(at + (1 << 16), first + n)]))
                digest.update((";" if at > first else "").encode() + ";".join(part.to_pylist()).encode())
            out.append(digest.hexdigest())
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct id pairs; and by document its pairs: document, place among the distinct, links."""
        known, n_docs, width = self.known, len(self.per), max(1, len(self.place))
        keys, times = np.unique(np.repeat(np.arange(n_docs), self.per) * width + self.code, return_counts=True)
        doc, piece = keys // width, self.place[keys % width]
        n = np.diff(known.bounds)[piece]
        spot = runs(known.bounds[piece], n)
        pairs, pair = np.unique(known.pairs[spot], return_inverse=True)
        links = known.times[spot] * np.repeat(times, n)
        keys, back = np.unique(np.repeat(doc, n) * max(1, len(pairs)) + pair, return_inverse=True)
        return pairs, keys // max(1, len(pairs)), keys % max(1, len(pairs)), np.bincount(back, links, len(keys)).astype(np.int64)


ROWS = ("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, n_pairs int, pair binary, links binary, "
        "block_pairs int, pairs binary, pair_docs binary")


def _blocks(a_path: str, b_path: str, block_bytes: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligned_pieces(a_path, b_path, most), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end, _, _ in slices(batch["text"], block_bytes):
                block = Block(known, batch["text"].slice(at, end - at).fill_null("").to_pylist())
                counts = block.counts()
                some = counts[:, 0] > 0
                pairs, doc, pair, links = block.links()
                n = np.bincount(doc, minlength=end - at)
                last = np.cumsum(n)
                nothing = [None] * (end - at - 1)
                cut = lambda x: pa.array([packed(x[e - k:e]) for k, e in zip(n.tolist(), last.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(at, end - at), *[pa.array(counts[:, i]) for i in range(4)], pa.array(block.digests(some), pa.string()),
                     pa.array(np.full(end - at, number)), pa.array(n.astype(np.int32)), cut(pair.astype(np.uint32)), cut(links.astype(np.uint64)),
                     pa.array([len(pairs), *nothing], pa.int32()), pa.array([packed(pairs), *nothing], pa.binary()),
                     pa.array([packed(np.bincount(pair, minlength=len(pairs)).astype(np.int32)), *nothing], pa.binary())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "n_pairs", "pair", "links", "block_pairs", "pairs", "pair_docs"])
                number += 1
    return run


def _listed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            n = row["block_pairs"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["block"])), pa.array(np.arange(n, dtype=np.int32)), pa.array(unpacked(row["pairs"], n, np.int64)),
                                              pa.array(unpacked(row["pair_docs"], n, np.int32))], ["block", "at", "pair", "docs"])


def _summed(id_type: str):
    def run(docs: pa.Table, counted: pa.Table) -> pa.Table:
        size = counted.num_rows
        count, best, at = np.zeros(size, np.int64), np.zeros(size, bool), counted["at"].to_numpy()
        count[at], best[at] = counted["count"].to_numpy(), counted["best"].to_numpy()
        n_best, count_sum = [], []
        for n, pair, links in zip(*(docs[c].to_pylist() for c in ("n_pairs", "pair", "links"))):
            pair, links = unpacked(pair, n, np.uint32), unpacked(links, n, np.uint64).astype(np.int64)
            n_best.append(int(links[best[pair]].sum()))
            count_sum.append(int((links * count[pair]).sum()))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table({**{c: docs[c] for c in names}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()),
                         "groups_sha256": docs["groups_sha256"]})
    return run, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                   block_bytes: int = BLOCK_BYTES, most: int = REMEMBERED) -> DataFrame:
    """Stored: a row a document with its counts, digest and packed links; the first row of a block has the block's pairs too."""
    bounded_batches(docs.sparkSession)
    shared_folder(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(_blocks(a_path, b_path, block_bytes, most), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ROWS}"), "aligned")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A's id << 32 | B's id), count (documents that hold it linked), best (none of A's id's pairs has more)."""
    listed = blocks.filter("pairs is not null").mapInArrow(_listed_pairs, "block long, at int, pair long, docs int")
    counted = listed.groupBy("pair").agg(F.sum("docs").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.call_function("shiftright", F.col("pair"), F.lit(32))))
    return counted.withColumn("best", F.col("count") == most)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          block_bytes: int = BLOCK_BYTES, most: int = REMEMBERED) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of docs.

    n_best: links whose pair no other pair of its A id exceeds in documents; count_sum: documents of the pair, summed over links.
    """
    blocks = aligned_blocks(docs, a_path, b_path, id_col, text_col, block_bytes, most)
    listed = blocks.filter("pairs is not null").mapInArrow(_listed_pairs, "block long, at int, pair long, docs int")
    counted = listed.select("block", "at", "pair").join(pair_counts(blocks), "pair").select("block", "at", "count", "best")
    run, schema = _summed(blocks.schema["doc_id"].dataType.simpleString())
    return blocks.drop("pairs", "pair_docs", "block_pairs").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(run, schema)
