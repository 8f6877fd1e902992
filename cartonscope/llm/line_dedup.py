"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents is reduced to (key hash, number of documents). It is anti-joined with the
settled run, the keys already known to be common, and the rest is added as a sorted run of level 0.
When a level holds `fanout` runs they are merged into one run of the next level; keys whose summed
count reaches `min_docs` move to the settled run. Common keys are the settled run and what the open
runs sum to. Every line of a common key is dropped, in every document; other lines stay as they are.

A line's key is the line without ASCII whitespace at its ends, A-Z in lower case; keys stand as
128-bit hashes. Keys shorter than `min_chars` code points never count as common.

Defined cases: null or empty text is one empty line and stays empty; a document counts once for a key
however often it repeats it; equal rows are separate documents; an empty table gives an empty result.
Extra columns are kept; columns named line_* of the input are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartonscope.llm.common import bounded_batches, stored

COUNTS = "line_key binary, n long"


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def hashed(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def code_points(line: bytes) -> int:
    return len(line.decode())


class LineRuns:
    """The levelled runs. Each run is a table in the shared folder, sorted by key within its parts."""

    def __init__(self, min_docs: int = 10, fanout: int = 4):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None

    def add(self, counts: DataFrame) -> None:
        """One batch: line_key and n, one row per key."""
        if self.settled is not None:
            counts = counts.join(self.settled, "line_key", "left_anti")
        self._push(0, counts)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._compact(level)
            level += 1

    def _run(self, counts: DataFrame) -> DataFrame:
        return stored(counts.sortWithinPartitions("line_key"), "line-run")

    def _push(self, level: int, counts: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._run(counts))

    def _summed(self, runs: list[DataFrame]) -> DataFrame:
        total = runs[0]
        for run in runs[1:]:
            total = total.unionByName(run)
        return total.groupBy("line_key").agg(F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        merged = self._run(self._summed(self.levels[level]))
        self.levels[level] = []
        common = merged.filter(F.col("n") >= self.min_docs).select("line_key")
        self.settled = common if self.settled is None else self._run(self.settled.unionByName(common).distinct())
        self._push(level + 1, merged.filter(F.col("n") < self.min_docs))

    def common(self) -> DataFrame:
        """Keys found in min_docs documents or more, one row each."""
        runs = [run for level in self.levels for run in level]
        found = self._summed(runs).filter(F.col("n") >= self.min_docs).select("line_key")
        return found if self.settled is None else found.unionByName(self.settled).distinct()


def _keys_of(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, key = [], []
            for rid, text in zip(batch["line_row"].to_pylist(), batch["text"].cast(pa.large_binary())):
                found = {line_key(line) for line in (text.as_py() or b"").split(b"\n")}
                found = [hashed(k) for k in found if len(k) >= min_chars and code_points(k) >= min_chars]
                row += [rid] * len(found)
                key += found
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(key, pa.binary())], ["line_row", "line_key"])
    return keys


def _filtered(min_chars: int):
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, common in zip(batch["line_text"].cast(pa.large_binary()), batch["line_common"]):
                text, common = text.as_py() or b"", set(common.as_py() or ())
                all_lines = text.split(b"\n")
                kept = [x for x in all_lines if hashed(line_key(x)) not in common] if common else all_lines
                texts.append(b"\n".join(kept).decode())
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
            keep = [c for c in batch.schema.names if c not in ("line_text", "line_common")]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + [
                pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                keep + ["line_kept", "line_n", "line_dropped"])
    return drop


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3,
                text_col: str = "text") -> DataFrame:
    """docs with line_kept (the text without common lines), line_n and line_dropped.

    The table is taken in `batches` as if they had arrived one after the other.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.startswith("line_")])
    # A row is known by its content; equal rows have equal lines and so share what is found for them.
    row = F.xxhash64(*[F.col(c) for c in docs.columns if c in ("doc_id", text_col)])
    lines = docs.select(row.alias("line_row"), F.col(text_col).alias("text")).mapInArrow(
        _keys_of(min_chars), "line_row long, line_key binary")
    lines = stored(lines.withColumn("line_batch", F.pmod(F.col("line_row"), F.lit(batches)).cast("int")), "lines", "line_batch")
    runs = LineRuns(min_docs, fanout)
    for k in range(batches):
        runs.add(lines.filter(F.col("line_batch") == k).groupBy("line_key").agg(F.count(F.lit(1)).alias("n")))
    common = stored(runs.common(), "common-lines")
    hits = (lines.select("line_row", "line_key").join(common, "line_key", "left_semi")
            .groupBy("line_row").agg(F.collect_set("line_key").alias("line_common")))
    joined = (docs.withColumn("line_row", row).join(hits, "line_row", "left").drop("line_row")
              .withColumn("line_text", F.col(text_col)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(_filtered(min_chars), f"{schema}, line_kept string, line_n long, line_dropped long")
