"""Token ids of documents as Arrow files of equal-length sequences and masks.

Documents are encoded in ascending order of id and their ids, an end id after each document, run on through sequences of a
fixed length. A shard is one range of ids, two Arrow files in the layout of `pyarrow.ipc` files, not compressed:

    <shard>.arrow        input_ids fixed_size_list<uint16 or uint32>[length]; mask and ends fixed_size_list<bool>[length]
    <shard>.docs.arrow   the shard's documents in order: doc_id, n_tokens

All record batches of a shard but its last hold the same number of sequences, so sequence i is row i % rows of batch i // rows,
and a reader that maps the file gets ids and mask bits without a copy (`Shard.sequence`). `mask` tells tokens from the padding
behind a shard's last token; `ends` marks each document's end id, which may also occur inside a document.

Tasks write the files through pyarrow's file systems, under names of their own; the manifest names those of the attempts that
Spark kept, so that a lost or repeated task leaves no wrong shard. Nothing larger than a batch of texts is held.

Defined cases: null and empty texts are an end id alone; a null id stands first; rows of equal id stand in the order of a hash
of their texts, equal rows are interchangeable, each is a document; the range key goes on with the hash and a row number, so that
no id fills a shard of its own. An empty table gives an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartonscope.llm.common import bounded_batches, remove_at_exit, shared_folder, stored
from cartonscope.llm.tokens import text_encoder

LENGTH = 2048
#: Sequences of one record batch.
ROWS = 128
MANIFEST = "shard int, sequences string, docs string, n_docs long, n_tokens long"


def _layout(length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length)),
                      ("ends", pa.list_(pa.bool_(), length))])


def _listed(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([batch.schema.field("doc_id"), ("n_tokens", pa.int64())])


class _Sequences:
    """Cuts a run of ids into record batches of ROWS sequences."""

    def __init__(self, out: pa.NativeFile, length: int, rows: int, id_type: pa.DataType):
        self.length, self.rows, self.schema = length, rows, _layout(length, id_type)
        self.writer = pa.ipc.new_file(out, self.schema)
        self.ids, self.ends, self.held = [], [], 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        ends = np.zeros(len(ids), bool)
        ends[np.cumsum(counts) - 1] = True
        self.ids.append(ids)
        self.ends.append(ends)
        self.held += len(ids)
        full = self.length * self.rows
        if self.held >= full:
            ids, ends, whole = np.concatenate(self.ids), np.concatenate(self.ends), self.held // full * full
            for at in range(0, whole, full):
                self._write(ids[at:at + full], ends[at:at + full], full)
            self.ids, self.ends, self.held = [ids[whole:]], [ends[whole:]], self.held - whole

    def _write(self, ids: np.ndarray, ends: np.ndarray, n: int) -> None:
        pad = n - len(ids)
        columns = (np.pad(ids, (0, pad)), np.arange(n) < len(ids), np.pad(ends, (0, pad)))
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(c, f.type.value_type), self.length) for c, f in zip(columns, self.schema)],
            schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._write(np.concatenate(self.ids), np.concatenate(self.ends), -(-self.held // self.length) * self.length)
        self.writer.close()


def _writer(folder: str, tokenizer: str, end_id: int, length: int, rows: int, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer, end_id, by_word)
        wide = max(encoder.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        store, base = fs.FileSystem.from_uri(folder)
        shard, files, n_docs, n_tokens = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                name = f"{base}/{shard:06d}-{uuid.uuid4().hex}"
                files = [store.open_output_stream(f"{name}{x}.arrow") for x in ("", ".docs")]
                sequences = _Sequences(files[0], length, rows, pa.uint32() if wide else pa.uint16())
                listed = pa.ipc.new_file(files[1], _listed(batch))
            ids, counts = encoder(batch["text"])
            sequences.add(ids, counts)
            listed.write_batch(pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64())], schema=_listed(batch)))
            n_docs, n_tokens = n_docs + batch.num_rows, n_tokens + len(ids)
        if files is not None:
            sequences.close()
            listed.close()
            for f in files:
                f.close()
            row = [shard], [f"{name}.arrow"], [f"{name}.docs.arrow"], [n_docs], [n_tokens]
            types = pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["shard", "sequences", "docs", "n_docs", "n_tokens"])
    return run


def new_folder(spark: SparkSession) -> str:
    """A folder for token files among the cluster's shared ones; it goes when the driver ends."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = LENGTH, rows: int = ROWS, by_word: bool = False,
          shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of docs under folder and returns their manifest, a row a shard in ascending order of shard.

    folder: a path or address that driver and executors share and pyarrow can write to. shards: ranges to cut the ids into;
    as many as Spark's shuffles have where none is given.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    placed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"),
                         F.monotonically_increasing_id().alias("row_at"))
    order = ("doc_id", "text_hash", "row_at")
    ordered = (placed.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
               .sortWithinPartitions(*order).select("doc_id", "text"))
    return stored(ordered.mapInArrow(_writer(folder, tokenizer, end_id, length, rows, by_word), MANIFEST), "token-manifest")


class Shard:
    """Random access to the sequences of one shard; of a local or mounted folder without copying."""

    def __init__(self, store: fs.FileSystem, path: str):
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def __len__(self) -> int:
        last = self.reader.num_record_batches - 1
        return 0 if last < 0 else last * self.rows + self.reader.get_batch(last).num_rows

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """input_ids, mask and ends of record batch k, a row a sequence; ids are a view of the file."""
        batch = self.reader.get_batch(k)
        ids, mask, ends = (batch[c].flatten() for c in ("input_ids", "mask", "ends"))
        shape = (-1, self.length)
        return (ids.to_numpy(zero_copy_only=True).reshape(shape), *(x.to_numpy(zero_copy_only=False).reshape(shape) for x in (mask, ends)))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence i."""
        row = self.reader.get_batch(i // self.rows).slice(i % self.rows, 1)
        return row["input_ids"].flatten().to_numpy(zero_copy_only=True), row["mask"].flatten().to_numpy(zero_copy_only=False)


def _documents(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store, row["sequences"])
                with store.open_input_file(row["docs"]) as f:
                    listed = pa.ipc.open_file(f).read_all()
                counts, crcs, n, crc = [], [], 0, 0
                for k in range(shard.reader.num_record_batches):
                    ids, mask, ends = shard.batch(k)
                    ids, ends = ids[mask].astype("<u4"), np.flatnonzero(ends[mask]) + 1
                    at = 0
                    for end in ends.tolist():
                        counts.append(n + end - at)
                        crcs.append(zlib.crc32(ids[at:end], crc))
                        at, n, crc = end, 0, 0
                    n, crc = n + len(ids) - at, zlib.crc32(ids[at:], crc)
                if counts != listed["n_tokens"].to_pylist():
                    raise ValueError(f"{row['sequences']} and its list of documents differ")
                sizes = np.array(counts, np.int64)
                yield from pa.table({"doc_id": listed["doc_id"], "start": row["before"] + np.cumsum(sizes) - sizes, "n_tokens": sizes,
                                     "ids_crc32": np.array(crcs, np.int64)}).combine_chunks().to_batches()
    return run


def documents(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read from the files.

    The shards' totals are summed in one window over the manifest: one row a shard, whatever the documents.
    """
    spark = manifest.sparkSession
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    dealt = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    return dealt.mapInArrow(_documents(folder), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
