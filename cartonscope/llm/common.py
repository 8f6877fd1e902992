"""What the operators share: words, hashes of words, labelled rows, tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartonscope.session import shared_folder, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes between words: ASCII whitespace, or all ASCII but letters and digits.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes(i for i in range(0x80) if not chr(i).isalnum())
#: Documents are cut into slices of about so many bytes inside a task.
SLICE_BYTES = 1 << 20
#: Bytes of one Arrow batch sent to Python; a longer text is a batch of its own.
BATCH_BYTES = str(16 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes, so that a run of very long texts does not fill a worker; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, and a lost executor loses nothing of it.

    The folder goes when the driver ends; a result may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def partition_sums(df: DataFrame, sums_of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], cuts: int = 16) -> np.ndarray | None:
    """Sum over partitions of the vector that sums_of gives for each; its length must not grow with the data."""
    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array_split(sums_of(batches), cuts)
        yield pa.RecordBatch.from_arrays([pa.array(range(cuts), pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["cut", "part"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(p.as_py()) for p in group["part"]], axis=0)
        return pa.table({"cut": group["cut"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    schema = "cut int, part binary"
    found = df.mapInArrow(partial_sums, schema).groupBy("cut").applyInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(r.part) for r in sorted(found, key=lambda r: r.cut)]) if found else None


def mix(values: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Words:
    """Hashes words of UTF-8 buffers with numpy: one polynomial over the bytes of a word, then mixed."""

    _BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

    def __init__(self, separators: bytes = BLANKS, lower: bool = True):
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[65:91] += 32
        self.is_word = np.ones(256, bool)
        self.is_word[list(separators)] = False
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))[self.fold]
        self.values[~self.is_word] = 0
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
                              for b in (np.uint64(self._BASE), np.uint64(self._INVERSE)))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and first byte of every word, and how many words each text has. bounds: len(texts) + 1 byte offsets."""
        inside = self.is_word[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        per_text = np.diff(np.searchsorted(starts, bounds))
        if not len(starts):
            return np.zeros(0, np.uint64), starts, per_text
        if len(data) > len(self.up):
            self._powers(2 * len(data))
        value = self.values[data] * self.up[:len(data)]
        return mix(np.add.reduceat(value, starts) * self.down[starts]), starts, per_text

    def last_bytes(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the last byte of every word stands."""
        inside = self.is_word[data]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = bounds[1:][bounds[:-1] < bounds[1:]] - 1
        last[edges] = inside[edges]
        return np.flatnonzero(last)


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(blob: bytes, n: int, dtype: type) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and len + 1 offsets into them; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `size` bytes: first row, end row, bytes, offsets. No text is cut."""
    data, offsets = texts_of(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of `counts` values; an empty run gives 0."""
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[ends] - total[ends - counts]
