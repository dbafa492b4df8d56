"""Vectorised text primitives shared by the operators of this package.

Everything works on an Arrow string column as one byte array with row offsets, so that a batch costs a
few numpy passes instead of a Python loop over its words. Hashes are 64 bits wide, do not depend on
the machine, the batch or the partition, and are the same in every operator.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is one piece on its own.
CHUNK_BYTES = 1 << 20

#: Rows that are converted at once, so that a batch is never copied whole.
SLICE_ROWS = 512

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_STEP = np.uint64(0xA0761D6478BD642F)

#: Bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits under which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1_000_003)) * _GOLDEN)


_BYTE_CODE = seeds(256, 77)
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a string column into (first row, row behind the last, bytes, row offsets); null counts as empty."""
    for base in range(0, len(column), SLICE_ROWS):
        part = pc.fill_null(column.slice(base, SLICE_ROWS).cast(pa.large_string()), "")
        n = len(part)
        _, raw_offsets, raw = part.buffers()
        offsets = np.frombuffer(raw_offsets, dtype=np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield base + at, base + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def binary_views(column: pa.Array, dtype: str) -> list[np.ndarray]:
    """Each value of a binary column without nulls as numbers, without a copy."""
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    return [data[a:b].view(dtype) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of all rows, and where each row's words begin in them."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~separators[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    lasts = offsets[1:][offsets[1:] > 0] - 1
    after[lasts] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span's content."""
    up, down = _power_tables(len(data))
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive entries."""
    count = max(0, len(words) - n + 1)
    acc = np.zeros(count, dtype=np.uint64)
    for j in range(n):
        acc = (acc + words[j : j + count]) * _STEP
    return mix(acc)


def within_rows(bounds: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of the run starts 0..total-n whose n entries lie in one row; bounds as from word_spans."""
    count = max(0, total - n + 1)
    ok = np.ones(count, dtype=bool)
    for k in range(1, n):
        at = bounds[1:-1] - k
        at = at[(at >= 0) & (at < count)]
        ok[at] = False
    return ok


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def document_words(lower: bool, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, word hashes, where each row's words begin)."""
    for at, to, data, offsets in text_chunks(column):
        if lower:
            data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets)
        yield at, to, span_hashes(data, starts, ends), bounds


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only where spark.checkpoint.dir is unset, as in tests, is a folder below the warehouse used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = frame.sparkSession
    path = scratch_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def in_fold(doc_id: Column, parts: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves the given remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == fold, F.lit(False))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    while name in taken:
        name += "_"
    return name


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, which gives its memory back to the machine when a task ends: workers stay alive between tasks."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return own
