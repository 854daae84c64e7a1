"""Shared helpers: Arrow batches of bounded size, word hashes, exact row keys.

Words are hashed straight from the UTF-8 buffer of an Arrow column, without a Python object
per word. All 64-bit arithmetic wraps around on purpose.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegate.staging import shared_folder

#: Rows of one Arrow batch. Texts may be long, so batches are small.
BATCH_ROWS = 256
#: Bytes of text that one call of a batch function sees, unless a single row is larger.
BATCH_BYTES = 1 << 20

_ONE = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xBF58476D1CE4E5B9)
_THREE = np.uint64(0x94D049BB133111EB)
_FIVE = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place on a new array)."""
    x = x + _ONE
    x ^= x >> np.uint64(30)
    x *= _TWO
    x ^= x >> np.uint64(27)
    x *= _THREE
    x ^= x >> np.uint64(31)
    return x


def _weights(count: int, start: int = 0) -> np.ndarray:
    return mix(np.arange(start, start + count, dtype=np.uint64)) | np.uint64(1)


_POSITIONS = _weights(1 << 12)


def byte_table(separators: bytes, fold_ascii: bool = False) -> np.ndarray:
    """One random code per byte, 0 for separators; A-Z share the codes of a-z if folded."""
    codes = mix(np.arange(1000, 1256, dtype=np.uint64)) | np.uint64(1)
    if fold_ascii:
        codes[ord("A"):ord("Z") + 1] = codes[ord("a"):ord("z") + 1]
    codes[list(separators)] = 0
    return codes


#: Space and U+0009 to U+000D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
PLAIN = byte_table(BLANKS)
FOLDED = byte_table(BLANKS, fold_ascii=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offsets of each; nulls are empty."""
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = wide.fill_null(b"")
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def hashed_words(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``column`` and, per row, the bounds of its words."""
    data, offsets = buffers(column)
    codes = table[data]
    inside = codes != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(starts[0], len(data)) - np.repeat(
        starts, np.diff(starts, append=len(data)))
    if place.max() < len(_POSITIONS):
        weights = _POSITIONS[place]
    else:
        weights = mix(place.astype(np.uint64)) | np.uint64(1)
    sums = np.add.reduceat(codes[starts[0]:] * weights, starts - starts[0])
    return mix(sums), np.searchsorted(starts, offsets)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring word sequences from the hashes of each."""
    return mix(left * _FIVE + (right ^ (right >> np.uint64(29))) * _THREE)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each start: two windows of half that size, joined."""
    if size == 1:
        return words
    if len(words) < size:
        return np.zeros(0, np.uint64)
    half = (size + 1) // 2
    parts = grams(words, half)
    step = size - half
    return joined(parts[:len(parts) - step], parts[step:])


def whole(words: np.ndarray) -> np.ndarray:
    """Hash of the whole (short) sequence as an array of one, or of none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    total = np.uint64(len(words))
    for word in words:
        total = joined(np.array([total]), np.array([word]))[0]
    return np.array([total])


def small_batches(frame: DataFrame) -> None:
    """Keep the session's Arrow batches small enough for long texts."""
    conf = frame.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def arrow_rows(frame: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None],
               schema: str, text: str | None = None) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes of the column ``text``."""
    small_batches(frame)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, text):
                out = make(part)
                if out is not None and out.num_rows:
                    yield out

    return frame.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, text: str | None) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most BATCH_BYTES of text, but one row at least."""
    if text is None or batch.num_rows < 2:
        yield batch
        return
    _, offsets = buffers(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + BATCH_BYTES, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and ``text_key``: together the identity of a row.

    Rows that agree in id and text are repeats and share their results, so no row number
    that could change when a task runs again is needed. Other columns are left out, so
    their names can't clash.
    """
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), *more)


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def staged(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` once below the shared folder (zstd) and return a scan of it."""
    path = f"{shared_folder(frame.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def owners(bounds: np.ndarray) -> np.ndarray:
    """Row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def take(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> pa.Array:
    return batch.column(name).take(pa.array(rows))
