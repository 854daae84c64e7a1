"""Exact duplicates by composable polynomial fingerprints (operator 11).

The fingerprint of a text is the polynomial of its bytes (A-Z in lower case) at four fixed bases,
modulo a prime of 31 bits, next to its length. It composes: with ``n`` bytes in the second part,
``H(one + two) = H(one) * base ** n + H(two)``, so where a text is cut makes no difference. Blocks
of a batch are hashed in one matrix product. Texts of more than ``part_bytes`` are written as
parts, which any task hashes by itself; a part's hash, shifted by the bytes that follow it, is one
term of a sum that Spark combines like any other.

Texts with equal fingerprints are then compared part by part: the smallest and the largest bytes of
each part number agree exactly if all do. Both combine before the shuffle, so a group of a third
of all rows sends one copy a task, and no group is gathered. Fingerprints that
belong to different texts are told apart by the texts themselves.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegate.llm.common import bounded, buffers, mix, small_batches, staged

PRIME, LANES, BLOCK = (1 << 31) - 1, 4, 256
#: Bytes of a part; bits of the table of repeated fingerprints that workers look into (4 MB).
PART, BITS = 1 << 20, 1 << 25
#: Bytes of texts a task remembers to leave out copies of what it has sent.
MEMORY = 1 << 25

KEY = ["n_bytes", "one", "two"]
_BASES = [int(b) for b in mix(np.arange(2000, 2000 + LANES, dtype=np.uint64))]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32


def shift(count: int, prime: int = PRIME) -> np.ndarray:
    """``base ** count`` of each lane."""
    return np.array([pow(base, count, prime) for base in _BASES], np.uint64)


def combine(left: np.ndarray, right: np.ndarray, right_bytes: int,
            prime: int = PRIME) -> np.ndarray:
    """Hash of two parts, one after the other, from the hash of each."""
    return (left * shift(right_bytes, prime) + right) % np.uint64(prime)


def _powers(step: int, count: int, prime: int) -> np.ndarray:
    """``base ** (step * n)`` for n below ``count``, by doubling; one column per lane."""
    out = np.ones((1, LANES), np.uint64)
    while len(out) < count:
        out = np.concatenate([out, out * shift(step * len(out), prime) % np.uint64(prime)])
    return out[:count]


class Hasher:
    """Polynomial hashes of many byte strings at once."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        # 8 bits of a byte, 31 of a power and 8 for the sum stay exact in a double
        self.within = _powers(1, BLOCK, prime)[::-1].astype(np.float64)
        self.across = _powers(BLOCK, 1 << 12, prime)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of lanes for each ``data[bounds[n]:bounds[n + 1]]``."""
        sizes = np.diff(bounds)
        blocks = -(-sizes // BLOCK)
        ends = np.cumsum(blocks)
        out = np.zeros((len(sizes), LANES), np.uint64)
        if not len(data):
            return out
        # zeros in front of a text add nothing to its polynomial
        padded = np.zeros(int(ends[-1]) * BLOCK, np.uint8)
        padded[np.arange(len(data)) + np.repeat(ends * BLOCK - bounds[1:], sizes)] = data
        sums = padded.reshape(-1, BLOCK).astype(np.float64) @ self.within
        prime = np.uint64(self.prime)
        hashes = sums.astype(np.uint64) % prime
        if blocks.max() > len(self.across):
            self.across = _powers(BLOCK, int(blocks.max()), self.prime)
        after = np.repeat(ends, blocks) - 1 - np.arange(len(hashes))
        full = np.flatnonzero(blocks)
        out[full] = np.add.reduceat(hashes * self.across[after] % prime,
                                    (ends - blocks)[full]) % prime
        return out


def packed(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 62-bit numbers of four lanes."""
    pairs = (lanes[:, ::2] << np.uint64(31)) | lanes[:, 1::2]
    return pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch],
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in bounded(batch, "text"):
            yield part, *buffers(part.column("text"))


def _batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _sketches(part_bytes: int, prime: int) -> Callable:
    """Fingerprint and SHA-256 of each short text; the parts of each long one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher(prime)
        for batch, data, bounds in _texts(batches):
            sizes = np.diff(bounds)
            short = np.flatnonzero(sizes <= part_bytes)
            folded = _FOLD[data] if len(short) else data
            if len(short) < len(sizes):
                own = np.concatenate([folded[bounds[n]:bounds[n + 1]] for n in short]
                                     ) if len(short) else data[:0]
            else:
                own = folded
            cuts = np.append(0, np.cumsum(sizes[short]))
            one, two = packed(hashes(own, cuts))
            view = memoryview(np.ascontiguousarray(own))
            none = pa.nulls(len(short), pa.int64())
            yield _batch(
                doc_id=batch.column("doc_id").take(pa.array(short)), n_bytes=sizes[short],
                sha=pa.array([hashlib.sha256(view[a:b]).digest()
                              for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                one=one, two=two, tag=none, part=none, after=none,
                piece=pa.nulls(len(short), pa.binary()))
            for row in np.flatnonzero(sizes > part_bytes):
                yield from _parts(batch.column("doc_id").slice(row, 1),
                                  data[bounds[row]:bounds[row + 1]])

    def _parts(doc_id: pa.Array, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for at in range(0, len(data), part_bytes):
            digest.update(memoryview(_FOLD[data[at:at + part_bytes]]))
        # a number of its own for each row; what is written once stays as it is
        tag = int.from_bytes(os.urandom(8), "little") >> 1
        nothing = pa.nulls(1, pa.int64())
        for number, at in enumerate(range(0, len(data), part_bytes)):
            piece = _FOLD[data[at:at + part_bytes]].tobytes()
            yield _batch(doc_id=doc_id, n_bytes=[len(data)], sha=[digest.digest()], one=nothing,
                         two=nothing, tag=[tag], part=[number],
                         after=[len(data) - at - len(piece)], piece=[piece])
    return run


def _terms(prime: int) -> Callable:
    """The hash of each part, shifted by the bytes after it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hasher(prime)
        for batch in batches:
            data, bounds = buffers(batch.column("piece"))
            lanes = hashes(data, bounds)
            shifts = np.array([shift(n, prime) for n in batch.column("after").to_pylist()],
                              np.uint64).reshape(-1, LANES)
            lanes = lanes * shifts % np.uint64(prime)
            yield _batch(**{name: batch.column(name) for name in ("doc_id", "n_bytes", "sha",
                                                                  "tag")},
                         **{f"lane{k}": lanes[:, k].astype(np.int64) for k in range(LANES)})
    return run


def _candidates(part_bytes: int, prime: int, table: object, doc_id: bool) -> Callable:
    """Texts whose fingerprint may be in ``table``, less what the task has sent before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hasher(prime), table.value
        sent: dict[tuple[int, int, int], bytes] = {}
        held = 0
        for batch, data, bounds in _texts(batches):
            folded = _FOLD[data]
            sizes = np.diff(bounds)
            one, two = packed(hashes(folded, bounds))
            at = one % BITS
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            rows, texts = [], []
            for row in np.flatnonzero(hit if doc_id else hit & (sizes <= part_bytes)).tolist():
                text = folded[bounds[row]:bounds[row + 1]].tobytes()
                key = (int(sizes[row]), int(one[row]), int(two[row]))
                if not doc_id:
                    if sent.get(key) == text:
                        continue
                    if held > MEMORY:
                        sent.clear()
                        held = 0
                    held += len(text)
                    sent[key] = text
                rows.append(row)
                texts.append(text)
            if rows:
                extra = ({"doc_id": batch.column("doc_id").take(pa.array(rows)),
                          "sha": [hashlib.sha256(text).digest() for text in texts]}
                         if doc_id else {"part": pa.array([0] * len(rows), pa.int64())})
                yield _batch(n_bytes=sizes[rows], one=one[rows], two=two[rows],
                             piece=pa.array(texts, pa.binary()), **extra)
    return run


def _table(keys: DataFrame) -> np.ndarray:
    """Bytes of a table of BITS bits that holds every key; a bounded size, whatever there is."""
    at = F.pmod("one", F.lit(BITS))
    rows = keys.select((F.shiftright(at, 3)).alias("byte"), F.expr(
        f"shiftleft(1, CAST(pmod(one, {BITS}) & 7 AS INT))").alias("bit")).groupBy("byte").agg(
        F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _same_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    return left.join(right, KEY, how)


def exact_duplicates(docs: DataFrame, part_bytes: int = PART, prime: int = PRIME) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z; of equal ones the row with
    the largest ``doc_id`` stays. Null texts are empty ones. Rows that agree in id and text are
    repeats of one document: they count in ``group_size`` and share ``kept``. A null id is
    smaller than any other. Texts of any length are compared whole; an empty table gives no
    rows. Only ``doc_id`` and ``text`` are read, so other columns can't clash. A smaller
    ``prime`` lets fingerprints collide, which changes no result.
    """
    small_batches(docs)
    own_id = docs.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {own_id}, n_bytes long, sha binary"
    texts = docs.select("doc_id", "text")
    first = staged(texts.mapInArrow(
        _sketches(part_bytes, prime),
        f"{head}, one long, two long, tag long, part long, after long, piece binary"), "sketches")

    pieces = first.filter("piece IS NOT NULL")
    lanes = ", ".join(f"lane{k} long" for k in range(LANES))
    sums = [F.pmod(F.sum(f"lane{k}"), F.lit(prime)) for k in range(LANES)]
    long_texts = pieces.mapInArrow(_terms(prime), f"{head}, tag long, {lanes}").groupBy(
        "doc_id", "n_bytes", "sha", "tag").agg(
        *((F.shiftleft(high, 31).bitwiseOR(low)).alias(name)
          for name, high, low in (("one", *sums[:2]), ("two", *sums[2:]))))
    members = first.filter("piece IS NULL").select("doc_id", "sha", *KEY).unionAll(
        long_texts.select("doc_id", "sha", *KEY))

    repeated = staged(members.groupBy(*KEY).agg(
        F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).filter(
        "group_size > 1"), "repeated")
    context = docs.sparkSession.sparkContext
    table = context.broadcast(_table(repeated))
    key = "n_bytes long, one long, two long, piece binary"
    long_repeats = pieces.select("tag", "part", "piece").join(
        _same_key(long_texts.select("tag", *KEY), repeated, "left_semi"), "tag")
    parts = texts.mapInArrow(_candidates(part_bytes, prime, table, False), f"{key}, part long"
                             ).unionByName(long_repeats.select(*KEY, "piece", "part"))
    unequal = staged(parts.groupBy(*KEY, "part").agg(
        F.min("piece").alias("low"), F.max("piece").alias("high")).filter("low <> high").select(
        *KEY).distinct(), "unequal")
    table.unpersist()

    sizes = ["keep_id", "group_size"]
    if unequal.isEmpty():
        judged = _same_key(members, repeated, "left")
    else:
        collided = context.broadcast(_table(unequal))
        rows = staged(_same_key(texts.mapInArrow(
            _candidates(part_bytes, prime, collided, True), f"{key}, doc_id {own_id}, sha binary"),
            unequal, "left_semi"), "collided")
        classes = rows.groupBy(*KEY, "piece").agg(
            F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        told = rows.join(classes, [*KEY, "piece"]).select("doc_id", "sha", "n_bytes", *sizes)
        judged = _same_key(_same_key(members, unequal, "left_anti"), repeated, "left").select(
            "doc_id", "sha", "n_bytes", *sizes).unionByName(told)
    alone = F.col("group_size").isNull()
    return judged.select(
        "doc_id", "n_bytes", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias(
            "keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
