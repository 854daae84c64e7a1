"""Benchmark decontamination by SimHash of item-sized windows (operator 10).

For every benchmark item, windows of its own length in words are compared with it; a document that
is shorter is one window. Windows and
items have 64-bit SimHash fingerprints over their five-word shingles, which vote with the square
root of their weight: so the cosine that SimHash estimates is of the linear weights, as the
similarity is, and at least 2s / (1 + s) at similarity s. The bits are cut
into RADIUS + 1 blocks: fingerprints within the radius agree in one block at least, so looking
up all blocks finds every pair within the radius. The radius lies five deviations beyond the distance
expected at the similarity asked for. Pairs within it are verified by exact weighted Jaccard
similarity of their shingle sets.

Only windows that can reach the similarity are fingerprinted: the shingles they share with
any item must weigh at least ``similarity`` times the lightest item of that length. That bound
follows from the similarity itself, so it drops nothing.

Items and the rarity of shingles are counted once over the whole benchmark. Items reach the tasks
in blocks of bounded size; with several, each is a pass of the documents of its own, whose leaks are
written before its broadcast is released. Besides its items a pass holds 12 bytes for
each shingle that two items or more of the whole benchmark have, as these weigh less everywhere.
Documents are not shuffled to be compared, so no group of copies can be hot.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegate.llm.common import (arrow_rows, byte_table, grams, hashed_words, keyed, mix, owners,
                                  signed, small_batches, staged)

SHINGLE, RADIUS, SIMILARITY = 5, 24, 0.8
#: Words of the items that one pass compares with.
PASS_WORDS = 2_000_000
#: Space, controls and ASCII punctuation part words.
_TABLE = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))
_FILTER_BITS = 20
#: Cells of one lookup of fingerprint blocks (32 MB).
_GATHER = 1 << 22
LEAK = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()),
    T.StructField("n_words", T.IntegerType()), T.StructField("similarity", T.DoubleType())]))


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, span: int,
                 ) -> np.ndarray:
    """SimHash of the ``span`` shingles from each start."""
    low, high = int(starts.min()), int(starts.max()) + span
    bits = np.unpackbits(hashes[low:high, None].view(np.uint8), axis=1).astype(np.float64)
    votes = np.zeros((high - low + 1, 64))
    np.cumsum((2 * bits - 1) * weights[low:high, None], axis=0, out=votes[1:])
    sums = votes[starts - low + span] - votes[starts - low]
    return np.packbits(sums > 1e-9, axis=1).view(np.uint64).ravel()


def block_bounds() -> list[tuple[int, int]]:
    """(first bit, bits) of each of RADIUS + 1 blocks of a fingerprint."""
    edges = [64 * n // (RADIUS + 1) for n in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


_FIRST, _WIDTH = (np.array(x, np.uint64) for x in zip(*block_bounds()))
#: Where the values of each block begin in a table of all of them.
_OFFSETS = np.append(0, np.cumsum(1 << _WIDTH.astype(np.int64)))


def _blocks(prints: np.ndarray) -> np.ndarray:
    """Place of each block's value in the table, one column per block."""
    values = (prints[:, None] >> _FIRST) & ((np.uint64(1) << _WIDTH) - np.uint64(1))
    return values.astype(np.int64) + _OFFSETS[:-1]


@dataclass
class Size:
    """Items of one length in words: shingles per item, fingerprints, block table."""
    words: int
    span: int  # shingles of a window
    ids: list[int]
    sets: list[dict[int, float]]
    totals: np.ndarray
    prints: np.ndarray

    def __post_init__(self):
        """For each value of each block, a bitset of the items that have it."""
        self.lanes = -(-len(self.ids) // 64)
        self.table = np.zeros((int(_OFFSETS[-1]), self.lanes), np.uint64)
        places, items = _blocks(self.prints), np.arange(len(self.ids))
        np.bitwise_or.at(self.table, (places, (items // 64)[:, None]),
                         (np.uint64(1) << (items % 64).astype(np.uint64))[:, None])

    def candidates(self, prints: np.ndarray, reach: np.ndarray, similarity: float,
                   ) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius whose windows hold weight enough for the item.

        Blocks are looked up in one gather; its size is bounded, whatever the number of items.
        """
        found = []
        step = max(_GATHER // (len(_FIRST) * self.lanes), 1)
        for at in range(0, len(prints), step):
            part = prints[at:at + step]
            near = np.bitwise_or.reduce(self.table[_blocks(part)], axis=1)
            bits = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little",
                                 count=len(self.ids))
            window, item = np.nonzero(bits)
            # all weight that a window shares with any item bounds what it shares with one
            enough = reach[at + window] >= similarity * self.totals[item] - 1e-9
            window, item = window[enough], item[enough]
            close = np.bitwise_count(part[window] ^ self.prints[item]) <= RADIUS
            found.append((at + window[close], item[close]))
        return tuple(np.concatenate(x) for x in zip(*found))


@dataclass
class Rarity:
    """Weights of shingles: one that many items share tells less."""
    items: int
    shingles: np.ndarray  # those of more than one item, sorted
    counts: np.ndarray

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        counts = np.ones(len(hashes))
        if len(self.shingles):
            at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
            known = self.shingles[at] == hashes
            counts[known] = self.counts[at[known]]
        return np.log(1 + self.items / counts)


def count_rarity(items: DataFrame) -> Rarity:
    """Items, and how many of them have each shingle that repeats, over the whole benchmark."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array([text.lower() for text in batch.column("text").to_pylist()], pa.string())
        words, bounds = hashed_words(texts, _TABLE)
        parts = [np.unique(grams(words[a:b], min(SHINGLE, int(b - a))))
                 for a, b in zip(bounds[:-1], bounds[1:]) if b > a]
        return pa.RecordBatch.from_arrays(
            [signed(np.concatenate([np.zeros(0, np.uint64), *parts]))], names=["shingle"])

    table = arrow_rows(items.select("text"), make, "shingle long", "text").groupBy(
        "shingle").count().filter("count > 1").toArrow()
    shingles = table.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return Rarity(items.count(), shingles[order],
                  table.column("count").to_numpy()[order].astype(np.int32))


class Items:
    """A block of benchmark items, ready to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], similarity: float, rarity: Rarity):
        self.similarity, self.rarity = similarity, rarity
        column = pa.array([text.lower() for _, text in rows], pa.string())
        words, bounds = hashed_words(column, _TABLE)
        found: dict[int, list] = {}
        known: list[np.ndarray] = []
        for n, (item_id, _) in enumerate(rows):
            own = words[bounds[n]:bounds[n + 1]]
            if not len(own):
                continue
            shingles = grams(own, min(SHINGLE, len(own)))
            known.append(shingles)
            found.setdefault(len(own), []).append((item_id, shingles))
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *known]))
        self.weight = dict(zip(every.tolist(), rarity.weights(every).tolist()))
        self.sizes = []
        for length, items in sorted(found.items()):
            sets = [{s: self.weight[s] for s in np.unique(x).tolist()} for _, x in items]
            span = max(length - SHINGLE + 1, 1)
            prints = np.concatenate([fingerprints(
                mix(x), np.sqrt([self.weight[s] for s in x.tolist()]), np.array([0]), span)
                for _, x in items])
            self.sizes.append(Size(length, span, [i for i, _ in items], sets,
                                   np.array([sum(s.values()) for s in sets]), prints))
        self.lookup = {}
        for shingle in {min(SHINGLE, size.words) for size in self.sizes}:
            known = np.unique(np.array([
                s for size in self.sizes if min(SHINGLE, size.words) == shingle
                for own in size.sets for s in own], np.uint64))
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[known & np.uint64((1 << _FILTER_BITS) - 1)] = True
            self.lookup[shingle] = seen, known, np.array([self.weight[s] for s in known.tolist()])

    def known_weights(self, hashes: np.ndarray, shingle: int) -> np.ndarray:
        """Weight of each shingle that an item has, 0 for the others."""
        seen, known, weights = self.lookup[shingle]
        out = np.zeros(len(hashes))
        likely = np.flatnonzero(seen[hashes & np.uint64((1 << _FILTER_BITS) - 1)])
        at = np.minimum(np.searchsorted(known, hashes[likely]), len(known) - 1)
        right = known[at] == hashes[likely]
        out[likely[right]] = weights[at[right]]
        return out

    def search(self, words: np.ndarray, bounds: np.ndarray) -> list[list[tuple]]:
        """Best window of each item in each row: item_id, start, words, similarity.

        The rows of a batch that share any shingle with an item stand behind each other, and
        each item length looks at the windows of all of them at once.
        """
        best: list[dict[int, tuple[int, int, int, float]]] = [{} for _ in bounds[1:]]
        rows = owners(bounds)
        for shingle in self.lookup:
            hashes = grams(words, shingle)
            own = self.known_weights(hashes, shingle)
            inside = rows[:len(hashes)] == rows[shingle - 1:] if len(hashes) else np.zeros(0, bool)
            own[~inside] = 0
            hit = np.zeros(len(best), bool)
            hit[rows[np.flatnonzero(own)]] = True
            kept = np.flatnonzero(inside & hit[rows[:len(hashes)]])
            if len(kept):
                self._windows(shingle, rows[kept], kept - bounds[rows[kept]], hashes[kept],
                              own[kept], best)
        return [sorted(found.values(), key=lambda leak: (leak[1], str(leak[0])))
                for found in best]

    def _windows(self, shingle: int, rows: np.ndarray, places: np.ndarray, hashes: np.ndarray,
                 own: np.ndarray, best: list[dict]) -> None:
        shared = np.append(0, np.cumsum(own))
        text = Stretch(rows, places, hashes, self.rarity.weights(hashes))
        heads = np.flatnonzero(places == 0)
        lengths = np.diff(heads, append=len(rows))
        for size in self.sizes:
            if min(SHINGLE, size.words) != shingle:
                continue
            least = self.similarity * size.totals.min() - 1e-9
            if len(rows) >= size.span:
                reach = shared[size.span:] - shared[:-size.span]
                starts = np.flatnonzero((reach >= least)
                                        & (rows[:len(reach)] == rows[size.span - 1:]))
                self._verify(size, size.span, starts, reach[starts], text, best)
            # a shorter document is one window
            short = np.flatnonzero(lengths < size.span)
            reach = shared[heads[short] + lengths[short]] - shared[heads[short]]
            for at in np.flatnonzero(reach >= least).tolist():
                self._verify(size, int(lengths[short[at]]), heads[short[at:at + 1]],
                             reach[at:at + 1], text, best)

    def _verify(self, size: Size, span: int, starts: np.ndarray, reach: np.ndarray,
                text: Stretch, best: list[dict]) -> None:
        if not len(starts):
            return
        for window, item in zip(*size.candidates(text.prints(starts, span), reach,
                                                 self.similarity)):
            at = int(starts[window])
            found = dict(zip(text.hashes[at:at + span].tolist(),
                             text.weights[at:at + span].tolist()))
            shared = sum(w for s, w in size.sets[item].items() if s in found)
            union = size.totals[item] + sum(w for s, w in found.items()
                                            if s not in size.sets[item])
            similarity = shared / union
            own, key = best[int(text.rows[at])], size.ids[item]
            if similarity >= self.similarity - 1e-12 and (
                    key not in own or similarity > own[key][3]):
                words = size.words - size.span + span
                own[key] = (key, int(text.places[at]), words, float(similarity))


@dataclass
class Stretch:
    """Shingles of several rows, one row after the other."""
    rows: np.ndarray
    places: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray

    def prints(self, starts: np.ndarray, span: int) -> np.ndarray:
        """Fingerprints of windows; shingles in none of them are left out of the running sums."""
        edges = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + span, -1)
        covered = np.cumsum(edges[:-1]) > 0
        place = np.cumsum(covered) - 1
        hashes, weights = mix(self.hashes[covered]), np.sqrt(self.weights[covered])
        out = []
        for at in range(0, len(starts), 4096):
            part = place[starts[at:at + 4096]]
            # a sum holds 64 votes a shingle, so few windows that lie far apart go alone
            cuts = np.append(np.searchsorted(part, np.arange(part[0], part[-1] + 1, 1 << 14)),
                             len(part))
            out += [fingerprints(hashes, weights, part[a:b], span)
                    for a, b in zip(cuts[:-1], cuts[1:]) if a < b]
        return np.concatenate(out)


def _finder(shared):
    @F.pandas_udf(LEAK)
    def find(texts: pd.Series) -> pd.Series:
        words, bounds = hashed_words(pa.array(texts, pa.string()), _TABLE)
        return pd.Series([[{"item_id": i, "start": at, "n_words": n, "similarity": s}
                           for i, at, n, s in found]
                          for found in shared.value.search(words, bounds)])
    return find


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY,
               ) -> DataFrame:
    """All rows and columns of ``docs`` and ``leaks``: an array of item_id, start, n_words,
    similarity, one entry per benchmark item found, its best window. ``n_words`` is less than the
    words of the item where the whole document is.

    Words are lower-cased and split at blanks and ASCII punctuation; whole texts are searched.
    Items of fewer than five words are one shingle. Null and empty texts have no leaks; null and
    empty items match nothing; items that repeat are reported once each. Without items or
    documents nothing is found. A column named ``leaks`` is replaced.
    """
    small_batches(docs)
    spark = docs.sparkSession
    items = benchmark.filter(F.col("text").isNotNull() & (F.trim("text") != "")).select(
        F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    passes = max(1, math.ceil(total / PASS_WORDS))
    empty = F.array().cast(LEAK)
    if not total:
        return docs.withColumn("leaks", empty)
    rarity = count_rarity(items)

    def shared(number: int) -> Broadcast:
        # rows of one id stay together, as its best window is reported
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number)
        rows = [(row["item_id"], row["text"]) for row in own.orderBy("item_id", "text").collect()]
        return spark.sparkContext.broadcast(Items(rows, similarity, rarity))

    if passes == 1:
        return docs.withColumn("leaks", _finder(shared(0))(F.lower("text")))
    found = None
    for number in range(passes):
        block = shared(number)
        # repeated rows have equal leaks
        part = staged(keyed(docs).select(
            F.col("doc_id").alias("_leaks_id"), F.col("text_key").alias("_leaks_key"),
            _finder(block)(F.lower("text")).alias("_leaks")).filter(
            F.size("_leaks") > 0).distinct(), "leaks")
        block.destroy()
        found = part if found is None else found.unionAll(part)
    by_start = F.sort_array(F.transform(F.flatten(F.collect_list("_leaks")), lambda x: F.struct(
        x["start"], F.coalesce(x["item_id"].cast("string"), F.lit("None")), x.alias("leak"))))
    merged = found.groupBy("_leaks_id", "_leaks_key").agg(
        F.transform(by_start, lambda x: x["leak"]).alias("_leaks"))
    return docs.join(merged, docs["doc_id"].eqNullSafe(merged["_leaks_id"])
                     & (F.xxhash64(docs["text"]) == merged["_leaks_key"]), "left").withColumn(
        "leaks", F.coalesce("_leaks", empty)).drop("_leaks_id", "_leaks_key", "_leaks")
