"""Near duplicates by circulant MinHash, banding and exact Jaccard verification (operator 2).

Circulant MinHash needs two permutations only. The first, sigma, shuffles the shingles of a
document; the second, pi, is used for all coordinates, shifted by one place more for each:
``h_k = min over shingles of pi(sigma(x) + k)``. Both act on the 32-bit integers: shingle
hashes are cut to that universe for the signature only, never for the verification.

32 bands of 4 coordinates miss a pair of similarity 0.8 with a probability of 5e-8. Classes of
equal shingle sets are one node each, so copies cost one comparison. In a bucket, all nodes are
compared with one of them first; only nodes in different components after that are compared
further. A node that shares too few of its shingles with any other open node to reach the
threshold is out (an exact bound). The others meet the node with the fewest shingles of its own,
and last come all remaining pairs across components that this bound and one from bitmaps allow.
So groups of thousands of near copies don't make all pairs, and no link between components is
lost. Comparisons are on whole sets.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pulsegate.llm.common import (FOLDED, arrow_rows, grams, hashed_words, keyed, mix, owners,
                                  staged, take, whole)
from pulsegate.llm.components import components

BANDS, ROWS = 32, 4
#: 64-bit words of the bitmap that bounds intersections.
BITMAP = 16
_BLOCK = 1 << 14


def _permute(x: np.ndarray, one: int, two: int) -> np.ndarray:
    """A permutation of the 32-bit integers (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(one)
    x ^= x >> np.uint32(13)
    x *= np.uint32(two)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row and their bounds.

    Texts with fewer words have their whole sequence as one shingle; texts without words none.
    """
    words, bounds = hashed_words(column, FOLDED)
    rows = owners(bounds)
    found = grams(words, size)
    inside = rows[:len(found)] == rows[size - 1:] if len(found) else np.zeros(0, bool)
    hashes, rows = found[inside], rows[:len(found)][inside]
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        hashes = np.concatenate([hashes, *(whole(words[bounds[r]:bounds[r + 1]]) for r in short)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(rows):
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.searchsorted(rows, np.arange(len(column) + 1))


def signatures(hashes: np.ndarray, heads: np.ndarray, count: int) -> np.ndarray:
    """Circulant signature, one row per document; ``heads`` are starts of non-empty sets."""
    base = _permute((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32),
                    0x7FEB352D, 0x846CA68B)
    out = np.full((len(heads), count), np.uint32(0xFFFFFFFF))
    bounds = np.append(heads, len(base))
    for start in range(0, len(base), _BLOCK):
        stop = min(start + _BLOCK, len(base))
        low = int(np.searchsorted(bounds, start, "right")) - 1
        high = int(np.searchsorted(bounds, stop, "left"))
        cuts = np.maximum(bounds[low:high] - start, 0)
        part = base[start:stop]
        for k in range(count):
            values = _permute(part + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35)
            out[low:high, k] = np.minimum(out[low:high, k], np.minimum.reduceat(values, cuts))
    return out


def _sketches(size: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_sets(batch.column("text"), size)
        counts = np.diff(bounds)
        full = np.flatnonzero(counts)
        node = np.zeros((len(counts), 2), np.uint64)
        bands: list[list[int] | None] = [None] * len(counts)
        if len(full):
            heads = bounds[full]
            node[full, 0] = np.add.reduceat(mix(hashes), heads)
            node[full, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x5555)), heads)
            drawn = signatures(hashes, heads, BANDS * ROWS).astype(np.uint64)
            keys = np.zeros((len(full), BANDS), np.uint64)
            for k in range(ROWS):
                keys = mix(keys ^ drawn[:, k::ROWS])
            keys = mix(keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            for row, own in zip(full, keys):
                bands[row] = own
        raw = node.tobytes()
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(counts.astype(np.int64)),
             pa.array([raw[16 * n:16 * n + 16] for n in range(len(counts))], pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "n_shingles", "node", "bands"])
    return make


def _full_sets(size: int):
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingle_sets(batch.column("text"), size)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        cells = np.zeros((batch.num_rows, 64 * BITMAP), bool)
        cells[rows, (hashes % np.uint64(64 * BITMAP)).astype(np.int64)] = True
        excess = np.diff(bounds) - cells.sum(axis=1)
        bits = np.packbits(cells, axis=1).view(np.int64)
        sets = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(sets, pa.binary()),
             pa.array(list(bits), pa.list_(pa.int64())), pa.array(excess.astype(np.int64))],
            names=["node", "shingles", "bits", "excess"])
    return make


@F.pandas_udf(T.LongType())
def _shared(left: pd.Series, right: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    out = []
    for a, b in zip(left, right):
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out.append(int((y[at] == x).sum()))
    return pd.Series(out, dtype="int64")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose sets have 100 * shared >= percent * union."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    small = F.least(F.length("of_a"), F.length("of_b"))
    large = F.greatest(F.length("of_a"), F.length("of_b"))
    shared = F.col("shared")
    union = (F.length("of_a") + F.length("of_b")) / 8 - shared
    return (pairs.join(two, "b").join(one, "a").filter(100 * small >= percent * large)
            .withColumn("shared", _shared("of_a", "of_b"))
            .filter(100 * shared >= percent * union).select("a", "b"))


def _star_pairs(rows: DataFrame, leaders: DataFrame) -> DataFrame:
    """Pairs of each bucket's leader with members of other components."""
    return rows.join(leaders, "bucket").filter("label <> leader_label").select(
        F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id, kept.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of distinct
    ``size``-word shingles (words without A-Z case). ``component_id`` is the smallest id that
    links reach, the row's own included; ``kept`` marks the row whose id it is. Null and
    empty texts have empty sets and no links. Rows that repeat, or share an id, are linked only
    through their texts; of equal ids all are kept. A null id is never the smallest if the
    component has another. Only doc_id and text are read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)
    sketch = staged(arrow_rows(
        rows, _sketches(size), f"doc_id {id_type}, text_key long, n_shingles long, node binary, "
        "bands array<long>", "text"), "sketches")
    filled = sketch.filter("n_shingles > 0")
    # equal sets are one node; the row whose text stands for it is the same on every read
    firsts = filled.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    buckets = filled.select("node", F.explode("bands").alias("bucket"))
    # sums are written before they are joined: between two plain shuffles Spark can split a hot key
    shared = staged(buckets.groupBy("bucket").agg(
        F.min("node").alias("leader"), F.max("node").alias("other")).filter(
        "leader <> other").select("bucket", "leader"), "shared")
    members = staged(buckets.join(shared, "bucket").select(
        "bucket", "node", "leader").distinct(), "buckets")

    wanted = staged(members.select("node").distinct().join(firsts, "node"), "wanted")
    # ``wanted`` grows with the data, so it is not broadcast, however small it is here
    texts = rows.alias("c").join(
        wanted.select("node", "first.*").hint("merge").alias("p"),
        F.expr("c.doc_id <=> p.doc_id AND c.text_key = p.text_key")).select("p.node", "c.text")
    sets = staged(arrow_rows(texts, _full_sets(size), "node binary, shingles binary, "
                             "bits array<long>, excess long", "text")
                  .dropDuplicates(["node"]), "sets")

    plain = members.select("bucket", "node")
    leaders = members.select("bucket", "leader").distinct()
    links = staged(_verified(_star_pairs(
        _labelled(plain, None), leaders.withColumn("leader_label", F.col("leader"))),
        sets, percent), "links")
    labels = components(links)

    # leaders have met all others of their bucket; what is left may still link across
    left = _open(members.filter("node <> leader").select("bucket", "node"), labels)
    left = _hopeful(left, _common(sets, left.select("node").distinct()), percent)
    # the member with the fewest shingles of its own is nearest to what the others were made from
    second = staged(left.groupBy("bucket").agg(
        F.max(F.struct(F.col("common") / F.col("size"), "node", "label")).alias("top")).select(
        "bucket", F.col("top.node").alias("leader"), F.col("top.label").alias("leader_label")),
        "leaders")
    more = staged(_verified(_star_pairs(left, second), sets, percent), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        labels = components(links)
    rest = left.drop("label").join(
        second.select("bucket", F.col("leader").alias("node")), ["bucket", "node"], "left_anti")
    last = staged(_verified(_across(_open(rest, labels), percent), sets, percent), "links")
    if not last.isEmpty():
        labels = components(links.unionAll(last))

    named = _labelled(sketch.select("doc_id", "text_key", "n_shingles", "node"), labels)
    smallest = staged(named.filter("n_shingles > 0").groupBy("label").agg(
        F.min("doc_id").alias("component_id")), "smallest")
    result = named.join(smallest, "label", "left").select(
        "doc_id", "text_key", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        .alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of buckets that still hold two components or more, with their labels."""
    named = _labelled(rows, labels)
    several = staged(named.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high")).filter(
        "low <> high").select("bucket"), "several")
    return staged(named.join(several, "bucket", "left_semi"), "open-buckets")


def _single_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
    rows = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([*raw, np.zeros(0, np.int64)])), take(batch, "node", rows)],
        names=["shingle", "node"])


def _common(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, common``: shingles of a node, and those that another of ``nodes`` has."""
    own = staged(sets.join(nodes, "node", "left_semi"), "open-sets")
    rows = arrow_rows(own, _single_shingles, "shingle long, node binary", "shingles")
    lone = rows.groupBy("shingle").agg(F.count("*").alias("nodes"), F.min("node").alias("node")
                                       ).filter("nodes = 1").groupBy("node").count()
    return staged(own.select("node", (F.length("shingles") / 8).cast("long").alias("size"),
                             "bits", "excess").join(lone, "node", "left").select(
        "node", "size", "bits", "excess", (F.col("size") - F.coalesce("count", F.lit(0))).alias("common")), "common")


def _reaches(common, size, other, percent: int):
    """Can a pair that shares at most ``common`` shingles be linked, given its set sizes?"""
    return 100 * common >= percent * (size + F.greatest(other, common) - common)


def _hopeful(rows: DataFrame, common: DataFrame, percent: int) -> DataFrame:
    """Rows without the nodes that cannot link to any other of their bucket: too many of their
    shingles are theirs alone for the smallest set in it."""
    sized = staged(rows.join(common, "node"), "sized")
    least = staged(sized.groupBy("bucket").agg(F.min("size").alias("least")), "least")
    return staged(sized.join(least, "bucket").filter(_reaches(
        F.col("common"), F.col("size"), F.col("least"), percent)).drop("least"), "hopeful")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of one bucket and two components. The largest component of a bucket is
    on one side only, so its own members are never paired."""
    sizes = rows.groupBy("bucket", "label").count()
    top = staged(sizes.groupBy("bucket").agg(F.max(F.struct("count", "label")).alias("top")).select(
        "bucket", F.col("top.label").alias("major")), "majors")
    marked = rows.join(top, "bucket")
    minor = marked.filter("label <> major").select(
        "bucket", F.col("node").alias("x"), F.col("label").alias("x_label"),
        *(F.col(name).alias(f"x_{name}") for name in ("size", "common", "bits", "excess")))
    # equal shingles share a bit, and only those beyond a set's bits can share none of their own
    both = [F.bit_count(F.get("bits", F.lit(n)).bitwiseAND(F.get("x_bits", F.lit(n))))
            for n in range(BITMAP)]
    shared = sum(both[1:], both[0]) + F.least("excess", "x_excess")
    most = F.least("common", "x_common", shared)
    pairs = minor.join(marked, "bucket").filter(
        F.expr("label <> x_label AND (label = major OR x < node)")
        & (100 * most >= percent * (F.col("size") + F.col("x_size") - most)))
    return pairs.select(F.least("x", "node").alias("a"),
                        F.greatest("x", "node").alias("b")).distinct()
