"""Prefix trie of conversations with double arrays (operator 13).

Turns are numbered inside their conversation by chunks, so one conversation may hold a third of
all rows. A turn's node is named by the running sum of hashes of (turn, place): sums combine over
chunks, and no text is shuffled after its digest is taken.

Conversations are cut into segments of ``SEGMENT`` turns and range-partitioned by the prefix they
start from and their turns. A batch of the sorted segments is one prefix shard: neighbours share
prefixes, and its size is bounded however many conversations share one. In each shard the turns
get dense ids, a double array (BASE, CHECK) is packed, and the segments walk it together, one turn
a step, to count their nodes. Nodes that several shards hold, the shared upper ones above all,
are merged by name.

Each node belongs to its smallest member. A subtree is summed without walking the tree level by
level: every conversation sums its own nodes from its end to each turn, and these sums
add up over the members of a node.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pulsegate.llm.common import staged
from pulsegate.operators.prefix import grouped_rank, running_totals

#: Turns of a segment, segments of a shard; places tried before a node's children go to the end.
SEGMENT, SHARD, TRIES = 32, 2048, 16
LANES = ["lane0", "lane1", "lane2", "lane3"]
ROOT = hashlib.md5(b"root").digest()
NODE = "node binary, parent binary, depth long, chars long, n_convs long, conv_id long"


class DoubleArray:
    """Trie over sequences of dense ids: the child of ``s`` by ``c`` is BASE[s] + c if CHECK is s.

    ``codes`` has a row per sequence, sorted, with -1 after its end. State 0 is the root.
    """

    def __init__(self, codes: np.ndarray):
        self.base = np.zeros(64, np.int64)
        self.check = np.full(64, -1, np.int64)
        self.check[0] = 0
        self.low, self.top = 1, 1
        self.paths = np.full(codes.shape, -1, np.int64)  # state of each sequence at each step
        states = np.zeros(len(codes), np.int64)
        for step in range(codes.shape[1]):
            alive = np.flatnonzero(codes[:, step] >= 0)
            if not len(alive):
                break
            edges = np.unique(np.stack([states[alive], codes[alive, step]], axis=1), axis=0)
            heads = np.flatnonzero(np.append(True, edges[1:, 0] != edges[:-1, 0]))
            for start, stop in zip(heads, np.append(heads[1:], len(edges))):
                self._place(int(edges[start, 0]), edges[start:stop, 1])
            states = self.walk(states, codes[:, step])
            self.paths[alive, step] = states[alive]

    def _place(self, state: int, children: np.ndarray) -> None:
        """Find a BASE at which all children's cells are free, and take them."""
        first, span = int(children[0]), int(children[-1])
        slot = self.low
        for _ in range(TRIES):
            while slot < self.top and self.check[slot] >= 0:
                slot += 1
            base = slot - first
            self._grow(base + span + 1)
            if base + first >= self.top or (self.check[base + children] < 0).all():
                break
            slot += 1
        else:
            base = self.top - first
            self._grow(base + span + 1)
        self.base[state] = base
        self.check[base + children] = state
        self.top = max(self.top, base + span + 1)
        while self.low < self.top and self.check[self.low] >= 0:
            self.low += 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def walk(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next state of each sequence, -1 where there is none."""
        to = self.base[np.maximum(states, 0)] + codes
        inside = (states >= 0) & (codes >= 0) & (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states) & (to > 0), to, -1)


def _dense(values: list[bytes]) -> np.ndarray:
    """Dense ids of 16-byte names, in their order."""
    return np.unique(np.array(values, "S17"), return_inverse=True)[1].astype(np.int64)


def shard_nodes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Nodes of one shard: its segments walk a double array together."""
    count = batch.num_rows
    turns = batch.column("turns")
    bounds = np.append(0, np.cumsum(np.asarray(turns.value_lengths(), np.int64)))
    cells = turns.flatten()
    sizes = np.diff(bounds)
    # the name of the start is the first symbol: segments of one shard may start at many nodes;
    # a byte in front keeps NULs at the end of a name
    names = [b"s" + x for x in batch.column("start").to_pylist()]
    names += [b"t" + x for x in cells.field("turn").to_pylist()]
    dense = _dense(names)
    codes = np.full((count, int(sizes.max(initial=0)) + 1), -1, np.int64)
    codes[:, 0] = dense[:count]
    rows = np.repeat(np.arange(count), sizes)
    places = np.arange(len(rows)) - np.repeat(bounds[:-1], sizes) + 1
    codes[rows, places] = dense[count:]
    order = np.lexsort(codes.T[::-1])
    trie = DoubleArray(codes[order])
    paths = np.empty_like(trie.paths)
    paths[order] = trie.paths

    states = paths[rows, places]
    convs = batch.column("conv_id").to_numpy()[rows]
    found, first, member = np.unique(states, return_index=True, return_inverse=True)
    smallest = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(smallest, member, convs)
    node = cells.field("node")
    # a segment's first turn hangs on its start, the others on the turn before
    before = np.where(places[first] > 1, first - 1, -1)
    start = batch.column("start")
    parents = [node[int(b)].as_py() if b >= 0 else start[int(rows[f])].as_py()
               for b, f in zip(before, first)]
    at = pa.array(first)
    return pa.RecordBatch.from_arrays(
        [node.take(at), pa.array(parents, pa.binary()), cells.field("depth").take(at),
         cells.field("chars").take(at), pa.array(np.bincount(member, minlength=len(found))),
         pa.array(smallest)],
        names=["node", "parent", "depth", "chars", "n_convs", "conv_id"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            yield shard_nodes(batch.slice(at, SHARD))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, int]]:
    """Node, start and end of each run of rows with one node."""
    nodes = batch.column("node").to_pylist()
    cuts = [0, *(n for n in range(1, len(nodes)) if nodes[n] != nodes[n - 1]), len(nodes)]
    return ((nodes[a], a, b) for a, b in zip(cuts[:-1], cuts[1:]) if a < b)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node as text, one row for each run of them in a batch."""
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        rows = [(node, ids[a], ",".join(map(str, ids[a:b]))) for node, a, b in _runs(batch)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], kind)
             for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))],
            names=["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts in their order, streamed: nothing is gathered."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        texts, done = batch.column("ids").to_pylist(), []
        for own, a, b in _runs(batch):
            text = ",".join(texts[a:b]).encode()
            if own == node:
                digest.update(b"," + text)
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(text)
        yield _hashed(done)
    if node is not None:
        yield _hashed([(node, digest.hexdigest())])


def _hashed(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())],
        names=["node", "ends_sha256"])


def ends_of(last: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id).

    Ids are sorted and written out in ranges, so a node where a third of all conversations end is
    spread; only the hash itself, which is serial by its definition, reads a node's text in one
    stream.
    """
    listed = last.repartitionByRange("node", "conv_id").sortWithinPartitions(
        "node", "conv_id").mapInArrow(_listed, "node binary, first long, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        _digests, "node binary, ends_sha256 string")


def _borrowed(conv_id: str) -> Column:
    """Turns that a conversation takes from the head of its hundred."""
    return F.crc32(F.col(conv_id).cast("string")) % 6


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, turn, chars) of the rebuilt conversations, and all their ids.

    ``turn`` is a digest of role and text. Turns that tie stand in order of their digests.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("asked"),
        digest.alias("turn"), F.length(text).cast("long").alias("chars"))
    placed = grouped_rank(turns, ["conv_id"], [F.col("asked").asc_nulls_first(),
                                               F.col("turn").asc()]).drop("asked")
    own = placed.withColumns({"h": _borrowed("conv_id"),
                              "head": F.col("conv_id") - F.col("conv_id") % 100})
    # ``_borrowed`` is 5 at most, and a hundred has 100 conversations
    heads = placed.filter("conv_id % 100 = 0 AND rank <= 5").select(
        F.col("conv_id").alias("head"), "rank", "turn", "chars", F.least(
            F.col("total"), F.lit(5)).alias("held"))
    ids = own.filter("rank = 1").select("conv_id", "h", "head")
    taken = ids.join(heads, "head").filter("rank <= h").select(
        "conv_id", F.col("rank").alias("depth"), "turn", "chars")
    rest = own.filter("rank > h").join(
        heads.filter("rank = 1").select("head", "held"), "head", "left").select(
        "conv_id", (F.col("rank") - F.col("h") + F.least(
            F.col("h"), F.coalesce("held", F.lit(0)))).alias("depth"), "turn", "chars")
    return taken.unionByName(rest), ids.select("conv_id")


def _named(rows: DataFrame) -> DataFrame:
    """Add the ``node`` of each row and whether the conversation ends there."""
    low = F.lit(0xFFFFFFFF)
    one, two = F.xxhash64("turn", "depth"), F.xxhash64("depth", F.lit(13), "turn")
    lanes = {"lane0": F.shiftrightunsigned(one, 32), "lane1": one.bitwiseAND(low),
             "lane2": F.shiftrightunsigned(two, 32), "lane3": two.bitwiseAND(low),
             "turns": F.lit(1)}
    summed = running_totals(rows.withColumns(lanes), ["conv_id"], "depth", list(lanes))
    return summed.select(
        "conv_id", "depth", "turn", "chars",
        F.unhex(F.md5(F.concat_ws(",", "depth", *(f"run_{lane}" for lane in LANES))))
        .alias("node"), (F.col("depth") == F.col("total_turns")).alias("last"))


def _segments(rows: DataFrame) -> DataFrame:
    """Runs of at most SEGMENT turns, with the node that each starts from."""
    run = F.floor((F.col("depth") - 1) / SEGMENT)
    cells = F.struct("depth", "turn", "node", "chars")
    # the last turn of a run is handed on as the start of the next
    starts = rows.filter(F.col("depth") % SEGMENT == 0).filter("NOT last").select(
        "conv_id", run.alias("run") + 1, F.col("node").alias("start"), F.lit(None).alias("cell"))
    own = rows.select("conv_id", run.alias("run"), F.lit(None).cast("binary").alias("start"),
                      cells.alias("cell"))
    starts = starts.toDF("conv_id", "run", "start", "cell").withColumn(
        "cell", F.col("cell").cast(own.schema["cell"].dataType))
    return own.unionByName(starts).groupBy("conv_id", "run").agg(
        F.max("start").alias("start"), F.sort_array(F.collect_list("cell")).alias("turns")).select(
        "conv_id", F.coalesce("start", F.lit(ROOT)).alias("start"), "turns")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Rows are ordered by ``turn``, null first, ties by a digest of role and text; null roles and
    texts are empty. Rows without ``conv_id`` belong to no conversation and are left out.
    Repeated rows are turns like others. A conversation without turns after rebuilding ends at the
    root; without any conversation there is no node. Other columns are left out, so their
    names can't clash. Texts of any length are one digest and a count of code points.
    """
    rows, ids = rebuilt(conversations)
    rows = staged(_named(rows), "turns")
    convs = ids.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))

    ordered = _segments(rows).repartitionByRange(
        F.col("start"), F.transform("turns", lambda t: t["turn"]), F.col("conv_id")
    ).sortWithinPartitions(F.col("start"), F.transform("turns", lambda t: t["turn"]))
    parts = ordered.mapInArrow(_shards, NODE)
    root = convs.filter("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"),
        "n_convs", "conv_id")
    merged = staged(parts.unionByName(root).groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"),
        F.max("chars").alias("chars"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id")), "nodes")

    children = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count("*").alias("n_children"))
    nodes = staged(merged.join(children, "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # every node is met once: at its depth in its smallest member
    valued = nodes.filter("depth > 0").select(
        "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    worth = rows.select("conv_id", "depth", "node").join(
        valued, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
    sums = running_totals(worth, ["conv_id"], "depth", ["leaf", "saved"], descending=True)
    below = sums.groupBy("node").agg(F.sum("run_leaf").alias("n_leaves"),
                                     F.sum("run_saved").alias("saved_tokens"))
    everything = valued.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"),
                            F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
    # a tree of the root alone has the root as its only leaf
    below = below.unionByName(everything.select(
        F.lit(ROOT).alias("node"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        "saved_tokens"))

    last = rows.filter("last").select("node", "conv_id")
    nothing = ids.join(rows.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(
        F.lit(ROOT).alias("node"), "conv_id")
    ends = ends_of(last.unionByName(nothing))

    above = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(below, "node").join(ends, "node", "left").join(
        above, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
        .alias("ends_sha256"))
