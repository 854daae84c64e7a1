"""Toxicity by nearest labelled examples (operator 9).

Texts are TF-IDF vectors over all words of the examples and their beginnings of four letters.
The nearest examples by exact cosine are found with a block-max inverted index: examples that are
alike share a block, each term has its postings and its largest weight per block. The commonest
terms are summed for every example; that sum, with a query's weights times the block maxima of
its other terms, is a bound for the block. Blocks are opened from the highest bound on, and those
whose bound does not reach the k-th similarity stay closed. Votes are weighted by similarity and
calibrated by isotonic regression on the examples themselves, each left out of its own vote; the
same votes choose k.

Examples, terms and the calibration come from at most ``sample`` labelled rows of at most
``sample_bytes`` of text that are not held out (half of each label, smallest hashes of the id).
Document frequencies and scores cover all rows and whole texts.
"""
from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from pulsegate.llm.common import (arrow_rows, bounded, buffers, byte_table, mix, owners,
                                  small_batches, staged)
from pulsegate.llm.language import bucket

#: Examples of a block, terms whose postings are kept as a dense matrix, terms that decide which
#: examples share a block, queries of one product.
BLOCK, DENSE, AXES, TOGETHER = 64, 1024, 256, 256
#: More than sums in another order can be off.
SLACK = 1e-9
#: Letters of word beginnings; results a worker remembers.
BEGINNINGS, MEMORY = (4,), 200_000
#: Numbers of neighbours to choose from.
NEIGHBOURS = (25, 100, 400)
#: ASCII that is not part of a word.
_CODES = byte_table(bytes([*range(33), 127]) + string.punctuation.encode())
_PLACES = mix(np.arange(1 << 12, dtype=np.uint64)) | np.uint64(1)
SCORE = T.StructType([
    T.StructField("score", T.DoubleType(), False),
    T.StructField("evidence", T.ArrayType(T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("similarity", T.DoubleType()),
        T.StructField("toxic", T.IntegerType())])), False)])


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each word of ``column`` and of its beginnings, in lower case.

    Words are what stands between blanks, controls and punctuation of ASCII, Latin-1 (U+0080 to
    U+00BF) and general punctuation (U+2000 to U+203F); nulls have none. Everything is summed over
    the UTF-8 buffer, without a Python object per word.
    """
    data, offsets = buffers(pc.utf8_lower(column))
    nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    codes = _CODES[data]
    for at in np.flatnonzero(data == 0xC2), np.flatnonzero(data == 0xE2):
        # lead byte C2 has U+0080 to U+00BF only; E2 80 has U+2000 to U+203F
        if len(at) and data[at[0]] == 0xE2:
            at = at[data[at + 1] == 0x80]
            codes[at + 2] = 0
        codes[at] = codes[at + 1] = 0
    inside = codes != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return nothing
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    # blanks after a word may be many; their code is 0
    longest = int((ends - starts).max())
    weights = _PLACES if longest <= len(_PLACES) else mix(
        np.arange(longest, dtype=np.uint64)) | np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[starts[0]:] * weights[np.minimum(place, len(weights) - 1)],
              out=sums[starts[0] + 1:])
    rows = owners(np.searchsorted(starts, offsets))
    found = [(rows, mix(sums[ends] - sums[starts]))]
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    own = np.searchsorted(letters, starts)
    letters = np.append(letters, np.full(max(BEGINNINGS, default=0) + 1, len(data)))
    for size in BEGINNINGS:
        full = letters[own + size - 1] < ends
        to = np.minimum(letters[own + size], ends)[full]
        found.append((rows[full], mix((sums[to] - sums[starts[full]]) ^ np.uint64(size))))
    return np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found])


class Vocabulary:
    """Numbers of the known terms: places in their sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.__setstate__({"hashes": np.sort(hashes)})

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    def __setstate__(self, state: dict):
        self.hashes = state["hashes"]
        # first place of the hashes that begin with the same bits: about one in four has any
        bits = len(self.hashes).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.heads = np.searchsorted(
            self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.ended = np.append(self.hashes, np.uint64(2 ** 64 - 1))

    def __len__(self) -> int:
        return len(self.hashes)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each of ``hashes``, or -1."""
        at = self.heads[hashes >> self.shift].astype(np.int64)
        behind = np.flatnonzero(self.ended[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.ended[at[behind]] < hashes[behind]]
        at[(self.ended[at] != hashes) | (at == len(self))] = -1
        return at

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the rows of ``column``, and their known terms in order with their counts."""
        rows, hashes = tokens(column)
        if not len(hashes) or not len(self):
            return np.zeros(len(column) + 1, np.int64), *[np.zeros(0, np.int64)] * 2
        at = self.places(hashes)
        keys, counts = np.unique((rows * len(self) + at)[at >= 0], return_counts=True)
        return (np.searchsorted(keys, np.arange(len(column) + 1) * len(self)), keys % len(self),
                counts)


@dataclass
class Rows:
    """Sparse vectors: the terms and weights of row n stand at bounds[n]:bounds[n + 1]."""
    bounds: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    width: int

    @classmethod
    def of(cls, dense: np.ndarray) -> Rows:
        rows, terms = np.nonzero(dense)
        return cls(np.searchsorted(rows, np.arange(len(dense) + 1)), terms, dense[rows, terms],
                   dense.shape[1])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def __getitem__(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.bounds)[order]
        at = _ranges(self.bounds[:-1][order], sizes)
        return Rows(np.append(0, np.cumsum(sizes)), self.terms[at], self.weights[at], self.width)

    def row(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.bounds[n], self.bounds[n + 1])
        return self.terms[at], self.weights[at]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _clustered(rows: Rows, ids: np.ndarray) -> np.ndarray:
    """Order in which like examples are neighbours: halves along the main axis, down to blocks."""
    common = np.argsort(-np.bincount(rows.terms, minlength=rows.width), kind="stable")[:AXES]
    column = np.full(rows.width, -1)
    column[common] = np.arange(len(common))
    own = column[rows.terms]
    seen = np.zeros((len(rows), len(common)), np.float32)
    seen[np.repeat(np.arange(len(rows)), np.diff(rows.bounds))[own >= 0], own[own >= 0]] = \
        rows.weights[own >= 0]
    parts, out = [np.argsort(ids, kind="stable")], []
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        centred = seen[part] - seen[part].mean(axis=0)
        axis = centred[(centred ** 2).sum(axis=1).argmax()]
        for _ in range(4):
            axis = (centred @ axis) @ centred
            axis = axis / max(float(np.sqrt(axis @ axis)), 1e-30)
        part = part[np.argsort(centred @ axis, kind="stable")]
        half = -(-len(part) // BLOCK) // 2 * BLOCK
        parts += [part[half:], part[:half]]
    return np.concatenate(out)


@dataclass
class BlockMaxIndex:
    """Examples sorted so that like ones share a block, as posting lists with block maxima.

    The lists of the DENSE commonest terms are columns of one matrix. The postings of the others
    are (place, weight) pairs in order of the place; those of one block are an entry of the term:
    its block, its largest weight, its first posting. ``opened`` of ``met`` blocks were summed
    by the searches so far.
    """
    vectors: np.ndarray | Rows  # one row per example, of length 1 or 0
    ids: np.ndarray
    toxic: np.ndarray
    opened: int = 0
    met: int = 0

    def __post_init__(self):
        rows = Rows.of(self.vectors) if isinstance(self.vectors, np.ndarray) else self.vectors
        order = _clustered(rows, self.ids)
        dense = self.vectors is not rows
        self.ids, self.toxic, rows = self.ids[order], self.toxic[order], rows[order]
        self.vectors, self.rows = self.vectors[order] if dense else rows, rows
        self._post(rows)

    def __getstate__(self) -> dict:
        return {"rows": self.rows, "ids": self.ids, "toxic": self.toxic}

    def __setstate__(self, state: dict):
        # postings are made again where they are used: less to send
        self.__dict__.update(state, vectors=state["rows"], opened=0, met=0)
        self._post(self.rows)

    def _post(self, rows: Rows) -> None:
        places = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(rows.bounds))
        common = np.argsort(-np.bincount(rows.terms, minlength=rows.width), kind="stable")[:DENSE]
        self.column = np.full(rows.width, -1, np.int32)
        self.column[common] = np.arange(len(common))
        dense = self.column[rows.terms] >= 0
        self.matrix = np.zeros((len(common), -(-len(rows) // BLOCK) * BLOCK))
        self.matrix[self.column[rows.terms[dense]], places[dense]] = rows.weights[dense]
        by_term = np.flatnonzero(~dense)
        by_term = by_term[np.argsort(rows.terms[by_term], kind="stable")]
        terms = rows.terms[by_term]
        self.places, self.weights = places[by_term].astype(np.int64), rows.weights[by_term]
        blocks = self.places // BLOCK
        first = np.ones(len(terms), bool)
        first[1:] = (terms[1:] != terms[:-1]) | (blocks[1:] != blocks[:-1])
        starts = np.flatnonzero(first)
        self.blocks = blocks[starts]
        self.maxima = np.maximum.reduceat(self.weights, starts) if len(starts) else self.weights
        self.maxima = np.nextafter(self.maxima.astype(np.float32), np.float32(9))
        self.starts, self.lengths = starts, np.diff(starts, append=len(terms))
        self.entries = np.searchsorted(terms[starts], np.arange(rows.width + 1))

    def nearest(self, columns: np.ndarray, weights: np.ndarray, k: int, skip: int = -1,
                ) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the ``k`` nearest with a cosine over 0; ties by id."""
        return next(self.nearest_of([(columns, weights)], k, [skip]))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int,
                   skips: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each query; TOGETHER of them share one product."""
        for at in range(0, len(queries), TOGETHER):
            part = queries[at:at + TOGETHER]
            dense = np.zeros((len(part), len(self.matrix)))
            for n, (columns, weights) in enumerate(part):
                own = self.column[columns]
                dense[n, own[own >= 0]] = weights[own >= 0]
            for n, sums in enumerate(dense @ self.matrix):
                yield self._search(*part[n], sums, k, skips[at + n] if skips else -1)

    def _search(self, columns: np.ndarray, weights: np.ndarray, similar: np.ndarray, k: int,
                skip: int) -> tuple[np.ndarray, np.ndarray]:
        """``similar`` has the shares of the common terms, which no cosine is below.

        Blocks are opened from the highest bound on; the k-th largest of what is summed so far
        rises after each group of them, until no bound of a closed block reaches it.
        """
        size, high = len(self.rows), len(similar) // BLOCK
        similar[size:] = -9
        if skip >= 0:
            similar[skip] = -9
        sizes = self.entries[columns + 1] - self.entries[columns]
        entries, own = _ranges(self.entries[columns], sizes), np.repeat(weights, sizes)
        blocks = self.blocks[entries]
        bounds = similar.reshape(high, BLOCK).max(axis=1) + np.bincount(
            blocks, self.maxima[entries] * own, minlength=high)
        closed, group = np.argsort(-bounds, kind="stable"), 1 + 2 * k // BLOCK
        self.met += high
        reached = similar
        while True:
            least = np.partition(reached, -k)[-k] - SLACK if size > k else 0.0
            closed = closed[bounds[closed] >= least]
            if not len(closed):
                break
            chosen = np.zeros(high, bool)
            chosen[closed[:group]] = True
            self.opened += min(group, len(closed))
            closed, group = closed[group:], 4 * group
            part = np.flatnonzero(chosen[blocks])
            opened = entries[part]
            lengths = self.lengths[opened]
            postings = _ranges(self.starts[opened], lengths)
            similar += np.bincount(
                self.places[postings], self.weights[postings] * np.repeat(own[part], lengths),
                minlength=len(similar))
            # sums only grow: at least k are where the last threshold was
            reached = similar[similar >= least] if size > k else similar
        found = np.flatnonzero(similar >= max(least, 0.0))
        cosines = np.round(similar[found], 12)
        best = np.lexsort((self.ids[found], -cosines))[:k]
        best = best[cosines[best] > 0]
        return found[best], cosines[best]


@dataclass
class ToxicityModel:
    known: Vocabulary
    inverse: np.ndarray
    index: BlockMaxIndex
    weight: tuple[float, float]  # of a vote for 0 and for 1: the sample is not drawn evenly
    k: int
    silent: float = 0.0  # score of a text without terms
    steps: np.ndarray | None = None
    values: np.ndarray | None = None
    sent: Broadcast | None = None  # this model as it was before calibration

    def query(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.inverse[terms]
        return terms, weights / np.sqrt((weights ** 2).sum())

    def vote(self, places: np.ndarray, similar: np.ndarray) -> float:
        weights = similar * np.where(self.index.toxic[places] == 1, self.weight[1], self.weight[0])
        return float((weights * self.index.toxic[places]).sum() / weights.sum())

    def calibrated(self, vote: float) -> float:
        at = max(int(np.searchsorted(self.steps, vote, "right")) - 1, 0)
        return float(self.values[at])

    def scores(self, column: pa.Array) -> list[tuple[float, list]]:
        out: list[tuple[float, list]] = [(self.silent, [])] * len(column)
        bounds, terms, counts = self.known.counts(column)
        spoken = np.flatnonzero(np.diff(bounds)).tolist()
        nearest = self.index.nearest_of(
            [self.query(terms[bounds[n]:bounds[n + 1]], counts[bounds[n]:bounds[n + 1]])
             for n in spoken], self.k)
        for n, (places, similar) in zip(spoken, nearest):
            if len(places):
                evidence = [(int(self.index.ids[p]), float(s), int(self.index.toxic[p]))
                            for p, s in zip(places[:3], similar)]
                out[n] = self.calibrated(self.vote(places, similar)), evidence
        return out


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray,
             ) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the steps of the best rising step function, and its values."""
    steps: list[list[float]] = []
    for vote in np.unique(votes):
        own = votes == vote
        steps.append([vote, (weights * labels)[own].sum(), weights[own].sum()])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, hits, total = steps.pop()
            steps[-1][1] += hits
            steps[-1][2] += total
    table = np.array(steps)
    # half a row of either label keeps scores away from 0 and 1
    return table[:, 0], (table[:, 1] + 0.5 * weights.mean()) / (table[:, 2] + weights.mean())


def _chosen(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> int:
    """Column of ``votes`` whose calibration on one half of the rows fits the other half best."""
    losses = []
    for own in votes.T:
        loss = 0.0
        for half in (0, 1):
            learn = np.arange(len(own)) % 2 == half
            if not learn.any() or learn.all():
                continue
            steps, values = isotonic(own[learn], labels[learn], weights[learn])
            score = values[np.maximum(np.searchsorted(steps, own[~learn], "right") - 1, 0)]
            loss -= (weights[~learn] * np.log(np.where(
                labels[~learn] == 1, score, 1 - score))).sum()
        losses.append(round(loss, 9))
    return int(np.argmin(losses))


def _sample(docs: DataFrame, labels: DataFrame, sample: int, sample_bytes: int,
            ) -> tuple[DataFrame, float]:
    """Bounded labelled rows (doc_id, text, toxic) and the share of label 1 in all."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                           & (bucket(F.col("doc_id")) != 0)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    share = usable.agg(F.avg("toxic")).first()[0]
    drawn = None
    order = [F.xxhash64("doc_id", F.lit(9)), F.col("doc_id")]
    for label in (0, 1):
        part = usable.filter(F.col("toxic") == label).orderBy(*order).limit(sample // 2)
        drawn = part if drawn is None else drawn.unionAll(part)
    # at most ``sample`` ids
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    rows = staged(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    kept = rows.select("doc_id", "toxic", size.alias("size")).filter(
        F.col("size") <= sample_bytes // 2)
    total = F.sum("size").over(Window.partitionBy("toxic").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    kept = kept.withColumn("total", total).filter(F.col("total") <= sample_bytes // 2)
    return rows.join(F.broadcast(kept.select("doc_id")), "doc_id"), share


def _terms_of(docs: DataFrame) -> np.ndarray:
    """Hashes of all terms of the sample."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = np.unique(tokens(batch.column("text"))[1]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(hashes)], names=["term"])

    # terms of ``sample`` texts
    return _numbers(arrow_rows(docs.select("text"), make, "term long", "text").distinct())[0].view(
        np.uint64)


def _numbers(frame: DataFrame) -> list[np.ndarray]:
    """Columns of numbers of a table that the driver can hold."""
    table = frame.toArrow()
    return [column.to_numpy() for column in table.columns]


def document_frequency(docs: DataFrame, known: Vocabulary) -> tuple[np.ndarray, int]:
    """Rows of ``docs`` with each known term, and all rows; one vector per task is summed."""
    size = len(known)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    small_batches(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, np.zeros(size + 1, np.int64)
        for batch in batches:
            total[size] += batch.num_rows
            for part in bounded(batch, "text"):
                total[:size] += np.bincount(own.counts(part.column("text"))[1], minlength=size)
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 1 << 16):
            part = seen[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])],
                                             names=["term", "rows"])

    terms, sums = _numbers(docs.select("text").mapInArrow(count, "term long, rows long").groupBy(
        "term").agg(F.sum("rows").alias("rows")))
    out = np.zeros(size + 1, np.int64)
    out[terms] = sums
    return out[:-1], int(out[-1])


def _left_out(spark: SparkSession, shared: Broadcast, ks: tuple[int, ...], size: int,
              ) -> tuple[np.ndarray, np.ndarray]:
    """Places of the examples with neighbours, and their votes by number of neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            places = [p for p in batch.column(0).to_pylist() if len(model.index.rows.row(p)[0])]
            nearest = model.index.nearest_of([model.index.rows.row(p) for p in places], ks[-1],
                                             places)
            out = [(p, *(model.vote(found[:k], similar[:k]) for k in ks))
                   for p, (found, similar) in zip(places, nearest) if len(found)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    zip(*out) if out else [[]] * (1 + len(ks)),
                    [pa.int64()] + [pa.float64()] * len(ks))],
                names=["place", *(f"vote{k}" for k in ks)])

    tasks = max(min(spark.sparkContext.defaultParallelism, size), 1)
    places, *votes = _numbers(spark.range(0, size, 1, tasks).mapInArrow(
        run, "place long, " + ", ".join(f"vote{k} double" for k in ks)))
    order = np.argsort(places)
    return places[order], np.array(votes).T[order]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000,
        neighbours: tuple[int, ...] = NEIGHBOURS, sample_bytes: int = 1 << 26,
        ) -> ToxicityModel | None:
    """The model, or None if a label has no row to learn from."""
    context = docs.sparkSession.sparkContext
    drawn, share = _sample(docs, labels, sample, sample_bytes)
    sizes = {row["toxic"]: row["count"] for row in drawn.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    n, positive = sum(sizes.values()), sizes[1]
    known = Vocabulary(_terms_of(drawn))
    frequency, rows = document_frequency(docs, known)
    inverse = np.log((1 + rows) / (1 + frequency)) + 1
    shared = context.broadcast(known)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        bounds, *columns = shared.value.counts(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), *(
                pa.array([own[a:b].astype(np.int32).tobytes() for a, b in zip(
                    bounds[:-1], bounds[1:])], pa.binary()) for own in columns)],
            names=["doc_id", "toxic", "terms", "counts"])

    # at most ``sample`` rows, and no more terms than ``sample_bytes``
    examples = arrow_rows(drawn, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
                          "toxic int, terms binary, counts binary", "text").toArrow()
    examples = examples.sort_by("doc_id")
    shared.unpersist()
    parts = [np.frombuffer(cell.as_buffer(), np.int32) for cell in examples["terms"]]
    bounds = np.append(0, np.cumsum([len(part) for part in parts]))
    terms = np.concatenate(parts)
    weights = (1 + np.log(np.concatenate([np.frombuffer(cell.as_buffer(), np.int32)
                                          for cell in examples["counts"]]))) * inverse[terms]
    lengths = np.sqrt([(weights[a:b] ** 2).sum() for a, b in zip(bounds[:-1], bounds[1:])])
    weights /= np.repeat(lengths, np.diff(bounds))
    index = BlockMaxIndex(Rows(bounds, terms, weights, len(known)),
                          examples["doc_id"].to_numpy(), examples["toxic"].to_numpy())
    del examples, parts, terms, weights
    weight = ((1 - share) / (1 - positive / n), share / (positive / n))
    model = ToxicityModel(known, inverse, index, weight, neighbours[-1])
    model.sent = context.broadcast(model)
    own = np.where(index.toxic == 1, weight[1], weight[0])
    blank = np.diff(index.rows.bounds) == 0
    model.silent = float(((own * index.toxic)[blank].sum() + 0.5 * share)
                         / (own[blank].sum() + 0.5))
    kept, votes = _left_out(docs.sparkSession, model.sent, neighbours, n)
    if not len(kept):
        kept, votes = np.array([0]), np.full((1, len(neighbours)), share)
    best = _chosen(votes, index.toxic[kept], own[kept])
    model.k = neighbours[best]
    model.steps, model.values = isotonic(votes[:, best], index.toxic[kept], own[kept])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 8000,
                   neighbours: tuple[int, ...] = NEIGHBOURS, sample_bytes: int = 1 << 26,
                   ) -> DataFrame:
    """All columns of ``docs`` and a struct ``toxicity``: score (0 to 1), evidence.

    Only texts decide. ``evidence`` has the three nearest examples with similarity and label.
    Null and empty texts, and texts without a known term, get the share of toxic rows among
    such examples. A label of several rows is their largest; null labels and ids, and labels
    other than 0 and 1, teach nothing. Without both labels all scores are 0. Repeated rows
    score alike. A column named ``toxicity`` is replaced. Very long texts are scored whole, but
    teach nothing beyond half of ``sample_bytes``; a label is learned from its first rows within
    that half. ``neighbours`` (rising) are the numbers to choose from.
    """
    model = fit(docs, labels, sample, neighbours, sample_bytes)
    shared = model.sent if model else None
    fitted = (model.k, model.silent, model.steps, model.values) if model else None
    small_batches(docs)
    remembered: dict = {}

    @F.pandas_udf(SCORE)
    def toxicity(texts: pd.Series) -> pd.DataFrame:
        if shared is None:
            out = [(0.0, [])] * len(texts)
        else:
            model = shared.value
            model.k, model.silent, model.steps, model.values = fitted
            keys = [hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=16)
                    .digest() for text in texts]
            if len(remembered) >= MEMORY:
                remembered.clear()
            new = {key: text for key, text in zip(keys, texts) if key not in remembered}
            batch = pa.record_batch([pa.array(new.values(), pa.large_string())], ["text"])
            remembered.update(zip(new, [score for part in bounded(batch, "text")
                                        for score in model.scores(part.column(0))]))
            out = [remembered[key] for key in keys]
        return pd.DataFrame({"score": [s for s, _ in out], "evidence": [
            [{"doc_id": d, "similarity": s, "toxic": y} for d, s, y in e] for _, e in out]})

    return docs.withColumn("toxicity", toxicity("text"))
