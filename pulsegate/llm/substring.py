"""Substring dedup by level-wise doubling (operator 1).

A window is ``window`` consecutive words. A word goes if a window that covers it also starts
anywhere else. The search doubles lengths and extends only what repeats:

1. Half windows (18 of 35 words). A window is represented by the smallest hash among its half
   windows; equal windows have equal smallest halves, so only these (a tenth of all) are counted,
   and a window whose half occurs once is unique.
2. Stretches. Neighbouring windows that share their smallest half form a stretch of up to twice
   its length. Where a half repeats, whole stretches are counted: every window of a stretch that
   occurs twice repeats.
3. Windows. A stretch that occurs once though its half repeats is opened: its windows are
   counted against one copy of each other stretch with that half.

Nothing is left after that: longer repeats would remove the same words. Counting is by sums
that combine before the shuffle, joins are with tables of unique keys, so Spark can split a hot
key, and copies of a passage meet as one stretch and a count. Window and stretch keys have 96
bits and more.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsegate.llm.common import (PLAIN, arrow_rows, grams, hashed_words, joined, keyed, mix,
                                  owners, signed, staged, take)

_KEYS = "c.doc_id <=> p.doc_id AND c.text_key = p.text_key"


def smallest_within(values: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest (the last of equals) of each ``span`` consecutive values."""
    places, length = np.arange(len(values)), 1
    while length < span:
        step = min(length, span - length)
        left, right = places[:-step], places[step:]
        places = np.where(values[right] <= values[left], right, left)
        length += step
    return places


def _tail(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint32).view(np.int32))


def _pairs(halves: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows that start at ``at``."""
    left, right = halves[at], halves[at + shift]
    return joined(left, right), joined(mix(right), left)


def _stretches(window: int, halves_only: bool):
    """Batch function: one row per stretch, or its half window only."""
    size = (window + 1) // 2

    def make(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        words, bounds = hashed_words(batch.column("text"), PLAIN)
        if len(words) < window:
            return None
        row = owners(bounds)
        valid = row[:len(row) - window + 1] == row[window - 1:]
        halves = grams(words, size)
        at = smallest_within(halves, window - size + 1)
        turn = np.diff(at, prepend=-1) != 0
        turn[1:] |= ~valid[:-1]
        first = np.flatnonzero(turn & valid)
        if not len(first):
            return None
        half = signed(halves[at[first]])
        if halves_only:
            return pa.RecordBatch.from_arrays([half], names=["half"])
        turn |= ~valid
        edges = np.append(np.flatnonzero(turn), len(turn))
        last = edges[np.searchsorted(edges, first) + 1] - 1
        shift = window - size
        (one, two), (three, four) = _pairs(halves, first, shift), _pairs(halves, last, shift)
        own = row[first]
        return pa.RecordBatch.from_arrays(
            [half, signed(joined(one, three)), _tail(joined(two, four)),
             take(batch, "doc_id", own), take(batch, "text_key", own),
             pa.array((first - bounds[own]).astype(np.int32)),
             pa.array((last - first + 1).astype(np.int32))],
            names=["half", "body", "tail", "doc_id", "text_key", "start", "count"])
    return make


def _windows(window: int):
    """Batch function: the windows of the listed stretches of each row."""
    size = (window + 1) // 2

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, bounds = hashed_words(batch.column("text"), PLAIN)
        halves = grams(words, size)
        lists = batch.column("stretches")
        owner = owners(np.asarray(lists.offsets))
        start, count, copies = (np.asarray(field) for field in lists.flatten().flatten())
        base = np.repeat(bounds[owner] + start, count)
        step = np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)
        at, own = base + step, np.repeat(owner, count)
        key, tail = _pairs(halves, at, window - size)
        return pa.RecordBatch.from_arrays(
            [signed(key), _tail(tail), take(batch, "doc_id", own), take(batch, "text_key", own),
             pa.array((at - bounds[own]).astype(np.int32)),
             pa.array(np.repeat(copies, count))],
            names=["body", "tail", "doc_id", "text_key", "start", "copies"])
    return make


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """``doc_id, text_key, spans``: runs (start, count) of windows that also start elsewhere.

    ``text_key`` is ``xxhash64(text)``. Rows without such windows are absent: null and empty
    texts, and texts under ``window`` words. Rows that repeat (same id and text) repeat each
    other's windows. Null ids are ids like others. Spans may touch or overlap.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    place = f"doc_id {id_type}, text_key long, start int"
    rows = keyed(docs)
    halves = arrow_rows(rows, _stretches(window, True), "half long", "text")
    # sums are written before they are joined: between two plain shuffles Spark can split a hot key
    repeated = staged(halves.groupBy("half").count().filter("count > 1").select("half"), "halves")
    found = staged(
        arrow_rows(rows, _stretches(window, False),
                   f"half long, body long, tail int, {place}, count int", "text")
        .join(repeated, "half"), "stretches")
    bodies = staged(
        found.groupBy("half", "body", "tail").agg(
            F.count("*").alias("copies"),
            F.min(F.struct("doc_id", "text_key", "start", "count")).alias("first")), "bodies")
    whole = found.join(bodies.filter("copies > 1").select("half", "body", "tail"),
                       ["half", "body", "tail"]).select("doc_id", "text_key", "start", "count")

    single = bodies.filter("copies = 1")
    others = bodies.filter("copies > 1").join(single.select("half").distinct(), "half",
                                              "left_semi")
    # two stand for all copies of a stretch: enough to make a window repeat
    opened = single.select("first.*", F.lit(1).alias("copies")).unionAll(
        others.select("first.*", F.lit(2).alias("copies")))
    listed = opened.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "count", "copies")).alias("stretches"))
    # one row of each text: repeated rows must not count as further places here
    texts = rows.alias("c").join(listed.alias("p"), F.expr(_KEYS)).select("c.*", "p.stretches")
    windows = staged(arrow_rows(texts, _windows(window),
                                f"body long, tail int, {place}, copies int", "text")
                     .dropDuplicates(), "windows")
    again = staged(windows.groupBy("body", "tail").agg(F.sum("copies").alias("n")).filter(
        "n > 1").select("body", "tail"), "again")
    part = windows.filter("copies = 1").join(again, ["body", "tail"]).select(
        "doc_id", "text_key", "start", F.lit(1).alias("count"))
    return staged(whole.unionAll(part).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "count")).alias("spans")), "spans")


CUT = T.StructType([T.StructField("n_words", T.LongType(), False),
                    T.StructField("n_removed", T.LongType(), False),
                    T.StructField("kept_text", T.StringType(), False)])


def _cut(text: str | None, starts, counts, window: int) -> tuple[int, int, str]:
    words = text.encode().split() if text else []
    if starts is None or not len(starts):
        return len(words), 0, b" ".join(words).decode()
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + counts + window - 1, -1)
    keep = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    return len(words), len(words) - len(keep), b" ".join([words[k] for k in keep]).decode()


def _cutter(window: int):
    @F.pandas_udf(CUT)
    def cut(text: pd.Series, starts: pd.Series, counts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_cut(*row, window) for row in zip(text, starts, counts)],
                            columns=CUT.names)
    return cut


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``cut``: n_words, n_removed, kept_text.

    ``kept_text`` holds the kept words joined by one space ('' for null and empty texts).
    Windows are judged on the input, not on what is left. An input column named ``cut`` is
    replaced; any other column stays as it is.
    """
    spans = repeated_spans(docs, window).select(
        F.col("doc_id").alias("_span_id"), F.col("text_key").alias("_span_key"),
        F.col("spans.start").alias("_span_starts"), F.col("spans.count").alias("_span_counts"))
    same: Column = docs["doc_id"].eqNullSafe(spans["_span_id"]) & (
        F.xxhash64(docs["text"]) == spans["_span_key"])
    rows = docs.drop("cut").join(spans, same, "left")
    return rows.withColumn("cut", _cutter(window)("text", "_span_starts", "_span_counts")).drop(
        *spans.columns)
