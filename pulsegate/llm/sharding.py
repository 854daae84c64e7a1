"""Sharding by vector bin packing (operator 3).

Bytes, tokens and rows of all shards are balanced together: items are placed from large to small
on the shard where the dot product of the item and the residual capacity is highest.

Items are made by Spark so that their number is bounded whatever the data: groups of equal
texts that are heavier than 1 / ``HEAVY`` of a total stand alone (there can be no more than
3 * HEAVY), the others are gathered by hash into ``shards * BUNDLES`` bundles. A group heavier
than 1 / ``PIECES`` of a shard is cut by id into pieces, as no shard can hold a third of all rows.
Only these sums reach the driver, and the small table item -> shard is all that is broadcast.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegate.llm.common import staged

#: Bundles of light groups per shard, groups that stand alone, pieces of a heavy group per shard.
BUNDLES, HEAVY, PIECES = 128, 1500, 8
#: Rows numbered by one task.
CHUNK = 100_000


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; ``sizes`` has one row per item and one column per dimension."""
    totals = np.maximum(sizes.sum(axis=0), 1)
    share = sizes / totals
    residual = np.full((shards, sizes.shape[1]), 1 / shards)
    out = np.zeros(len(sizes), np.int64)
    for item in np.lexsort((np.arange(len(sizes)), -share.max(axis=1))):
        fits = (residual >= share[item] - 1e-15).all(axis=1)
        score = residual @ share[item]
        # without a shard that has room in all dimensions, the one that is left fullest of room
        place = np.argmax(np.where(fits, score, -np.inf)) if fits.any() else np.argmax(
            (residual - share[item]).min(axis=1))
        out[item] = place
        residual[place] -= share[item]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 8), tokens, text_crc32 and group (equal texts) of each row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text, F.octet_length(text)).alias("group"))


def _item(shards: int) -> Column:
    """Name of the item of a row: a piece of a heavy group, or a bundle."""
    piece = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("pieces"))
    bundle = F.pmod(F.xxhash64("group"), F.lit(shards * BUNDLES))
    return F.when(F.col("pieces").isNotNull(), F.concat_ws("-", F.lit("group"), "group", piece)
                  ).otherwise(F.concat_ws("-", F.lit("bundle"), bundle))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, tokens, text_crc32, shard, slot.

    Sizes of shards are near equal (law ``bytes``), tokens and rows are balanced with them. Rows
    of equal text share a shard unless their group is heavier than an eighth of a shard. ``slot``
    counts from 0 without gaps in each shard. Null texts have no bytes besides the 8 of the
    id; null ids and repeated rows are rows like others, no rows give no rows. Only doc_id and
    text are read.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = staged(sized(docs).withColumn("row", F.monotonically_increasing_id()), "sized")
    dims = ["size", "tokens", "rows"]
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"),
                     F.count("*").alias("rows")).first()
    count = total["rows"]
    if not count:
        return rows.select("doc_id", "size", "tokens", "text_crc32",
                           F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"),
                                       F.sum("tokens").alias("tokens"),
                                       F.count("*").alias("rows"))
    part = F.greatest(*(F.col(d) / max(total[d], 1) for d in dims))
    heavy = groups.withColumn("part", part).filter(F.col("part") * HEAVY > 1).select(
        "group", F.ceil(F.col("part") * shards * PIECES).alias("pieces"))
    # under 3 * HEAVY rows
    items = rows.join(F.broadcast(heavy), "group", "left").withColumn("item", _item(shards))
    sums = items.groupBy("item").agg(
        F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("item").collect()
    places = pack(np.array([row[1:] for row in sums], float), shards)
    table = docs.sparkSession.createDataFrame(
        [(row[0], int(place)) for row, place in zip(sums, places)], "item string, shard int")
    placed = items.join(F.broadcast(table), "item").withColumn(
        "chunk", F.pmod(F.xxhash64("row"), F.lit(math.ceil(count / shards / CHUNK))))
    counts = placed.groupBy("shard", "chunk").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("row"))
    # a row per shard and CHUNK rows; the planner picks the join by its size
    return placed.withColumn("number", within).join(counts, ["shard", "chunk"]).select(
        "doc_id", "size", "tokens", "text_crc32", "shard",
        (F.col("number") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("slot"))
