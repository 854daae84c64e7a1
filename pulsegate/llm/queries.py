"""The registered queries of the operators, with SQL where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegate.llm import (bpe, conversation_trie, decontamination, exact, language, licenses,
                           minhash, pipeline, quality_rules, sharding, substring, toxicity, warc, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@_query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), 35).select(
        "doc_id", "cut.n_words", "cut.n_removed",
        F.sha2("cut.kept_text", 256).alias("kept_sha256"))


@_query("op2_minhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 4, 80).select(
        "doc_id", "n_shingles", "component_id", "kept")


@_query("op3_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@_query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents")).select(
        "doc_id", (language.bucket(F.col("doc_id")) == 0).alias("held_out"),
        "language.lang_pred", "language.score")


@_query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"),
                             public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", F.size("text_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("text_ids").cast("array<string>"), " "), 256)
        .alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("kept_lines")


@_query("op8_warc")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), 0)


@_query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf_dir, "documents"),
                                     _table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", (language.bucket(F.col("doc_id")) == 0).alias("held_out"), "toxicity.score",
        F.when(F.col("toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"))


@_query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(_table(spark, sf_dir, "documents"),
                                       _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", "leak.item_id", "leak.start", "leak.n_words", "leak.similarity")


_EXACT_SQL = """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)"""


@_query("op11_exact_dedup", _EXACT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


@_query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), 4)
    return rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(
        F.arrays_zip("whitened", "explained")).alias("place", "own")).select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
        "own.whitened", "own.explained", "identity_error")


#: The checksum of a decimal number, bit by bit: the SQL engine of the checks has no crc32.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(
        string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
        lambda a, x: list_reduce(list_concat([xor(a, x)], [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda b, y: xor(b // 2, 3988292384 * (b % 2)))), 4294967295)"""
_TRIE_SQL = f"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, count(*) AS n, {_CRC_SQL} % 6 AS h
        FROM t GROUP BY conv_id),
    r AS (SELECT c.conv_id, pos AS d, role, text FROM c JOIN t ON t.conv_id = head AND pos <= h
        UNION ALL
        SELECT c.conv_id, pos - c.h + least(c.h, coalesce(k.n, 0)), role, text
        FROM c JOIN t USING (conv_id) LEFT JOIN c k ON k.conv_id = c.head WHERE pos > c.h),
    p AS (SELECT conv_id, d, length(text) AS chars,
            string_agg(md5(concat(length(role), ':', role, text)), '') OVER (
                PARTITION BY conv_id ORDER BY d) AS path FROM r
        UNION ALL SELECT conv_id, 0, 0, '' FROM c),
    n AS (SELECT path, d AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id,
            count(*) AS n_convs FROM p GROUP BY path, d),
    k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n
        WHERE depth > 0 GROUP BY 1),
    v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
    s AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves,
            sum((b.n_convs - 1) * b.chars) AS saved_tokens
        FROM v a JOIN v b ON starts_with(b.path, a.path) GROUP BY a.path),
    e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, max_by(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path)
    SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens,
        sha256(coalesce(ids, '')) AS ends_sha256
    FROM v JOIN s USING (path) LEFT JOIN e USING (path)
    LEFT JOIN v u ON v.depth > 0 AND u.path = left(v.path, length(v.path) - 32)"""


@_query("op13_conversation_trie", _TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES["pipeline"] = pipeline.run
if pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
