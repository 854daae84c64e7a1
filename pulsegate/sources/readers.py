"""Batch and streaming sources with explicit schemas."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from pulsegate.operators.prefix import global_rank
from pulsegate.schema import TELEMETRY, TRAJECTORY_COLUMNS
from pulsegate.staging import stage

CORRUPT = "_corrupt_record"
METRIC_DDL = ("batch_id BIGINT, received BIGINT, accepted BIGINT, quarantined BIGINT, "
              "duration_ms DOUBLE, processing_rows_per_second DOUBLE, processed_at TIMESTAMP")


def kafka_stream(spark: SparkSession, servers: str, topic: str,
                 max_offsets: int = 50_000) -> DataFrame:
    """Raw Kafka records from the earliest offset, a bounded number per trigger."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest")
            .option("maxOffsetsPerTrigger", max_offsets).load())


def parse_messages(messages: DataFrame, schema: StructType | str = TELEMETRY) -> DataFrame:
    """Typed columns from a message value, next to the raw text and broker position.

    Text that is not valid JSON keeps its raw form and is returned in ``_corrupt_record``.
    """
    if isinstance(schema, StructType):
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    else:
        ddl = schema
    text = messages.select(
        F.col("value").cast("string").alias("raw_json"),
        F.col("timestamp").alias("kafka_time"), F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("raw_json", f"{ddl}, {CORRUPT} STRING", options)
    return text.withColumn("_d", parsed).select(*text.columns, "_d.*")


def telemetry_files(spark: SparkSession, path: str, pattern: str | None = None,
                    keep_corrupt: bool = False) -> DataFrame:
    """NDJSON telemetry under a folder or in one file, read with the explicit schema."""
    schema = StructType(list(TELEMETRY))
    if keep_corrupt:
        schema = schema.add(CORRUPT, "string")
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.json(path)


def telemetry_files_inferred(spark: SparkSession, path: str,
                             sampling: float = 1.0) -> DataFrame:
    """The same scan with a schema inferred from (a share of) the text; for comparison."""
    return (spark.read.option("recursiveFileLookup", "true")
            .option("samplingRatio", sampling).json(path))


def telemetry_inbox(spark: SparkSession, path: str, max_files: int = 4) -> DataFrame:
    """File stream over an inbox of whole NDJSON files, a bounded number per trigger."""
    return (spark.readStream.schema(StructType(list(TELEMETRY)).add(CORRUPT, "string"))
            .option("maxFilesPerTrigger", max_files).json(path))


def validated_events(spark: SparkSession, path: str) -> DataFrame:
    """Validated Parquet with partition discovery, so day and centre filters prune files."""
    return spark.read.parquet(path)


def telemetry_sources(spark: SparkSession, path: str) -> DataFrame:
    """Sorted files a telemetry path resolves to; an error when there are none."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.{json,ndjson}").load(path).select("path"))
    if listing.isEmpty():
        raise FileNotFoundError(f"no JSON or NDJSON files under {path}")
    return listing.orderBy("path")


def as_raw_json(frame: DataFrame, keep: list[str]) -> DataFrame:
    """Records as JSON text without their null fields, next to the columns to keep."""
    return frame.select(*keep, F.to_json(F.struct("*")).alias("raw_json"))


def _kind(name: str) -> str:
    return "bigint" if name in ("unit_id", "cycle") else "double"


def _tokens(text: str) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def parse_trajectory(lines: DataFrame, columns: list[str] = TRAJECTORY_COLUMNS,
                     text: str = "value") -> DataFrame:
    """Typed columns from whitespace-separated lines.

    A line with another number of tokens, or one that is not a number, fails the job when it
    is read; no counting pass is needed.
    """
    tokens = lines.select(_tokens(text).alias("tokens"))
    whole = F.size("tokens") == len(columns)
    values = [F.get("tokens", F.lit(n)).try_cast(_kind(name)) for n, name in enumerate(columns)]
    numeric = F.lit(True)
    for value in values:
        numeric = numeric & value.isNotNull()
    message = F.concat(F.lit(f"expected {len(columns)} numbers in line: "),
                       F.concat_ws(" ", "tokens"))
    return tokens.select(*[
        F.when(whole & numeric, value).otherwise(F.raise_error(message).cast(_kind(name)))
        .alias(name) for value, name in zip(values, columns)])


def trajectory_files(spark: SparkSession, path: str) -> DataFrame:
    return parse_trajectory(spark.read.text(path))


def ordered_values(texts: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """(position, value) for each whitespace-separated number of a text, from 1."""
    return (texts.select(*(keep or []), F.posexplode(_tokens(text)).alias("_n", "_token"))
            .select(*(keep or []), (F.col("_n") + 1).cast("bigint").alias("position"),
                    F.col("_token").try_cast("double").alias("value")))


def rul_labels(spark: SparkSession, path: str) -> DataFrame:
    """The n-th number of the truth files is the remaining life of unit n.

    Numbers are ranked by file, block, line within the scan and place in the line, so a file is
    read in as many tasks as it has blocks.
    """
    place = ["file", "block", "line", "position"]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).where("trim(value) <> ''")
    numbers = stage(ordered_values(lines, "value", place[:3]).withColumnRenamed(
        "value", "actual_rul"), "life-numbers")
    return global_rank(numbers, [F.col(c) for c in place]).select(
        F.col("rank").alias("unit_id"), "actual_rul")


def prepared_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def _metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the appended metrics, readable or not; a missing folder is empty."""
    schema = f"{METRIC_DDL}, {CORRUPT} STRING"
    try:
        lines = (spark.read.schema(schema).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT)
                 .option("recursiveFileLookup", "true").json(path))
    except AnalysisException:
        return spark.createDataFrame([], schema)
    # only columns that are read are checked: all of them, whatever is selected later
    values = [c for c in lines.columns if c != CORRUPT]
    return lines.where(F.length(F.to_json(F.struct(*values))) > 0)


def stream_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Appended per-batch metrics that can be read; ``unreadable_metrics`` has the other lines."""
    return _metric_lines(spark, path).where(f"{CORRUPT} IS NULL").drop(CORRUPT)


def unreadable_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of each metric line that is not valid JSON of the expected types."""
    return _metric_lines(spark, path).where(f"{CORRUPT} IS NOT NULL").select(
        F.input_file_name().alias("file"), F.col(CORRUPT).alias("line"))


def keep_unreadable_metrics(spark: SparkSession, path: str, folder: str) -> int:
    """Write the unreadable lines to a side table and return how many there are."""
    unreadable_metrics(spark, path).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder).count()


def report(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON report, or None when it is missing or not JSON."""
    try:
        frame = spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return None
    return None if not frame.columns or frame.columns == [CORRUPT] else frame
