"""Message log on shared storage: a partitioned, offset-addressed log that Spark writes and streams.

It stands in for a broker with the same columns (key, value, partition, offset, timestamp), so
what reads one reads the other. Tasks write Parquet files; the driver then publishes them all with
one manifest, which is the commit. A manifest names the batch it belongs to: a batch that has one
is not published again, and files without a manifest don't exist for readers.

    <log>/data/<partition>-<name>.parquet       rows (key, value, timestamp) of one task
    <log>/commits/<number>.json                 {"batch": ..., "files": [[partition, name, rows]]}

Offsets count the rows of a partition in the order of the manifests. Storage is anything that
``pyarrow.fs`` opens, reached by all executors. One job at a time writes to a log.
"""
from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader,
                                    DataSourceStreamReader, InputPartition, WriterCommitMessage)

NAME, PARTITIONS = "message_log", 4
SCHEMA = "key STRING, value STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
ROWS = 10_000


class Storage:
    """Files of one log."""

    def __init__(self, path: str):
        self.fs, root = (pafs.FileSystem.from_uri(path) if "://" in path
                         else (pafs.LocalFileSystem(), path))
        self.root = root.rstrip("/")

    def manifests(self) -> list[dict]:
        """Commits in order."""
        selector = pafs.FileSelector(f"{self.root}/commits", allow_not_found=True)
        names = sorted(f.path for f in self.fs.get_file_info(selector) if f.path.endswith(".json"))
        out = []
        for name in names:
            with self.fs.open_input_stream(name) as source:
                out.append(json.loads(source.read()))
        return out

    def publish(self, batch: str, files: list[list]) -> bool:
        """Make the files part of the log, or return False if the batch is in it."""
        known = self.manifests()
        if any(m["batch"] == batch for m in known):
            return False
        self.fs.create_dir(f"{self.root}/commits")
        final = f"{self.root}/commits/{len(known):012d}.json"
        waiting = f"{final}.{uuid.uuid4().hex}.tmp"
        with self.fs.open_output_stream(waiting) as sink:
            sink.write(json.dumps({"batch": batch, "files": files}).encode())
        self.fs.move(waiting, final)
        return True

    def data(self, name: str) -> str:
        return f"{self.root}/data/{name}.parquet"

    def drop(self, files: list[list]) -> None:
        for _, name, _ in files:
            self.fs.delete_file(self.data(name))


@dataclass
class Written(WriterCommitMessage):
    files: list[list]


class LogWriter(DataSourceArrowWriter):
    """Two phases: tasks write files of their own, the driver publishes them together."""

    def __init__(self, options: dict[str, str]):
        self.path, self.batch = options["path"], options["batch"]
        self.partitions = int(options.get("partitions", PARTITIONS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        storage = Storage(self.path)
        storage.fs.create_dir(f"{storage.root}/data")
        open_files: dict[int, tuple[str, pq.ParquetWriter]] = {}
        rows: dict[int, int] = {}
        for batch in iterator:
            keys = batch.column("key").dictionary_encode()
            # the same key always goes to the same partition; rows without one go to the first
            place = np.array([zlib.crc32(k.encode()) % self.partitions
                              for k in keys.dictionary.to_pylist()] + [0], np.int64)
            own = place[keys.indices.fill_null(len(place) - 1).to_numpy(zero_copy_only=False)]
            now = pa.array([datetime.now(timezone.utc)] * batch.num_rows, pa.timestamp("us", "UTC"))
            rows_now = batch.select(["key", "value"]).append_column("timestamp", now)
            for partition in np.unique(own).tolist():
                part = rows_now.take(pa.array(np.flatnonzero(own == partition)))
                if partition not in open_files:
                    name = f"{partition}-{uuid.uuid4().hex}"
                    open_files[partition] = name, pq.ParquetWriter(
                        storage.data(name), part.schema, filesystem=storage.fs)
                open_files[partition][1].write_batch(part)
                rows[partition] = rows.get(partition, 0) + part.num_rows
        for _, writer in open_files.values():
            writer.close()
        return Written([[p, name, rows[p]] for p, (name, _) in sorted(open_files.items())])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [file for m in messages if m is not None for file in m.files]
        storage = Storage(self.path)
        if not storage.publish(self.batch, files):
            storage.drop(files)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        Storage(self.path).drop([file for m in messages if m is not None for file in m.files])


@dataclass
class Piece(InputPartition):
    """Rows ``skip`` to ``skip + rows`` of a file; the first of them has ``offset``."""
    partition: int
    name: str
    skip: int
    rows: int
    offset: int


def pieces(manifests: list[dict], start: dict[str, int], end: dict[str, int]) -> list[Piece]:
    """Parts of files that hold the offsets from ``start`` up to ``end`` of each partition."""
    at: dict[str, int] = {}
    out = []
    for manifest in manifests:
        for partition, name, rows in manifest["files"]:
            key = str(partition)
            first = at.get(key, 0)
            at[key] = first + rows
            low = max(first, start.get(key, 0))
            high = min(first + rows, end.get(key, 0))
            if low < high:
                out.append(Piece(partition, name, low - first, high - low, low))
    return out


def ends(manifests: list[dict]) -> dict[str, int]:
    out: dict[str, int] = {}
    for manifest in manifests:
        for partition, _, rows in manifest["files"]:
            out[str(partition)] = out.get(str(partition), 0) + rows
    return out


def _read(path: str, piece: Piece) -> Iterator[pa.RecordBatch]:
    storage = Storage(path)
    offset, skip, left = piece.offset, piece.skip, piece.rows
    with storage.fs.open_input_file(storage.data(piece.name)) as source:
        for batch in pq.ParquetFile(source).iter_batches(batch_size=ROWS):
            if skip >= batch.num_rows:
                skip -= batch.num_rows
                continue
            batch = batch.slice(skip, left)
            skip = 0
            count = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("value"),
                 pa.array(np.full(count, piece.partition, np.int32)),
                 pa.array(np.arange(offset, offset + count)), batch.column("timestamp")],
                names=["key", "value", "partition", "offset", "timestamp"])
            offset, left = offset + count, left - count
            if not left:
                return


class LogReader(DataSourceReader):
    """The whole log, as of now."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Piece]:
        found = Storage(self.path).manifests()
        return pieces(found, {}, ends(found))

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class LogStreamReader(DataSourceStreamReader):
    """Offset ranges per partition, at most ``maxOffsetsPerTrigger`` rows more per trigger.

    The engine doesn't say where a restarted query stands when it asks how far to go, so the last
    answer is kept in ``consumer``, a small file next to the query's checkpoint. No answer falls
    behind an offset the checkpoint holds; after a restart one batch may be twice as large.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        cap = options.get("maxOffsetsPerTrigger", options.get("maxoffsetspertrigger"))
        self.cap = int(cap) if cap else None
        self.consumer = options.get("consumer")

    def initialOffset(self) -> dict:
        return {}

    def _told(self) -> dict[str, int]:
        fs = Storage(self.consumer).fs
        file = f"{Storage(self.consumer).root}/offsets.json"
        if fs.get_file_info(file).type == pafs.FileType.NotFound:
            return {}
        with fs.open_input_stream(file) as source:
            return json.loads(source.read())

    def _tell(self, offsets: dict[str, int]) -> None:
        storage = Storage(self.consumer)
        storage.fs.create_dir(storage.root)
        waiting = f"{storage.root}/offsets-{uuid.uuid4().hex}.tmp"
        with storage.fs.open_output_stream(waiting) as sink:
            sink.write(json.dumps(offsets).encode())
        storage.fs.move(waiting, f"{storage.root}/offsets.json")

    def latestOffset(self) -> dict:
        end = ends(Storage(self.path).manifests())
        if self.cap is None:
            return end
        goal = self._told()
        room = self.cap
        # partitions take turns, so that none waits for the others
        waiting = {p: n - goal.get(p, 0) for p, n in sorted(end.items()) if n > goal.get(p, 0)}
        while room and waiting:
            share = max(room // len(waiting), 1)
            for p in list(waiting):
                step = min(share, waiting[p], room)
                goal[p] = goal.get(p, 0) + step
                room -= step
                waiting[p] -= step
                if not waiting[p]:
                    del waiting[p]
        self._tell(goal)
        return goal

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(Storage(self.path).manifests(), start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


class MessageLog(DataSource):
    """Options: ``path``; ``batch`` and ``partitions`` to write; ``maxOffsetsPerTrigger`` and
    ``consumer`` to stream."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> LogStreamReader:
        options = dict(self.options)
        if ("maxOffsetsPerTrigger" in options or "maxoffsetspertrigger" in options
                ) and "consumer" not in options:
            raise ValueError("a cap per trigger needs the option consumer")
        return LogStreamReader(options)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(dict(self.options))


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(MessageLog)
    return spark


def append(messages: DataFrame, path: str, batch: str, partitions: int = PARTITIONS) -> None:
    """Add rows (key, value) under the name of a batch; a batch that is in the log is left alone."""
    _registered(messages.sparkSession)
    (messages.select(F.col("key").cast("string").alias("key"),
                     F.col("value").cast("string").alias("value"))
     .write.format(NAME).option("path", path).option("batch", batch)
     .option("partitions", partitions).mode("append").save())


def messages(spark: SparkSession, path: str) -> DataFrame:
    return _registered(spark).read.format(NAME).option("path", path).load()


def message_stream(spark: SparkSession, path: str, consumer: str,
                   max_offsets: int = 50_000) -> DataFrame:
    """Messages from the earliest offset, a bounded number per trigger."""
    return (_registered(spark).readStream.format(NAME).option("path", path)
            .option("consumer", consumer).option("maxOffsetsPerTrigger", max_offsets).load())
