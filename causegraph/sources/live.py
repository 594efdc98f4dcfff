"""Source and sink of live sessions, as Spark data sources.

``session_blobs`` reads files that grow, one for each session, as blobs of one length; ``outbox`` keeps what a stream has
to say.  Both act on executors; the driver sees names and sizes of files only.  What a source gives between two offsets
never changes and the outbox lists each micro-batch once, so after a crash nothing is lost and nothing there twice.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

SECOND = 32_000  # bytes of 16-bit samples at 16 kHz
SLICE = 32 << 20  # bytes that one task reads
AUDIO, END = ".raw", ".end"  # a session's bytes, and the empty file that says that no more come


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path.rstrip("/")


class Slice(InputPartition):
    """Ranges of bytes: (session, from, to, whether the session ends there)."""

    def __init__(self, ranges: list[tuple[str, int, int, bool]]):
        self.ranges = ranges


class SessionBlobs(DataSource):
    """Options: path (a folder), size (bytes of a blob).  Output: session, at (number of the blob), blob, end.

    Bytes that don't fill a blob wait until they do or until the session ends; then a shorter blob comes, and
    after the last one a row without a blob whose ``end`` is true.  An offset holds a number for each file in
    the folder; sessions whose files are removed once they have ended leave it.
    """

    @classmethod
    def name(cls) -> str:
        return "session_blobs"

    def schema(self) -> str:
        return "session string, at long, blob binary, end boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SessionReader(self.options["path"], int(self.options.get("size", SECOND)))


class _SessionReader(DataSourceStreamReader):
    def __init__(self, uri: str, size: int):
        if size < 1:
            raise ValueError("a blob has at least one byte")
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, path = _open(self.uri)
        files = {f.base_name: f.size for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.is_file}
        out = {}
        for name in sorted(files):
            if name.endswith(AUDIO):
                session = name.removesuffix(AUDIO)
                # the marker is written last, but the size may have been listed before it
                ended = session + END in files
                n = fs.get_file_info(f"{path}/{name}").size if ended else files[name]
                out[session] = [n if ended else n // self.size * self.size, ended]
        return out

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        most = max(SLICE // self.size, 1) * self.size
        slices, room = [], 0
        for session, (upto, ended) in end.items():
            at, was_ended = start.get(session, (0, False))
            ends = ended and not was_ended
            while at < upto or ends:
                if room <= 0:
                    slices.append([])
                    room = most
                take = min(upto - at, room)
                last = at + take == upto
                slices[-1].append((session, at, at + take, ends and last))
                at += take
                room -= max(-(-take // self.size), 1) * self.size
                if last:
                    break
        return [Slice(s) for s in slices]

    def read(self, partition: Slice) -> Iterator[tuple]:
        fs, path = _open(self.uri)
        for session, a, b, ends in partition.ranges:
            if a < b:
                with fs.open_input_file(f"{path}/{session}{AUDIO}") as f:
                    for at in range(a, b, self.size):
                        yield session, at // self.size, f.read_at(min(self.size, b - at), at), False
            if ends:
                yield session, -(-b // self.size), None, True


@dataclass
class Part(WriterCommitMessage):
    file: str | None


class Outbox(DataSource):
    """Options: path, stream (a name that stays the same over restarts).  Tasks write Parquet files; a micro-batch counts
    from the moment that its list of files is there, and one that is repeated after a crash is dropped if it has a list."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _OutboxWriter(self.options["path"], self.options["stream"])


class _OutboxWriter(DataSourceStreamArrowWriter):
    def __init__(self, uri: str, stream: str):
        self.uri, self.stream = uri, stream

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, path = _open(self.uri)
        file, writer = None, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if writer is None:
                    file = f"{uuid.uuid4().hex}.parquet"
                    fs.create_dir(f"{path}/parts")
                    writer = pq.ParquetWriter(f"{path}/parts/{file}", batch.schema, filesystem=fs)
                writer.write_batch(batch)
        finally:
            if writer is not None:
                writer.close()
        return Part(file)

    def commit(self, messages: list, batchId: int) -> None:
        fs, path = _open(self.uri)
        listed = f"{path}/commits/{self.stream}-{batchId}.json"
        if fs.get_file_info(listed).type != pafs.FileType.NotFound:
            return self.abort(messages, batchId)
        fs.create_dir(f"{path}/commits")
        draft = f"{path}/commits/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as f:
            for m in messages:
                if m is not None and m.file:
                    f.write((json.dumps({"stream": self.stream, "batch": batchId, "file": m.file}) + "\n").encode())
        fs.move(draft, listed)

    def abort(self, messages: list, batchId: int) -> None:
        fs, path = _open(self.uri)
        for m in messages:
            if m is not None and m.file:
                fs.delete_file(f"{path}/parts/{m.file}")


def session_blobs(spark: SparkSession, folder: str, size: int = SECOND) -> DataFrame:
    """The folder's sessions as a stream, see :class:`SessionBlobs`."""
    spark.dataSource.register(SessionBlobs)
    return spark.readStream.format("session_blobs").option("path", folder).option("size", size).load()


def deliver(df: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream into an outbox; its name there is made from the checkpoint's, so that both go on together."""
    df.sparkSession.dataSource.register(Outbox)
    name = hashlib.md5(checkpoint.encode()).hexdigest()
    writer = df.writeStream.format("outbox").option("path", path).option("stream", name).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def delivered(spark: SparkSession, path: str, schema) -> DataFrame:
    """What an outbox holds, with ``batch``; files that no micro-batch lists are passed over."""
    from causegraph.sources.readers import exists

    if not exists(spark, f"{path}/commits") or not exists(spark, f"{path}/parts"):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    listed = spark.read.schema("batch long, file string").json(f"{path}/commits").withColumnRenamed("file", "_file")
    rows = spark.read.schema(schema).parquet(f"{path}/parts").withColumn("_file", F.col("_metadata.file_name"))
    return rows.join(listed, "_file").drop("_file")


def record_sessions(df: DataFrame, key: str, order: str, blob: str, folder: str) -> None:
    """Writes each session's blobs, in their order, as one file of the folder, and then the file that ends it.

    A task that is repeated writes the same bytes again, first under a name that no reader looks at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = _open(folder)
        fs.create_dir(path)
        session, out, draft = None, None, None

        def close() -> None:
            if out is not None:
                out.close()
                fs.move(draft, f"{path}/{session}{AUDIO}")
                with fs.open_output_stream(f"{path}/{session}{END}"):
                    pass

        for pdf in batches:
            for k, b in zip(pdf[key], pdf[blob]):
                if k != session:
                    close()
                    session, draft = k, f"{path}/_{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft)
                out.write(bytes(b or b""))
            yield pdf[[key]].head(0)
        close()

    narrow = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), order, blob)
    narrow.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"`{key}` string").write.format("noop").mode("overwrite").save()
