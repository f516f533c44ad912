"""An append-only log with offsets on shared storage, as a batch and a streaming source of Spark's Python Data Source API.

A topic is a folder; a partition of it a folder of segments, Parquet files whose names give their first offset and number
of rows: <topic>/partition=<p>/<first>-<rows>.parquet. A row's offset is its place. append() writes by Spark: rows go to a
partition by the hash of their key and keep a given order within it; segments are written beside the log and named one
by one, so readers see whole segments only, and offsets have no gap.

The source "tidemark_log" gives (partition, offset, key, value, timestamp). Its options: path, a topic's folder;
startingOffsets and endingOffsets, "earliest", "latest" or JSON of partition to offset (the end is exclusive); and
for streams maxOffsetsPerTrigger, at most so many rows a batch, dealt out over partitions by what each has left, and
group, under whose name a stream commits what it has done to <topic>/_groups/<group>.json. A batch goes by the offsets of
its query's checkpoint; the commit tells others how far the group is, at most a batch behind, as Spark commits a batch when it
plans the next, and a new query with startingOffsets "group" begins there: without a gap, and maybe with that batch again. Each task reads one segment's rows of a range. Readers use pyarrow's file systems, so the folder may lie in any
store that these know.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.operators.layout import Store

register_pickle_by_value(sys.modules[__name__])
SCHEMA = "partition int, offset long, key string, value string, timestamp timestamp"


def segments(names: Sequence[str]) -> dict[int, list[tuple[int, int, str]]]:
    """partition -> its segments (first offset, rows, name) in order, from paths below a topic."""
    found: dict[int, list[tuple[int, int, str]]] = {}
    for name in names:
        folder, _, file = name.rpartition("/")
        if folder.startswith("partition=") and file.endswith(".parquet"):
            first, rows = file[: -len(".parquet")].split("-")
            found.setdefault(int(folder[len("partition=") :]), []).append((int(first), int(rows), name))
    for own in found.values():
        own.sort()
    return found


def _place(name: str) -> tuple[str, list[int]]:
    """What puts staged files in order: folder, number of the task, number of its file."""
    folder, _, file = name.rpartition("/")
    return folder, [int(x) for x in re.match(r"part-(\d+)-.*?(?:\.c(\d+))?\.", file).groups("0")]


def append(df: DataFrame, path: str, partitions: int, order: Sequence[str | Column], segment_rows: int = 1_000_000, task_rows: int = 250_000) -> dict[int, int]:
    """Append rows (key, value, timestamp) to a topic; the next offset of each partition that there is. One appender a topic at a time.

    Rows of a key keep `order`. A segment holds at most segment_rows. A task sorts and writes a range of partition and order of
    about task_rows, so its memory does not grow with what is appended.
    """
    spark = df.sparkSession
    store, staged = Store(spark, path), f"{path.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    numbered = df.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    try:
        tasks = max(1, -(-df.count() // task_rows))
        lined = numbered.repartitionByRange(tasks, "partition", *order).sortWithinPartitions("partition", *order).select("key", "value", "timestamp", "partition")
        lined.write.option("maxRecordsPerFile", segment_rows).partitionBy("partition").parquet(staged)
        names = sorted((n for n, _ in store.files(staged) if n.endswith(".parquet")), key=_place)
        ends = {p: own[-1][0] + own[-1][1] for p, own in segments([n for n, _ in store.files(path)]).items()}
        if not names:
            return ends
        # one row a file
        rows = {"/".join(r.file.split("/")[-2:]): r.n for r in spark.read.parquet(staged).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).collect()}
        for name in names:
            folder = name.split("/")[0]
            p = int(folder[len("partition=") :])
            first = ends.get(p, 0)
            store.fs.mkdirs(store.path(f"{path}/{folder}"))
            store.rename(f"{staged}/{name}", f"{path}/{folder}/{first:020d}-{rows[name]}.parquet")
            ends[p] = first + rows[name]
        return ends
    finally:
        store.delete(staged)


@dataclass
class Range(InputPartition):
    """Rows skip to skip + take of a segment whose first offset is `first`."""

    partition: int
    name: str
    first: int
    skip: int
    take: int


class _Files:
    """A topic's folder through pyarrow."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.root = self.root.rstrip("/")
        self.selector = fs.FileSelector

    def segments(self) -> dict[int, list[tuple[int, int, str]]]:
        found = self.fs.get_file_info(self.selector(self.root, recursive=True, allow_not_found=True))
        return segments([f.path[len(self.root) + 1 :] for f in found if "/_" not in f.path[len(self.root) :]])

    def committed(self, group: str) -> dict[str, int]:
        try:
            with self.fs.open_input_stream(f"{self.root}/_groups/{group}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}

    def commit(self, group: str, offsets: dict[str, int]) -> None:
        """Written beside its name and moved there, so that a reader sees one commit or the other."""
        beside = f"{self.root}/_groups/.{group}-{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/_groups", recursive=True)
        with self.fs.open_output_stream(beside) as f:
            f.write(json.dumps(offsets).encode())
        self.fs.move(beside, f"{self.root}/_groups/{group}.json")

    def ends(self) -> dict[str, int]:
        return {str(p): own[-1][0] + own[-1][1] for p, own in self.segments().items()}

    def at(self, where: str, group: str | None = None) -> dict[str, int]:
        """The offsets that an option names, for every partition there is."""
        ends = self.ends()
        if where == "latest":
            return ends
        if where == "earliest":
            return dict.fromkeys(ends, 0)
        if where == "group":
            if not group:
                raise ValueError("startingOffsets group needs a group")
            return dict.fromkeys(ends, 0) | self.committed(group)
        return dict.fromkeys(ends, 0) | json.loads(where)

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        """What to read for start (inclusive) to end (exclusive); an error if the log does not hold all of it."""
        held, out = self.segments(), []
        for p, stop in sorted(end.items(), key=lambda x: int(x[0])):
            at = begin = start.get(p, 0)
            for first, rows, name in held.get(int(p), []):
                if first <= at < first + rows and at < stop:
                    take = min(first + rows, stop) - at
                    out.append(Range(int(p), name, first, at - first, take))
                    at += take
            if at < stop:
                raise ValueError(f"partition {p} has offsets {begin} to {at}, not to {stop}")
        return out

    def read(self, part: Range | None) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        if part is None:  # what Spark asks for where there is nothing to read
            return
        at = 0
        with self.fs.open_input_file(f"{self.root}/{part.name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(columns=["key", "value", "timestamp"]):
                some = batch.slice(max(part.skip - at, 0), max(min(part.skip + part.take - max(at, part.skip), batch.num_rows), 0)) if at + batch.num_rows > part.skip else batch.slice(0, 0)
                first = part.first + max(at, part.skip)
                at += batch.num_rows
                if some.num_rows:
                    own = [pa.array([part.partition] * some.num_rows, pa.int32()), pa.array(np.arange(first, first + some.num_rows))]
                    at_us = some.column(2).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([*own, some.column(0), some.column(1), at_us], ["partition", "offset", "key", "value", "timestamp"])
                if at >= part.skip + part.take:
                    return


class Bounded(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        files, o = _Files(self.options["path"]), self.options
        return files.ranges(files.at(o.get("startingoffsets", "earliest"), o.get("group")), files.at(o.get("endingoffsets", "latest")))

    def read(self, partition: InputPartition) -> Iterator:
        return _Files(self.options["path"]).read(partition)


class Continuous(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.most = int(options.get("maxoffsetspertrigger", 0))
        self.group = options.get("group")
        if self.most and not self.group:
            raise ValueError("maxOffsetsPerTrigger needs a group, whose plans say where a query that starts again stands")
        self.last: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        files = _Files(self.options["path"])
        self.last = files.at(self.options.get("startingoffsets", "earliest"), self.group)
        if self.group:
            files.commit(f"{self.group}.planned", self.last)
        return self.last

    def latestOffset(self) -> dict:
        files = _Files(self.options["path"])
        ends = files.ends()
        if not self.most:
            return ends
        if self.last is None:  # a query that starts again: what it planned last is done or comes first
            self.last = files.committed(f"{self.group}.planned")
        left = {p: max(end - self.last.get(p, 0), 0) for p, end in ends.items()}
        total, to = sum(left.values()), {}
        if total <= self.most:
            return ends
        for p in sorted(left, key=int):
            to[p] = min(left[p], -(-left[p] * self.most // total))
        over = sum(to.values()) - self.most
        for p in sorted(to, key=int, reverse=True):
            less = min(over, max(to[p] - 1, 0))
            to[p], over = to[p] - less, over - less
        return {p: self.last.get(p, 0) + n for p, n in to.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files, self.last = _Files(self.options["path"]), dict(end)
        if self.group:
            files.commit(f"{self.group}.planned", self.last)
        return files.ranges(start, end)

    def commit(self, end: dict) -> None:
        if self.group:
            _Files(self.options["path"]).commit(self.group, dict(end))

    def read(self, partition: InputPartition) -> Iterator:
        return _Files(self.options["path"]).read(partition)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Bounded(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Continuous(dict(self.options))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of a range of offsets."""
    spark.dataSource.register(LogSource)
    return spark.read.format("tidemark_log").options(path=path, **options).load()


def stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The log as a stream; run it with a trigger of its own and stop it when processAllAvailable() is through, or let it go on."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("tidemark_log").options(path=path, **options).load()
