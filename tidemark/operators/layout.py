"""Storage layout: compaction, z-order, partitioned and staged writes."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files below a folder, from the file system's listing; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return listed.select("path", "length")


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def compact(spark: SparkSession, path: str, out: str, target_bytes: int = 128 << 20, skip_above: int | None = None) -> DataFrame:
    """Rewrite a table into ceil(bytes / target) files (at most as many as there are); (files_before, files_after, bytes_before, rows).

    With skip_above nothing is written if files are larger than that on average.
    """
    s = file_stats(spark, path).first()
    df = spark.read.parquet(path)
    n = max(1, min(s["files"], math.ceil(s["bytes"] / target_bytes)))
    if skip_above is None or s["bytes"] <= skip_above * s["files"]:
        df.coalesce(n).write.mode("overwrite").parquet(out)
    else:
        n = s["files"]
    return df.agg(F.lit(s["files"]).alias("files_before"), F.lit(n).alias("files_after"), F.lit(s["bytes"]).alias("bytes_before"), F.count("*").alias("rows"))


def bucketed(c: Column, low: Column, high: Column, bits: int = 10) -> Column:
    """A number scaled to 0 .. 2**bits - 1."""
    top = (1 << bits) - 1
    return F.when(high > low, F.floor((c - low) / (high - low) * top)).otherwise(0).cast("long")


def interleaved(columns: Sequence[Column], bits: int = 10) -> Column:
    """The bits of several numbers in turn, the lowest first: neighbours in every column stay near."""
    key = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(columns):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * len(columns) + k))
    return key


def zorder(df: DataFrame, columns: Sequence[str], bits: int = 10, into: str = "z_key") -> DataFrame:
    """df with a z-order key over numeric columns, scaled between their extremes (one row, broadcast)."""
    ends = df.agg(*[F.min(c).cast("double").alias(f"__lo{k}") for k, c in enumerate(columns)], *[F.max(c).cast("double").alias(f"__hi{k}") for k, c in enumerate(columns)])
    joined = df.join(F.broadcast(ends))
    scaled = [bucketed(F.col(c).cast("double"), F.col(f"__lo{k}"), F.col(f"__hi{k}"), bits) for k, c in enumerate(columns)]
    return joined.withColumn(into, interleaved(scaled, bits)).select(*df.columns, into)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One file a partition value and task, rows of a value together."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


class Store:
    """The file system of a path, through Spark's own Hadoop client."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path(a), self.path(b)):
            raise OSError(f"could not rename {a} to {b}")

    def copy(self, a: str, b: str) -> None:
        if not self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(a), self.fs, self.path(b), False, True, self.conf):
            raise OSError(f"could not copy {a} to {b}")

    def files(self, p: str) -> list[tuple[str, int]]:
        """(path below p, length) of all files, in order of name."""
        if not self.exists(p):
            return []
        base, found, more = self.fs.makeQualified(self.path(p)).toString().rstrip("/"), [], self.fs.listFiles(self.path(p), True)
        while more.hasNext():
            f = more.next()
            found.append((f.getPath().toString()[len(base) + 1 :], f.getLen()))
        return sorted(found)

    def write(self, p: str, data: bytes) -> int:
        """One object, whole or not at all: written beside its name, then renamed over what is there."""
        temporary = f"{p}.writing-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(temporary), True)
        out.write(bytearray(data))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        overwrite = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        overwrite[0] = options.Rename.OVERWRITE
        self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(temporary), self.path(p), overwrite)
        return len(data)

    def create(self, p: str, data: bytes) -> bool:
        """One object, if there is none of that name: written beside it, then renamed without overwriting. Whether it was this one."""
        temporary = f"{p}.writing-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(temporary), True)
        out.write(bytearray(data))
        out.close()
        jvm = self.spark._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if self.fs.getScheme() == "file":  # whose rename looks first and then acts; a link is made or refused in one step
                local = lambda x: jvm.java.io.File(self.path(x).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(p), local(temporary))
                return True
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(temporary), self.path(p), none)
            return True
        except Py4JJavaError:
            if not self.exists(p):
                raise
            return False
        finally:
            self.delete(temporary)

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()


def _pointer(target: str) -> str:
    folder, name = target.rstrip("/").rsplit("/", 1)
    return f"{folder}/_current-{name}.json"


def current_run(spark: SparkSession, target: str) -> str | None:
    """The run that the pointer beside a published table names."""
    store = Store(spark, target)
    return json.loads(store.read(_pointer(target)))["run_id"] if store.exists(_pointer(target)) else None


def recover(spark: SparkSession, target: str) -> bool:
    """Put the last published table back if a run ended between its two renames; whether there was need to."""
    store = Store(spark, target)
    folder, name = target.rstrip("/").rsplit("/", 1)
    old = [s.getPath().toString() for s in store.fs.globStatus(store.path(f"{folder}/_previous-{name}-*")) or []]
    if not old:
        return False
    lost = not store.exists(target)
    if lost:
        store.rename(old[0], target)
    for p in old[1 if lost else 0 :]:
        store.delete(p)
    return lost


def publish(df: DataFrame, target: str, run_id: str, validate: Callable[[DataFrame], object] | None = None) -> None:
    """Write beside the target, validate what was written, then put it in place and name the run in a pointer beside it.

    On any failure the target stays as it was. Two renames are needed; should a run end between them, recover(), with
    which every publication begins, puts the last published table back.
    """
    if not run_id.strip():
        raise ValueError("run_id must not be empty")
    spark = df.sparkSession
    store = Store(spark, target)
    folder, name = target.rstrip("/").rsplit("/", 1)
    staged, old = f"{folder}/_staging-{name}-{run_id}", f"{folder}/_previous-{name}-{run_id}"
    recover(spark, target)
    try:
        df.write.mode("overwrite").parquet(staged)
        written = spark.read.parquet(staged)
        if written.isEmpty():
            raise ValueError("nothing to publish")
        if validate and validate(written) is False:
            raise ValueError("validation said no")
        if store.exists(target):
            store.rename(target, old)
        try:
            store.rename(staged, target)
        except Exception:
            recover(spark, target)
            raise
        store.write(_pointer(target), json.dumps({"run_id": run_id}).encode())
        store.delete(old)
    finally:
        store.delete(staged)


def promote(spark: SparkSession, root: str, run_id: str, prefixes: Sequence[str]) -> dict[str, int]:
    """Put the staged prefixes of a run, below _staging/<run_id>/, in place of the published ones; files a prefix.

    Refused if one of them is empty. What was published is kept below _rollback/<run_id>/ until all are in place, and
    comes back if one fails. For stores that can copy but not rename.
    """
    store = Store(spark, root)
    staging, rollback = f"{root}/_staging/{run_id}", f"{root}/_rollback/{run_id}"
    for p in prefixes:
        if not store.files(f"{staging}/{p}"):
            raise ValueError(f"staged dataset is empty: {p}")

    def put(source: str, p: str) -> None:
        store.delete(f"{root}/{p}")
        if store.exists(f"{source}/{p}"):
            store.copy(f"{source}/{p}", f"{root}/{p}")

    try:
        for p in prefixes:
            if store.exists(f"{root}/{p}"):
                store.copy(f"{root}/{p}", f"{rollback}/{p}")
        try:
            for p in prefixes:
                put(staging, p)
        except Exception:
            for p in prefixes:
                put(rollback, p)
            raise
        return {p: len(store.files(f"{root}/{p}")) for p in prefixes}
    finally:
        store.delete(staging)
        store.delete(rollback)


def clear(spark: SparkSession, path: str) -> int:
    """Delete what is below a path; how many files that were."""
    store = Store(spark, path)
    n = len(store.files(path))
    store.delete(path)
    return n


def write_rows(spark: SparkSession, rows: Sequence[dict], schema: str, path: str) -> int:
    """Write rows held by the driver as one Parquet file; columns that a row lacks are null. Returns their number."""
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1).write.mode("overwrite").parquet(path)
    return len(rows)


def write_sorted(df: DataFrame, columns: Sequence[str], path: str, tasks: int, bits: int = 10) -> None:
    """Write a table in z-order of numeric columns: a range of the key a file, so a file's extremes are narrow in each column."""
    z = "__z"
    ordered = zorder(df, columns, bits, z).repartitionByRange(tasks, z).sortWithinPartitions(z).drop(z)
    ordered.write.mode("overwrite").parquet(path)


def write_indexed(df: DataFrame, keys: Sequence[str], path: str, tasks: int) -> None:
    """Write a table for point lookups: sorted by its keys over files, with Bloom filters of the keys in the footers."""
    writer = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).write.mode("overwrite")
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(path)


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows of both, the newest of each key; updates win ties."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(updates.withColumn("__side", F.lit(1)))
    best = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), F.col("__side").desc())
    return both.withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank", "__side")
