"""Helpers that the operators of this subpackage share: checkpoints, tables in the shared folder, text expressions."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space (space, \t to \r), as bytes.split() takes them.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, else an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def small_batches(spark: SparkSession, limit: str = "8m") -> Iterator[None]:
    """Within, Spark hands Python workers Arrow batches of at most about `limit`, so their memory does not depend on the length of rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df: computed once, lineage cut, files in the shared folder."""
    shared_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame that cut() made, once nothing that is still to be worked out reads them."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        delete(df.sparkSession, file.get())


class Table:
    """A DataFrame written once as Parquet in the shared folder, in folders by some columns if need be; drop() deletes the files."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            df.write.option("compression", codec).partitionBy(by or []).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Texts of ASCII only take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fixed(c: Column) -> Column:
    """c, as an expression that filters are not pushed below. There each use of an array would work it out anew, for every element."""
    return F.when(F.spark_partition_id() >= 0, c)


def unused(df: DataFrame, name: str) -> str:
    """name, with as many _ behind it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if one row in so many has it; so there are at most as many hot keys.
HOT = 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """left joined with right on left[key] == right["on"], which is unique in right; no task gets a hot key's rows.

    counts: (on, n), how many of left's `total` rows have a key. The rows of right for hot keys, at most HOT, are broadcast;
    all other keys are joined as Spark sees fit. left is read twice. Null keys meet nothing.
    """
    hot = F.broadcast(counts.filter(F.col("n") >= max(total / HOT, 2)).select(F.col("on").alias("hot")))
    some = F.broadcast(right.join(hot, F.col("on") == F.col("hot"), "left_semi"))
    first = left.join(hot, F.col(key) == F.col("hot"), "left_semi").join(some, F.col(key) == F.col("on"), how)
    rest = left.join(hot, F.col(key) == F.col("hot"), "left_anti").join(right, F.col(key) == F.col("on"), how)
    return first.unionByName(rest).drop("on")


def give_back() -> None:
    """Hand what this process's allocators hold but do not use to the system: Arrow's pool, and the C library's where that is glibc."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with free memory given back as each task ends: workers are used again, and idle ones would keep the most they ever had."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def worker_cache(key: str, make):
    """What make() returned for this key in this Python process; functions pickled by value have no other memory between tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("tidemark_worker_cache", types.ModuleType("tidemark_worker_cache"))
    if key not in kept.__dict__:
        setattr(kept, key, make())
    return kept.__dict__[key]
