"""Line dedup over batches: levelled sorted runs of line hashes, merge-anti-joined by each new batch.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased; keys of fewer than `least` code
points are left alone. LineRuns holds what batches had, as runs of (hash, documents with it, largest id): tables bucketed
and sorted by hash, so that a new batch meets each run by merging, without a shuffle of the run. A batch writes its own
run, anti-joins it with the runs there are, which leaves the keys it is first to have, and anti-joins its lines with those
keys' first places, which leaves its repeats. Then its run joins level 0; `fanout` runs of a level are merged into one of
the next, so of B batches there are about fanout * log(B) runs, and a hash is rewritten log(B) times.

drop_lines() deals a table into batches by falling id, so a line's first place is in the largest id that holds it. After
the last batch, repeats are dropped whose key has `documents` or more documents in all runs. Lines of one key that hold a
third of all rows are combined before they are shuffled, joined by key and id, and meet their totals as one of at most a
thousand broadcast keys.

Null or empty text is one empty line, which no key is taken of. Rows that share an id are one document, all of whose lines
share their fate; null ids are one document, below all others. Equal rows give equal rows. An empty table gives an empty
result. Hashes have 128 bits. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import Table, delete, shared_dir, spread_join
from tidemark.operators.layout import Store

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
KEY = ["h", "g"]


def line_hash(line: bytes, least: int) -> bytes | None:
    """16 bytes for a line's key, None for a key of fewer than `least` code points."""
    from xxhash import xxh3_128_digest

    key = line.strip()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least:
        return None
    return xxh3_128_digest(key.translate(_LOWER))


def hashed(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """(doc_id, h, g): the distinct keys of each row's lines as two longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = [{line_hash(x, least) for x in (t.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")} - {None} for t in batch.column(1)]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            pairs = np.frombuffer(b"".join(x for f in found for x in f), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *[pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)]], ["doc_id", *KEY])

    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, h long, g long")


class LineRuns:
    """The runs of the batches so far, in a folder below the shared one; runs.json there names those that count.

    A batch that ends before runs.json names its run leaves nothing behind that counts and can be added again; one whose
    name is there already is refused. A document must lie in one batch as a whole.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4):
        self.spark, self.fanout = spark, fanout
        self.path = (path or f"{shared_dir(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}").rstrip("/")
        self.store = Store(spark, self.path)
        known = json.loads(self.store.read(self._file)) if self.store.exists(self._file) else {}
        self.levels: list[list[str]] = known.get("levels", [])
        self.batches: list[str] = known.get("batches", [])
        self.buckets: int = known.get("buckets", int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.kind: str | None = known.get("kind")

    @property
    def _file(self) -> str:
        return f"{self.path}/runs.json"

    def _write(self, keys: DataFrame) -> str:
        """A run: one file a bucket, sorted by hash."""
        name = f"tidemark_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another application
            self.spark.sql(f"create table {name} (h bigint, g bigint, n bigint, top {self.kind}) using parquet clustered by (h, g) sorted by (h, g) into {self.buckets} buckets location '{self.path}/{name}'")
        return self.spark.table(name)

    def _commit(self, levels: list[list[str]], batches: list[str]) -> None:
        """Name the runs that count; those that counted before and do not now are deleted."""
        gone = {r for level in self.levels for r in level} - {r for level in levels for r in level}
        self.store.write(self._file, json.dumps({"levels": levels, "batches": batches, "buckets": self.buckets, "kind": self.kind}).encode())
        self.levels, self.batches = levels, batches
        for name in gone:
            self._forget(name)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, f"{self.path}/{name}")

    def runs(self) -> list[DataFrame]:
        return [self._read(name) for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has: one merge anti-join a run."""
        for run in self.runs():
            keys = keys.join(run.select(*KEY), KEY, "left_anti")
        return keys

    def add(self, lines: DataFrame, batch: str) -> Table:
        """Add a batch's distinct (doc_id, h, g). Returns its repeats: the lines not in the first place that has their key.

        That place is the largest id with it in the first batch that had it.
        """
        if batch in self.batches:
            raise ValueError(f"the runs have batch {batch}")
        self.kind = lines.schema["doc_id"].dataType.simpleString()
        own = self._write(lines.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")))
        try:
            first = self.unseen(self._read(own)).select(F.col("h").alias("fh"), F.col("g").alias("fg"), "top")
            place = (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")) & F.col("doc_id").eqNullSafe(F.col("top"))
            repeats = Table(lines.join(first, place, "left_anti").select("doc_id", *KEY), "line-repeats")
            levels = [list(level) for level in self.levels] or [[]]
            levels[0].append(own)
            self._commit(levels, [*self.batches, batch])
        except Exception:
            self._forget(own)
            raise
        self.compact()
        return repeats

    def compact(self) -> None:
        """Merge the runs of each level that is full into one of the next."""
        for k in range(99):
            if k >= len(self.levels) or len(self.levels[k]) < self.fanout:
                continue
            merged = self._write(self._merged(self.levels[k]))
            levels = [list(level) for level in self.levels] + [[]] * (k + 1 == len(self.levels))
            levels[k], levels[k + 1] = [], [*levels[k + 1], merged]
            self._commit(levels, self.batches)

    def _merged(self, names: list[str]) -> DataFrame:
        """Several runs as one. They are read as files, not as bucketed tables: Spark 4.1 takes a union of those for dealt out by
        the key when it is not, and a key then has several rows."""
        files = self.spark.read.schema(f"h long, g long, n long, top {self.kind}").parquet(*[f"{self.path}/{name}" for name in names])
        return files.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("top").alias("top"))

    def totals(self) -> DataFrame:
        """(h, g, n, top) of every key."""
        return self._merged([name for level in self.levels for name in level])

    def drop(self) -> None:
        for level in self.levels:
            for name in level:
                self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, self.path)


def drop_lines(
    df: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3, batches: int = 6, fanout: int = 4
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of each row; ids are numbers.

    Keys that `documents` or more have lose all their lines but those of the largest id. The table is dealt into
    `batches` ranges of ids, the largest first, as deliveries would come.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("q")).first()["q"] or [])) if batches > 1 else []
    later = sum((F.when(F.col("doc_id") > c, 0).otherwise(1) for c in cuts), F.lit(0))
    lines = Table(hashed(rows, "doc_id", "text", least).distinct().withColumn("batch", later), "lines", by=["batch"])
    runs = LineRuns(spark, fanout=fanout)
    repeats = [runs.add(lines.read().filter(F.col("batch") == k).drop("batch"), str(k)) for k in range(len(cuts) + 1)]
    lines.drop()
    gone = Table(_gone(runs, [r.read() for r in repeats], documents), "lines-gone")
    for done in (runs, *repeats):
        done.drop()
    return _rebuilt(rows, gone.read(), least)


def _gone(runs: LineRuns, repeats: list[DataFrame], documents: int) -> DataFrame:
    """(gone_id, gone): the hashes of the lines that each document loses."""
    every = repeats[0]
    for some in repeats[1:]:
        every = every.unionByName(some)
    totals = runs.totals().filter(F.col("n") >= documents).select(F.struct(*KEY).alias("on"), "n")
    kept = Table(totals, "line-totals")
    total = kept.read().agg(F.sum("n")).first()[0] or 0
    met = spread_join(every.withColumn("key", F.struct(*KEY)), kept.read().select("on"), "key", kept.read(), total)
    return met.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_list("key").alias("gone"))


def _rebuilt(rows: DataFrame, gone: DataFrame, least: int) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) from the rows and what their ids lose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for t, g in zip(batch.column(1), batch.column(2), strict=True):
                lines = (t.as_py() or "").split("\n")
                n_lines.append(len(lines))
                if g.is_valid:
                    lost = {x["h"].to_bytes(8, "little", signed=True) + x["g"].to_bytes(8, "little", signed=True) for x in g.as_py()}
                    lines = [x for x in lines if line_hash(x.encode("utf-8", "surrogatepass"), least) not in lost]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append("\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").select("doc_id", "text", "gone")
    return met.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept string")
