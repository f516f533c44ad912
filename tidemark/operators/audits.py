"""Audits and orchestration helpers: event contracts, state transitions, claims, time splits, manifests, table contracts in Markdown."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def valid_event(fields: Mapping[str, str], json: Column) -> Column:
    """Whether JSON text has every field, each of its type (bigint, double, timestamp or string); false for anything else."""
    out = F.lit(True)
    for name, kind in fields.items():
        raw = F.get_json_object(json, f"$.{name}")
        out = out & F.coalesce((F.trim(raw) != "") if kind == "string" else raw.try_cast(kind).isNotNull(), F.lit(False))
    return out


def bad_transitions(df: DataFrame, key: str, order: str, state: str, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, order, before, state) of steps that the rules do not allow."""
    steps = df.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(order))).filter("before is not null")
    rules = df.sparkSession.createDataFrame(list(allowed), "a string, b string")
    return steps.join(rules, (F.col("before") == F.col("a")) & (F.col(state) == F.col("b")), "left_anti").select(key, order, "before", state)


def fenced(writes: DataFrame, key: str, request: str, token: str, order: str) -> DataFrame:
    """Adds `outcome` to writes in their order: replayed if the request was made before, fenced off if a larger token was seen
    for the key, else accepted."""
    by_request = Window.partitionBy(key, request).orderBy(order)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = writes.withColumn("__nth", F.row_number().over(by_request)).withColumn("__top", F.max(token).over(before))
    outcome = F.when(F.col("__nth") > 1, "replayed").when(F.col(token) < F.col("__top"), "fenced off").otherwise("accepted")
    return seen.withColumn("outcome", outcome).drop("__nth", "__top")


def claimable(attempts: Column, lease_until: Column, now: Column, most: int = 5) -> Column:
    """Whether an outbox entry may be claimed: attempts are left and no lease runs."""
    return (attempts < most) & (lease_until.isNull() | (lease_until <= now))


def time_split(df: DataFrame, ts: str, boundaries: Sequence[str]) -> DataFrame:
    """Adds `part`: 0 before the first boundary, 1 before the second, and so on. A row is in one part; a later part never holds an earlier time."""
    part = F.lit(0)
    for k, b in enumerate(boundaries, 1):
        part = F.when(F.col(ts) >= F.lit(b).cast(df.schema[ts].dataType), k).otherwise(part)
    return df.withColumn("part", part)


def required_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset_name, row_count, ok) of each table; an empty one is not ok."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("dataset_name"), F.count("*").alias("row_count")).withColumn("ok", F.col("row_count") > 0)
        out = one if out is None else out.unionByName(one)
    return out


def pit_audit(df: DataFrame, feature_ts: str, reference_ts: str, created_ts: str) -> DataFrame:
    """(row_count, missing_created, leaks, ok) of a feature table."""
    a = df.agg(F.count("*").alias("row_count"), F.count_if(F.col(created_ts).isNull()).alias("missing_created"), F.count_if(F.col(feature_ts) > F.col(reference_ts)).alias("leaks"))
    return a.withColumn("ok", (F.col("row_count") > 0) & (F.col("missing_created") == 0) & (F.col("leaks") == 0))


def run_id(pipeline: str, logical_date: str) -> str:
    """The same id for the same pipeline and date."""
    return f"{pipeline}-{hashlib.sha256(f'{pipeline}|{logical_date}'.encode()).hexdigest()[:12]}"


def content_id(fields: Sequence[str]) -> Column:
    """The SHA-256 of the fields as JSON, in order of name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, sha256) of the files below a path, read where they lie."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, problem): listed files that are missing, changed, listed twice or named by an unsafe path, and files that are not listed."""
    twice = manifest.groupBy("name").count().filter("count > 1").select("name", F.lit("listed twice").alias("problem"))
    unsafe = manifest.filter(F.startswith("name", F.lit("/")) | F.arrays_overlap(F.split("name", "[/\\\\]"), F.array(F.lit("..")))).select("name", F.lit("unsafe path").alias("problem")).distinct()
    m = manifest.select("name", F.col("length").alias("m_length"), F.col("sha256").alias("m_sha256")).distinct().join(unsafe.select("name"), "name", "left_anti")
    both = files.join(m, "name", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("m_sha256").isNull(), "not listed").when((F.col("sha256") != F.col("m_sha256")) | (F.col("length") != F.col("m_length")), "changed")
    return both.select("name", problem.alias("problem")).filter("problem is not null").unionByName(twice).unionByName(unsafe)


def flushed(df: DataFrame, consumer: str, order: str, elapsed: str, size: int, seconds: int) -> DataFrame:
    """Adds `flush`, the number of the flush that each row leaves its consumer's buffer with.

    A consumer takes its rows in order and flushes once it holds `size` rows or the elapsed seconds of those it holds
    add up to `seconds`. That is one pass by its nature, so each consumer's rows are streamed through one task, batch by
    batch, with two numbers as state; consumers are independent.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waited, flush = None, 0, 0, 0
        for batch in batches:
            out = []
            for who, wait in zip(batch.column(columns.index(consumer)).to_pylist(), batch.column(columns.index(elapsed)).to_pylist(), strict=True):
                if who != now:
                    now, held, waited, flush = who, 0, 0, 0
                held, waited = held + 1, waited + (wait or 0)
                out.append(flush)
                if held >= size or waited >= seconds:
                    held, waited, flush = 0, 0, flush + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*columns, "flush"])

    lined = df.repartition(consumer).sortWithinPartitions(consumer, order)
    return lined.mapInArrow(run, df.withColumn("flush", F.lit(0).cast("long")).schema)


def merged_averages(df: DataFrame, keys: Sequence[str], price: str, volume: str, parts: int = 8) -> DataFrame:
    """Average price (6 places) and volume from accumulators (count, sum, sum) of parts of each key, merged: what a window does over its panes."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
    pane = df.groupBy(*keys, part.alias("pane")).agg(F.count("*").alias("n"), F.sum(price).alias("p"), F.sum(volume).alias("v"))
    whole = pane.groupBy(*keys).agg(F.sum("n").alias("event_count"), F.sum("p").alias("p"), F.sum("v").alias("total_volume"))
    return whole.select(*keys, "event_count", F.round(F.col("p").cast("double") / F.col("event_count"), 6).alias("average_price"), "total_volume")


@dataclass(frozen=True)
class TableContract:
    """A table as a Markdown contract describes it; columns: (name, type, nullable)."""

    name: str
    keys: tuple[str, ...]
    partitions: tuple[str, ...]
    upstream: tuple[str, ...]
    downstream: tuple[str, ...]
    rows: tuple[int | None, int | None]
    columns: tuple[tuple[str, str, bool], ...]


def markdown_tables(text: str) -> dict[str, list[list[dict[str, str]]]]:
    """Tables below the headings of a Markdown text: heading -> tables -> rows by column name in lower case."""
    out: dict[str, list[list[dict[str, str]]]] = {}
    heading, head = "", None
    for line in text.splitlines():
        if m := re.match(r"#+\s+(.*)", line):
            heading, head = m[1].strip().strip("`"), None
        elif line.strip().startswith("|"):
            cells = [c.strip().strip("`") for c in line.strip().strip("|").split("|")]
            if head is None:
                head = [c.lower() for c in cells]
                out.setdefault(heading, []).append([])
            elif not all(re.fullmatch(r":?-+:?", c) for c in cells):
                out[heading][-1].append(dict(zip(head, cells, strict=False)))
        else:
            head = None
    return out


def _names(cell: str) -> tuple[str, ...]:
    return tuple(x.strip().strip("`") for x in cell.split(",") if x.strip().strip("`").lower() not in ("", "none"))


def parse_contracts(text: str) -> dict[str, TableContract]:
    """Contracts by table: the headings with a table of columns (column, dtype, nullable) and one of fields (field, value)."""
    out = {}
    for heading, found in markdown_tables(text).items():
        fields = {r["field"].lower(): r["value"] for t in found for r in t if "field" in r and "value" in r}
        columns = tuple((r["column"], r["dtype"].upper(), r["nullable"].lower() in ("yes", "true", "nullable")) for t in found for r in t if "dtype" in r)
        if columns:
            bounds = [int(x.replace(",", "")) for x in re.findall(r"\d[\d,]*", fields.get("expected row count", ""))]
            rows = (bounds[0] if bounds else None, bounds[1] if len(bounds) > 1 else None)
            out[heading] = TableContract(heading, _names(fields.get("primary keys", "")), _names(fields.get("partition columns", "")), _names(fields.get("upstream tables", "")), _names(fields.get("downstream consumers", "")), rows, columns)
    return out


def parse_lineage(text: str) -> list[tuple[str, str, str]]:
    """(dataset, upstream, downstream) of the tables below a heading that starts with Lineage; one row a pair, "" for none."""
    out = []
    for heading, found in markdown_tables(text).items():
        if heading.lower().startswith("lineage"):
            for r in (r for t in found for r in t):
                out += [(r["dataset"], up, down) for up in _names(r["upstream"]) or ("",) for down in _names(r["downstream"]) or ("",)]
    return out


def check_contract(df: DataFrame, contract: TableContract) -> list[tuple[str, str, str]]:
    """(table, column, problem): columns that are missing, extra or of another type, and keys that are no column."""
    kinds = {"VARCHAR": "string", "TEXT": "string", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "DOUBLE": "double", "FLOAT": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp"}
    have = dict(df.dtypes)
    named = {n for n, _, _ in contract.columns}
    out = [(contract.name, n, "missing") for n, _, _ in contract.columns if n not in have]
    out += [(contract.name, n, "type") for n, t, _ in contract.columns if n in have and have[n].removesuffix("_ntz") != kinds.get(t, t.lower())]
    out += [(contract.name, n, "extra") for n in have if n not in named]
    out += [(contract.name, n, "key without column") for n in contract.keys if n not in named]
    return sorted(out)


def lineage_problems(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(dataset, name, problem) of edges (dataset, upstream, downstream) against the datasets that have a contract (name):
    datasets without one, without an upstream, and neighbours that do not name the dataset on their own side."""
    e = edges.select("dataset", "upstream", "downstream")
    unknown = e.select("dataset").distinct().join(known, F.col("dataset") == F.col("name"), "left_anti").select("dataset", F.lit("").alias("name"), F.lit("no contract").alias("problem"))
    orphan = e.groupBy("dataset").agg(F.max("upstream").alias("u")).filter("u = ''").select("dataset", F.lit("").alias("name"), F.lit("no upstream").alias("problem"))
    told = e.filter("downstream <> ''").select(F.col("downstream").alias("d"), F.col("dataset").alias("u")).distinct()
    heard = e.filter("upstream <> ''").select("dataset", "upstream").distinct()
    both = told.join(e.select(F.col("dataset").alias("d")).distinct(), "d", "left_semi")
    one_sided = both.join(heard, (F.col("d") == F.col("dataset")) & (F.col("u") == F.col("upstream")), "left_anti").select(F.col("d").alias("dataset"), F.col("u").alias("name"), F.lit("upstream not named").alias("problem"))
    return unknown.unionByName(orphan).unionByName(one_sided)


def evidence(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset_name, row_count, digest): what a run leaves as evidence of its tables."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("dataset_name"), F.count("*").alias("row_count"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


def audit_evidence(claimed: DataFrame, found: DataFrame, required: Sequence[str]) -> DataFrame:
    """(dataset_name, status): ok, missing evidence, no such table, row count differs or content differs."""
    need = claimed.sparkSession.createDataFrame([(r,) for r in required], "dataset_name string")
    c = claimed.select("dataset_name", F.col("row_count").alias("c_rows"), F.col("digest").alias("c_digest"))
    both = need.join(c, "dataset_name", "full").join(found, "dataset_name", "left")
    status = F.when(F.col("c_rows").isNull(), "missing evidence").when(F.col("row_count").isNull(), "no such table").when(F.col("c_rows") != F.col("row_count"), "row count differs").when(F.col("c_digest") != F.col("digest"), "content differs")
    return both.select("dataset_name", F.coalesce(status, F.lit("ok")).alias("status"))
