"""Data-quality checks: each is one row (dataset_name, check_name, status, severity, metric_value, threshold_value)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.layout import Store


class CriticalFailure(Exception):
    """A critical check failed."""


def _row(df: DataFrame, dataset: str, check: str, metric: Column, bad: Column, severity: str, threshold: Column | float | None) -> DataFrame:
    one = df.select(metric.cast("double").alias("metric_value"))
    status = F.when(F.coalesce(bad, F.lit(True)), F.lit("fail" if severity == "critical" else "warning")).otherwise("pass")
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return one.select(F.lit(dataset).alias("dataset_name"), F.lit(check).alias("check_name"), status.alias("status"), F.lit(severity).alias("severity"), "metric_value", limit.cast("double").alias("threshold_value"))


def _count(df: DataFrame, dataset: str, check: str, metric: Column, severity: str = "critical") -> DataFrame:
    return _row(df, dataset, check, metric, F.col("metric_value") > 0, severity, 0.0)


def not_null(df: DataFrame, dataset: str, column: str) -> DataFrame:
    return _count(df.agg(F.count_if(F.col(column).isNull()).alias("n")), dataset, f"not_null:{column}", F.col("n"))


def unique(df: DataFrame, dataset: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key; null equals null."""
    extra = df.groupBy(*keys).agg((F.count("*") - 1).alias("extra")).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n"))
    return _count(extra, dataset, f"unique:{','.join(keys)}", F.col("n"))


def referential(df: DataFrame, dataset: str, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Rows whose key is null or not in the dimension."""
    orphans = df.join(dimension.select(F.col(key).alias("__key")).distinct(), F.col(column) == F.col("__key"), "left_anti")
    return _count(orphans.agg(F.count("*").alias("n")), dataset, f"referential:{column}", F.col("n"))


def between(df: DataFrame, dataset: str, column: str, low: float, high: float) -> DataFrame:
    outside = F.count_if(F.coalesce(~F.col(column).between(low, high), F.lit(False)))
    return _count(df.agg(outside.alias("n")), dataset, f"range:{column}", F.col("n"))


def retention(after: DataFrame, before: DataFrame, dataset: str, least: float = 0.8) -> DataFrame:
    """Share of rows that a step kept; of nothing, 0."""
    a = after.agg(F.count("*").alias("a")).join(before.agg(F.count("*").alias("b")))
    share = F.when(F.col("b") == 0, F.lit(0.0)).otherwise(F.col("a") / F.col("b"))
    return _row(a, dataset, "retention", share, F.col("metric_value") < least, "warning", least)


def volume_change(now: DataFrame, before: DataFrame, dataset: str, most: float = 0.5) -> DataFrame:
    """How far the number of rows moved, as a share of the number before."""
    a = now.agg(F.count("*").alias("a")).join(before.agg(F.count("*").alias("b")))
    return _row(a, dataset, "volume_change", F.when(F.col("b") > 0, F.abs(F.col("a") - F.col("b")) / F.col("b")), F.col("metric_value") > most, "warning", most)


def freshness(df: DataFrame, dataset: str, ts: str, now: Column, most_minutes: float) -> DataFrame:
    """Minutes since the newest row. In the future: a critical failure, against a threshold of 0; no time at all or too old: a warning."""
    lag = df.agg(((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max(F.col(ts)).cast("timestamp"))) / 60).cast("double").alias("metric_value"))
    m = F.col("metric_value")
    status = F.when(m.isNull(), "warning").when(m < 0, "fail").when(m > most_minutes, "warning").otherwise("pass")
    severity = F.when(m < 0, "critical").otherwise("warning")
    return lag.select(F.lit(dataset).alias("dataset_name"), F.lit(f"freshness:{ts}").alias("check_name"), status.alias("status"), severity.alias("severity"), "metric_value", F.when(m < 0, 0.0).otherwise(float(most_minutes)).alias("threshold_value"))


def schema(df: DataFrame, dataset: str, required: Sequence[str]) -> DataFrame:
    missing = len([c for c in required if c not in df.columns])
    return _count(df.sparkSession.range(1).select(F.lit(missing).alias("n")), dataset, "schema", F.col("n"))


def leaks(df: DataFrame, dataset: str, feature_ts: str, reference_ts: str) -> DataFrame:
    """Features from after the time they are used for."""
    return _count(df.agg(F.count_if(F.col(feature_ts) > F.col(reference_ts)).alias("n")), dataset, "point_in_time", F.col("n"))


def fact(df: DataFrame, dataset: str, keys: Sequence[str], foreign: str | None = None, dimension: DataFrame | None = None, key: str | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Checks of one table in one pass over it: columns that must not be null, unique keys, and a foreign key into a dimension.

    Rows are combined by their keys and foreign key before anything else; the dimension's keys must be distinct.
    """
    by = [*keys, *([foreign] if foreign and foreign not in keys else [])]
    own = df.groupBy(*by).agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in required])
    if foreign:
        own = own.join(dimension.select(F.col(key).alias("__key")), F.col(foreign) == F.col("__key"), "left")
        own = own.withColumn("__orphan", F.when(F.col("__key").isNull(), F.col("__n")).otherwise(0))
    per_key = own.groupBy(*keys).agg(F.sum("__n").alias("__n"), *[F.sum(f"__null_{c}").alias(f"__null_{c}") for c in required], *([F.sum("__orphan").alias("__orphan")] if foreign else []))
    metrics = {f"not_null:{c}": F.sum(f"__null_{c}") for c in required} | {f"unique:{','.join(keys)}": F.sum(F.col("__n") - 1)}
    if foreign:
        metrics[f"referential:{foreign}"] = F.sum("__orphan")
    one = per_key.agg(*[F.coalesce(m, F.lit(0)).alias(f"m{k}") for k, m in enumerate(metrics.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"m{k}").cast("double").alias("m")) for k, name in enumerate(metrics)])
    each = one.select(F.explode(rows).alias("c"))
    return each.select(F.lit(dataset).alias("dataset_name"), F.col("c.name").alias("check_name"), F.when(F.col("c.m") > 0, "fail").otherwise("pass").alias("status"), F.lit("critical").alias("severity"), F.col("c.m").alias("metric_value"), F.lit(0.0).alias("threshold_value"))


def not_empty(df: DataFrame, dataset: str) -> DataFrame:
    """Number of rows of a table that must have some."""
    return _row(df.agg(F.count("*").alias("n")), dataset, "not_empty", F.col("n"), F.col("metric_value") < 1, "critical", 1.0)


def _of_run(rows: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write a run's rows in place of what the table holds of it, so that a run tried again leaves one result, and read them back."""
    spark, schema = rows.sparkSession, rows.withColumn("run_id", F.lit(run_id)).schema
    store = Store(spark, path)
    store.delete(f"{path}/run_id={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)}")
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return spark.read.schema(schema).parquet(path).filter(F.col("run_id") == run_id)


def persist(results: DataFrame, path: str, run_id: str) -> DataFrame:
    """Write results to a table by run, in place of earlier ones of the run, and return what it holds of the run. Results are worked out once."""
    return _of_run(results, path, run_id)


def run(checks: Sequence[DataFrame], path: str, run_id: str) -> DataFrame:
    """Run the checks, persist their results, and only then fail if a critical one failed."""
    return gate(persist(suite(checks), path, run_id))


def quarantine(failed: DataFrame, dataset: str, path: str, run_id: str) -> DataFrame:
    """Write failed rows (failure_reason, raw_payload) with their dataset, run and a record id to a table by dataset, in place of
    earlier ones of the run; returns the run's."""
    rows = failed.select(F.sha2(F.concat_ws("|", F.lit(dataset), "raw_payload"), 256).alias("record_id"), F.lit(dataset).alias("dataset_name"), "failure_reason", "raw_payload")
    return _of_run(rows, path, run_id)


def suite(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def gate(results: DataFrame) -> DataFrame:
    """The results, or an error that names the critical failures."""
    failed = results.filter("status = 'fail' and severity = 'critical'").select("dataset_name", "check_name").collect()
    if failed:
        raise CriticalFailure(", ".join(f"{r[0]} {r[1]}" for r in failed))
    return results
