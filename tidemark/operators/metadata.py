"""Metadata tables of the pipelines: append-only Parquet, of which the newest row of a key counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import latest_by_key


@dataclass(frozen=True)
class MetadataTable:
    keys: tuple[str, ...]
    schema: str
    newest: str


# The tables' names, keys and columns.
TABLES = {
    "pipeline_run_log": MetadataTable(("run_id",), "run_id string, dag_id string, task_id string, dataset_name string, status string, started_at timestamp, ended_at timestamp, input_rows long, output_rows long, error_message string, created_at timestamp", "created_at"),
    "data_quality_result": MetadataTable(("check_id",), "check_id string, run_id string, dataset_name string, check_name string, status string, severity string, metric_value double, threshold_value double, checked_at timestamp, error_message string", "checked_at"),
    "dataset_freshness": MetadataTable(("dataset_name",), "dataset_name string, latest_event_timestamp timestamp, latest_ingest_ts timestamp, freshness_lag_minutes double, sla_minutes double, status string, checked_at timestamp", "checked_at"),
    "schema_version_registry": MetadataTable(("dataset_name", "schema_version"), "dataset_name string, schema_version string, effective_from timestamp, effective_to timestamp, schema_json string, is_current boolean", "effective_from"),
    "failed_records": MetadataTable(("record_id",), "record_id string, dataset_name string, run_id string, failure_reason string, raw_payload string, created_at timestamp", "created_at"),
    "backfill_request": MetadataTable(("backfill_id",), "backfill_id string, dataset_name string, start_date date, end_date date, status string, requested_by string, created_at timestamp", "created_at"),
    "source_request_log": MetadataTable(("request_id",), "request_id string, run_id string, source_system string, source_endpoint string, ticker string, report_period string, request_status string, http_status_code int, retry_count int, raw_payload_hash string, error_message string, requested_at timestamp", "requested_at"),
    "collector_checkpoint": MetadataTable(("collector_name", "source_system", "checkpoint_key"), "collector_name string, source_system string, checkpoint_key string, checkpoint_value string, updated_at timestamp", "updated_at"),
}


def log(rows: DataFrame, root: str, name: str) -> None:
    """Append rows to a metadata table. Columns they lack are null; a key that is null, or a column the table has not, is an error."""
    table = TABLES[name]
    fields = rows.sparkSession.createDataFrame([], table.schema).schema
    unknown = set(rows.columns) - set(fields.names)
    if unknown:
        raise ValueError(f"{name} has no column {', '.join(sorted(unknown))}")
    given = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    for k in table.keys:
        given = given.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"{name}: {k} is null"))).otherwise(F.col(k)))
    given.write.mode("append").parquet(f"{root}/{name}")


def newest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest row of each key; of equal times, the one that is largest column by column."""
    table = TABLES[name]
    rows = spark.read.schema(table.schema).parquet(f"{root}/{name}")
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c != table.newest]
    return latest_by_key(rows, list(table.keys), [F.col(table.newest).desc_nulls_last(), *rest])


def visible(df: DataFrame, role: str, policies: Mapping[str, Column | None]) -> DataFrame:
    """The rows that a role may read: those its policy holds for, all where the policy is None, and none for a role without one."""
    if role not in policies:
        return df.filter(F.lit(False))
    policy = policies[role]
    return df if policy is None else df.filter(F.coalesce(policy, F.lit(False)))


def permitted(requests: DataFrame, rules: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Adds `permitted` to requests (role, action, level): a rule (role, action, least level of assurance) lets them."""
    table = requests.sparkSession.createDataFrame(list(rules), "__role string, __action string, __least int")
    joined = requests.join(table, (F.col("role") == F.col("__role")) & (F.col("action") == F.col("__action")), "left")
    return joined.withColumn("permitted", F.coalesce(F.col("level") >= F.col("__least"), F.lit(False))).drop("__role", "__action", "__least")
