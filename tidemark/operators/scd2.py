"""Slowly changing dimensions (type 2): one row a version, with its validity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import iso_utc, surrogate_key


def rebuild(snapshots: DataFrame, key: str, ts: str, tracked: Sequence[str], tie: str) -> DataFrame:
    """Versions of each key, in upper case: a snapshot starts one when a tracked column differs from the one before (null equals null).

    Adds company_key, version_key (of the key and the time in ISO form), valid_from_ts, valid_to_ts (the next version's start) and is_current.
    """
    snapshots = snapshots.withColumn(key, F.upper(key))
    order = Window.partitionBy(key).orderBy(ts, tie)
    state = F.struct(*tracked)
    marked = snapshots.withColumn("__first", F.row_number().over(order) == 1).withColumn("__changed", ~F.lag(state).over(order).eqNullSafe(state))
    versions = marked.filter("__first or __changed")
    versions = versions.withColumn("valid_to_ts", F.lead(ts).over(order)).withColumn("__last", F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())) == 1)
    return versions.select(
        surrogate_key(F.col(key)).alias("company_key"),
        surrogate_key(F.col(key), iso_utc(F.col(ts))).alias("version_key"),
        key,
        *tracked,
        F.col(ts).alias("valid_from_ts"),
        "valid_to_ts",
        F.col("__last").alias("is_current"),
        tie,
    )


def merge(dimension: DataFrame, snapshots: DataFrame, key: str, ts: str, tracked: Sequence[str], tie: str) -> DataFrame:
    """The dimension with later snapshots: its versions' starts are snapshots again, and versions are derived anew for the keys that changed."""
    snapshots = snapshots.withColumn(key, F.upper(key))
    touched = snapshots.select(key).distinct()
    starts = dimension.join(touched, key, "left_semi").select(key, *tracked, F.col("valid_from_ts").alias(ts), tie)
    again = rebuild(starts.unionByName(snapshots.select(key, *tracked, ts, tie)), key, ts, tracked, tie)
    return dimension.join(touched, key, "left_anti").unionByName(again)
