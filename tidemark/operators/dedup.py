"""Keeping one row of several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order `newest`; Spark limits groups before the shuffle (WindowGroupLimit)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest)))
    return ranked.filter("__rank = 1").drop("__rank")


def latest_by_aggregate(df: DataFrame, keys: Sequence[str], newest: Sequence[str]) -> DataFrame:
    """The same by max_by, which combines before the shuffle: columns of `newest` descending, nulls last."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("__best"))
    return best.select(*keys, "__best.*").select(*df.columns)


def by_content(df: DataFrame, text: str, id: str) -> DataFrame:
    """(content_hash, kept id, copies) of each distinct text."""
    return df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash")).agg(F.min(id).alias("kept_id"), F.count("*").alias("copies"))
