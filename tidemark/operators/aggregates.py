"""Aggregations: sector report, its two-level form, digests, profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sector_report(statements: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies, statements, distinct records and assets by sector; statements(ticker, record_id, total_assets), companies(ticker, sector)."""
    joined = statements.join(companies, "ticker")
    return (
        joined.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector"))
        .agg(F.countDistinct("ticker").alias("company_count"), F.count("*").alias("statement_count"), F.countDistinct("record_id").alias("record_count"), F.sum("total_assets").alias("total_assets"))
        .orderBy("sector")
    )


def sector_report_by_ticker(statements: DataFrame, companies: DataFrame) -> DataFrame:
    """The same from one row a ticker, added up before tickers meet their sectors; what is left of a hot sector is one row a task.

    Records are counted once a ticker, so record ids must not be shared by tickers.
    """
    per = statements.groupBy("ticker", "record_id").agg(F.count("*").alias("n"), F.sum("total_assets").alias("a"))
    per = per.groupBy("ticker").agg(F.sum("n").alias("n"), F.count("record_id").alias("r"), F.sum("a").alias("a"))
    joined = per.join(companies, "ticker").groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector"))
    return joined.agg(F.count("*").alias("company_count"), F.sum("n").alias("statement_count"), F.sum("r").alias("record_count"), F.sum("a").alias("total_assets")).orderBy("sector")


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): equal for tables with the same rows in any order. A sum of 64-bit row hashes, so it is combined before the shuffle and no row is collected."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))


def canonical_digest(df: DataFrame, most: int = 100_000) -> DataFrame:
    """SHA-256 over all rows as JSON, sorted: for small tables such as a report. More than `most` rows are refused; digest() takes any number."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a canonical digest is for at most {most} rows")
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("digest"))


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows of one that the other lacks, counting repeats; both 0 for equal tables."""
    left = a.exceptAll(b).agg(F.count("*").alias("only_left"))
    return left.join(b.exceptAll(a).agg(F.count("*").alias("only_right")))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def window_profile(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    """(windows, median_count, largest_count, burst_ratio) of events in fixed windows."""
    counts = events.groupBy(F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds).alias("w")).agg(F.count("*").alias("n"))
    p = counts.agg(F.count("*").alias("windows"), F.percentile("n", F.lit(0.5)).alias("median_count"), F.max("n").alias("largest_count"))
    return p.withColumn("burst_ratio", F.round(F.col("largest_count") / F.col("median_count"), 6))
