"""Event-time semantics in batch: routing of invalid, duplicate and late events against a running watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_max(df: DataFrame, order: str, value: str, into: str, chunk: int = 100_000) -> DataFrame:
    """Adds the largest `value` of all rows before this one in a global order, without sorting all rows in one task.

    order is an integer sequence. Rows are cut into chunks of it; the chunks' maxima, one row each, are ordered
    across, and rows only within their chunk.
    """
    rows = df.withColumn("__chunk", F.floor(F.col(order) / chunk))
    inside = Window.partitionBy("__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(F.col("__chunk").alias("c")).agg(F.max(value).alias("top")).withColumn("__before", F.max("top").over(across)).drop("top")
    joined = rows.withColumn("__inside", F.max(value).over(inside)).join(tops, F.col("__chunk") == F.col("c"))
    return joined.withColumn(into, F.greatest("__inside", "__before")).drop("__chunk", "__inside", "__before", "c")


def route(events: DataFrame, *, id: str, seq: str, ts: str, valid: Column, delay: int, lateness: int, dedup: bool = True) -> DataFrame:
    """Adds `route`: invalid, duplicate, too_late, allowed_late or on_time. ts is in whole seconds, seq the order of arrival.

    The watermark is the largest time so far of valid first-seen events, less `delay` seconds. An event before it
    is late, and too late if even `lateness` seconds more do not reach it.
    """
    good = events.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    first = F.row_number().over(Window.partitionBy("__valid", id).orderBy(seq)) == 1
    kind = F.when(~F.col("__valid"), "invalid").when(~first, "duplicate").otherwise("first") if dedup else F.when(~F.col("__valid"), "invalid").otherwise("first")
    return by_watermark(good.withColumn("__kind", kind), "__kind", seq, ts, delay, lateness).drop("__valid", "__kind")


def by_watermark(events: DataFrame, kind: str, seq: str, ts: str, delay: int, lateness: int, before: int | None = None) -> DataFrame:
    """Adds `route` to events whose column `kind` says invalid, duplicate or first. before: the largest time of first ones
    that came earlier than any of these, if there were some."""
    timed = running_max(events.withColumn("__time", F.when(F.col(kind) == "first", F.col(ts))), seq, "__time", "__top")
    top = F.greatest(F.col("__top"), F.lit(before).cast("long"))
    mark = F.greatest(F.coalesce(top, F.col(ts)), F.col(ts)) - delay
    route = F.when(F.col(kind) != "first", F.col(kind)).when(F.col(ts) + lateness < mark, "too_late").when(F.col(ts) < mark, "allowed_late").otherwise("on_time")
    return timed.withColumn("route", route).drop("__time", "__top")


def tumbling(events: DataFrame, key: str, ts: str, seconds: int, price: str, volume: str) -> DataFrame:
    """Events, average price (6 places) and volume of each key and window; ts in whole seconds."""
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(seconds))
    grouped = events.groupBy(key, start.cast("long").alias("window_start")).agg(F.count("*").alias("event_count"), F.round(F.sum(price) / F.count("*"), 6).alias("average_price"), F.sum(volume).alias("total_volume"))
    return grouped.withColumn("window_end", F.col("window_start") + seconds)
