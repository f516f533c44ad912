"""The price stream: decode, watermark, dedup within it, tumbling windows, side outputs by batch."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.layout import Store

TICK = "event_id long, ts timestamp, ticker string, price double, volume long"


def decode(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid ticks, rows that are not): raw has a `value` column of JSON."""
    parsed = raw.withColumn("tick", F.from_json(F.col("value").cast("string"), TICK))
    t = F.col("tick")
    good = F.coalesce(t["event_id"].isNotNull() & t["ts"].isNotNull() & t["ticker"].isNotNull() & t["price"].isNotNull() & t["volume"].isNotNull(), F.lit(False))
    return parsed.filter(good).select("tick.*"), parsed.filter(~good).select("value")


def windows(ticks: DataFrame, size: str, delay: str, dedup: bool) -> DataFrame:
    """Events, average price and volume by ticker and tumbling window. Allowed lateness is part of the delay; with dedup, an id counts once within it."""
    marked = ticks.withWatermark("ts", delay)
    if dedup:
        marked = marked.dropDuplicatesWithinWatermark(["event_id"])
    grouped = marked.groupBy(F.window("ts", size), "ticker").agg(F.count("*").alias("event_count"), F.round(F.avg("price"), 6).alias("average_price"), F.sum("volume").alias("total_volume"))
    return grouped.select("ticker", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "event_count", "average_price", "total_volume")


def replay(stream: DataFrame, where: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over all there is and return the last version of each key. Batches and checkpoints are written below `where`."""
    spark = stream.sparkSession
    run = f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{run}/out").drop("batch")
    if not keys:
        return out.drop("__batch")
    latest = Window.partitionBy(*keys).orderBy(F.col("__batch").desc())
    return out.withColumn("__rank", F.row_number().over(latest)).filter("__rank = 1").drop("__rank", "__batch")


def ticks_from_files(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def bronze(batch: DataFrame, path: str, number: int = 0, ts: str = "ts") -> int:
    """Write a batch below topic / event_date / event_hour / batch_id and return its rows. A batch that is written again first
    loses what there is of it."""
    store = Store(batch.sparkSession, path)
    for left in store.fs.globStatus(store.path(f"{path}/topic=*/event_date=*/event_hour=*/batch_id={number}")) or []:
        store.fs.delete(left.getPath(), True)
    seen = Observation()
    dated = batch.observe(seen, F.count(F.lit(1)).alias("n")).withColumns({"event_date": F.to_date(ts), "event_hour": F.hour(ts), "batch_id": F.lit(number)})
    by = ["topic", "event_date", "event_hour", "batch_id"]
    # a number of its own, so that small batches are not made one task: a file costs more than its rows
    tasks = int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated.repartition(tasks, *by[:3]).write.mode("append").partitionBy(*by).parquet(path)
    return seen.get["n"]


def bronze_stream(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts") -> int:
    """Run a stream with a column `topic` into the bronze layout over all there is; the rows that this run took.

    The checkpoint holds what was read: a run that starts again goes on after the last whole batch, and the batch that
    was under way is written again under its own number, so every row is there once.
    """
    taken: dict[int, int] = {}

    def write(batch: DataFrame, number: int) -> None:
        taken[number] = bronze(batch, path, number, ts)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(taken.values())


def kafka_source(spark: SparkSession, servers: str, topics: str, bounded: bool = True, **options: str) -> DataFrame:
    """Values of Kafka topics from the earliest offset; needs Spark's Kafka package on the class path. Offsets are kept in the
    checkpoint of the query that reads a stream, never committed to Kafka."""
    reader = spark.read if bounded else spark.readStream
    given = {"kafka.bootstrap.servers": servers, "subscribe": topics, "startingOffsets": "earliest", "failOnDataLoss": "true"} | options
    return reader.format("kafka").options(**given).load().selectExpr("cast(value as string) as value", "topic", "timestamp")


def file_topic(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream in the form of kafka_source from files of JSON lines (value), for tests and replays."""
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).text(path).withColumns({"topic": F.get_json_object("value", "$.topic"), "timestamp": F.current_timestamp()})


class Incomplete(Exception):
    """A bounded read ended with fewer rows than expected."""


def poll(stream: DataFrame, schema: str, run_id: str, expected: int, seconds: float, where: str) -> DataFrame:
    """The first `expected` messages of a run, decoded, in order of arrival: reads until they are there or the time is up, then
    raises Incomplete. Messages of other runs are passed over."""
    spark = stream.sparkSession
    folder = f"{where.rstrip('/')}/poll-{uuid.uuid4().hex}"
    found = [0]

    def take(batch: DataFrame, number: int) -> None:
        own = batch.select(F.from_json("value", schema).alias("e")).select("e.*").filter(F.col("evidence_run_id") == run_id)
        placed = own.withColumns({"batch": F.lit(number), "place": F.monotonically_increasing_id()})
        placed.write.mode("overwrite").parquet(f"{folder}/out/number={number}")
        found[0] += spark.read.schema(placed.schema).parquet(f"{folder}/out/number={number}").count()

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").start()
    ends = time.monotonic() + seconds
    try:
        while found[0] < expected and time.monotonic() < ends and query.isActive:
            time.sleep(0.05)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    if found[0] < expected:
        raise Incomplete(f"expected {expected} messages of {run_id}, got {found[0]}")
    rows = spark.read.parquet(f"{folder}/out").drop("number")
    return rows.orderBy("batch", "place").limit(expected).drop("batch", "place")


def side_outputs(routed: DataFrame, windows: DataFrame, path: str) -> None:
    """Files of what a bounded run leaves: late, duplicate and invalid events by route as JSON lines, and its windows as Parquet."""
    aside = routed.filter("route in ('invalid', 'duplicate', 'too_late')")
    aside.repartition("route").write.mode("overwrite").partitionBy("route").json(f"{path}/side")
    windows.write.mode("overwrite").parquet(f"{path}/windows")


def kafka_rows(df: DataFrame, key: str, topic: str) -> DataFrame:
    """Rows as a Kafka sink takes them: JSON with its fields in order of name."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("value"), F.lit(topic).alias("topic"))
