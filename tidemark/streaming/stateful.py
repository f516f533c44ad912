"""The price stream with keyed state: duplicates, late and too late events aside, and windows that fire again.

Two queries, each with a checkpoint and RocksDB state, kept by buckets of keys that are worked on as arrays:

* route_stream() tells events that are invalid, first or repeated by a state of ids that each live `ttl` seconds, and routes the
  batch by the running watermark. What the batches before had reached is one number, kept with each batch's output. A
  batch's output is written beside its place and renamed there, so a batch that is run again leaves one.
* window_stream() adds kept events to windows by ticker. A window fires when the watermark passes its end, fires again for
  each batch with events that are late but allowed, and its state goes when no such event can come any more; both
  are event-time timers.

bounded() runs both over all there is and moves the watermark past the last window, as a bounded source does at its end.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import events
from tidemark.operators.layout import Store

register_pickle_by_value(sys.modules[__name__])
TICK = "id long, seq long, ts long, ticker string, price decimal(18,4), volume long"
WINDOW = "ticker string, window_start long, window_end long, event_count long, total_volume long, price_sum decimal(28,4), firing int"
_HELD = ["ticker", "window_start", "event_count", "total_volume", "price_sum", "firing"]
_SUM = pa.decimal128(28, 4)
#: Groups that a query's keys are dealt out over; a checkpoint holds for one number of them.
BUCKETS = 1024


def _with_rocksdb(spark: SparkSession, start: Callable):
    """start() with RocksDB as the session's state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(name, before)


def _bucket(c: str) -> Column:
    """State is kept by buckets of keys, each worked on as arrays: a call a key would cost more than all else."""
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def kinds(ticks: DataFrame, ttl: int) -> DataFrame:
    """A stream of TICK with `kind`: invalid (no price), duplicate (an id that was there less than ttl seconds ago) or first.

    A bucket's state is the ids that are known, and when each goes; a null id is one of them (`none` tells it from 0)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = [np.frombuffer(x, np.int64) for x in state.get[1:]] if state.exists else [np.zeros(0, np.int64)] * 3
        held = [x[held[2] > now] for x in held]
        if not state.hasTimedOut:
            rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
            valid, known = rows["valid"].to_numpy(bool), pd.MultiIndex.from_arrays(held[:2])
            own = pd.MultiIndex.from_arrays([rows["known_id"].to_numpy(np.int64), rows["none"].to_numpy(np.int64)])
            first = valid.copy()
            first[valid] = ~(own[valid].duplicated() | own[valid].isin(known))
            new = [own[first].get_level_values(k).to_numpy(np.int64) for k in (0, 1)]
            held = [np.concatenate(x) for x in zip(held, [*new, np.full(len(new[0]), now + 1000 * ttl)])]
            yield rows.assign(kind=np.where(first, "first", np.where(valid, "duplicate", "invalid")))[columns]
        if len(held[0]):
            state.update((len(held[0]), *[x.astype(np.int64).tobytes() for x in held]))
            state.setTimeoutDuration(max(int(held[2].min()) - now, 1))
        elif state.exists:
            state.remove()

    # without nulls, so that pandas keeps 64 bits; a price travels as its ten-thousandths
    whole = {"known_id": "id", "seq": "seq", "ts": "ts", "volume": "volume"}
    price = F.coalesce((F.col("price") * 10000).cast("decimal(18,0)").cast("long"), F.lit(0)).alias("price")
    flags = [F.col("id").isNull().cast("long").alias("none"), F.col("volume").isNull().alias("no_volume"), F.col("ts").isNull().alias("no_ts"), F.col("price").isNotNull().alias("valid")]
    sent = ticks.select(_bucket("id").alias("bucket"), "ticker", price, *flags, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in whole.items()])
    schema = "ticker string, price long, none long, no_volume boolean, no_ts boolean, valid boolean, known_id long, seq long, ts long, volume long, kind string"
    columns = [c.split()[0] for c in schema.split(", ")]
    made = sent.groupBy("bucket").applyInPandasWithState(run, schema, "n long, ids binary, nones binary, ends binary", "append", GroupStateTimeout.ProcessingTimeTimeout)
    back = F.when(F.col("valid"), (F.col("price").cast("decimal(22,0)") / F.lit(10000)).cast("decimal(18,4)"))
    return made.select(F.when(F.col("none") == 0, F.col("known_id")).alias("id"), "seq", F.when(~F.col("no_ts"), F.col("ts")).alias("ts"), "ticker", back.alias("price"), F.when(~F.col("no_volume"), F.col("volume")).alias("volume"), "kind")


def route_stream(ticks: DataFrame, where: str, delay: int, lateness: int, ttl: int = 3600, after: Callable[[int], None] | None = None, **trigger):
    """Start the query that writes every event with its route below <where>/routed/batch=<n>. after(n) is called at the end of each
    batch; trigger: availableNow=True to end with what there is."""
    spark = ticks.sparkSession
    store = Store(spark, where)

    def take(batch: DataFrame, n: int) -> None:
        place, beside = f"{where}/routed/batch={n}", f"{where}/_beside/{uuid.uuid4().hex}"
        batch.write.parquet(f"{beside}/marked")  # state is worked out once a batch, and when a batch is run again too
        if not store.exists(place):
            marked = batch.sparkSession.read.schema(batch.schema).parquet(f"{beside}/marked")
            top = json.loads(store.read(f"{where}/tops/{n - 1}.json")) if n else None
            routed = events.by_watermark(marked, "kind", "seq", "ts", delay, lateness, top)
            routed.drop("kind").write.parquet(f"{beside}/routed")
            own = marked.filter("kind = 'first'").agg(F.max("ts")).first()[0]
            store.write(f"{where}/tops/{n}.json", json.dumps(max((x for x in (top, own) if x is not None), default=None)).encode())
            store.fs.mkdirs(store.path(f"{where}/routed"))
            store.rename(f"{beside}/routed", place)
        store.delete(beside)
        if after:
            after(n)

    store.fs.mkdirs(store.path(f"{where}/tops"))
    writer = kinds(ticks, ttl).writeStream.foreachBatch(take).option("checkpointLocation", f"{where}/checkpoint-route")
    writer = writer.trigger(**trigger) if trigger else writer
    return _with_rocksdb(spark, writer.start)


def routed(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.schema(f"{TICK}, route string, batch int").parquet(f"{where}/routed")


def windows(kept: DataFrame, size: int, delay: int, lateness: int) -> DataFrame:
    """Firings of tumbling windows over a stream of kept TICKs with their route, whose watermark is `lateness` and a second behind that
    of the routes: Spark drops what is not after it, and an event of just that time is still allowed."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gone = state.getCurrentWatermarkMs() // 1000 + 1  # no kept event is older
        passed = gone + lateness  # windows that end here or before have fired
        tables = [pa.ipc.open_stream(state.get[1]).read_all().append_column("touched", pa.nulls(state.get[0], pa.int32()))] if state.exists else []
        if not state.hasTimedOut:
            rows = pd.concat(list(parts))
            rows = rows[rows["route"] != "end"]
            ts = rows["ts"].to_numpy(np.int64)
            ones = np.ones(len(rows), np.int32)
            columns = [pa.array(rows["ticker"], pa.string(), from_pandas=True), ts - ts % size, ones.astype(np.int64), pa.array(rows["volume"], pa.int64(), from_pandas=True), pa.array(rows["price"], _SUM, from_pandas=True), 0 * ones, ones]
            tables.append(pa.table(columns, [*_HELD, "touched"]))
        if not tables:
            return
        both = pa.concat_tables(tables).group_by(_HELD[:2]).aggregate([(c, "max" if c in ("firing", "touched") else "sum") for c in [*_HELD[2:], "touched"]])
        ticker, start, count, volume, total, firing, touched = (both.column(c).combine_chunks() for c in [*_HELD[:2], *[f"{c}_{'max' if c in ('firing', 'touched') else 'sum'}" for c in [*_HELD[2:], "touched"]]])
        start, fired = start.to_numpy(), firing.to_numpy().copy()
        now = (start + size <= passed) & ((fired == 0) | touched.is_valid().to_numpy(zero_copy_only=False))
        fired[now] += 1
        found = pa.table([ticker, start, count, volume.fill_null(0), total.cast(_SUM), fired.astype(np.int32)], _HELD)
        if now.any():
            out = found.filter(pa.array(now)).to_pandas()
            yield out.assign(window_end=out["window_start"] + size)[[c.split()[0] for c in WINDOW.split(", ")]]
        stays = start + size > gone
        if stays.any():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, found.schema) as writer:
                writer.write_table(found.filter(pa.array(stays)))
            state.update((int(stays.sum()), sink.getvalue().to_pybytes()))
            due = (start + size - np.where(fired > 0, 0, lateness))[stays].min()
            state.setTimeoutTimestamp(1000 * max(int(due), gone + 1))
        elif state.exists:
            state.remove()

    timed = kept.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", f"{delay + lateness + 1} seconds")
    return timed.withColumn("bucket", _bucket("ticker")).groupBy("bucket").applyInPandasWithState(run, WINDOW, "n long, held binary", "append", GroupStateTimeout.EventTimeTimeout)


def window_stream(spark: SparkSession, where: str, size: int, delay: int, lateness: int, batches: list[int]):
    """Start the query from what was routed in some batches to firings, below <where>/windows/batch=<n>. One trigger takes all files of these
    batches, however many: the watermark would pass over rows of a batch that came in a later trigger than others of it."""
    place = f"{where}/routed/batch={{{','.join(map(str, batches))}}}"
    kept = spark.readStream.schema(f"{TICK}, route string").option("recursiveFileLookup", "true").parquet(place).filter("route in ('on_time', 'allowed_late', 'end')")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{where}/windows/batch={n}")
    writer = windows(kept, size, delay, lateness).writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint-windows").trigger(availableNow=True)
    return _with_rocksdb(spark, writer.start)


def end_mark(spark: SparkSession, where: str, size: int, delay: int, lateness: int) -> None:
    """A row after all others that moves the watermark past every window."""
    last = routed(spark, where).agg(F.max("batch"), F.max("ts")).first()
    if last[0] is None:
        return
    mark = [(None, None, last[1] + size + delay + lateness + 2, None, None, None, "end")]
    spark.createDataFrame(mark, f"{TICK}, route string").coalesce(1).write.mode("overwrite").parquet(f"{where}/routed/batch={last[0] + 1}")


def _through(query) -> None:
    """Wait until a query has had a batch without rows, and stop it. With timeouts by the clock it has batches without end, and
    Spark's own processAllAvailable() would not return."""
    try:
        while query.isActive:
            progress = query.lastProgress
            if progress and progress["numInputRows"] == 0:
                break
            time.sleep(0.05)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()


def bounded(ticks: DataFrame, where: str, size: int, delay: int, lateness: int, ttl: int = 3600, after: Callable[[int], None] | None = None, files: int = 8) -> tuple[DataFrame, DataFrame]:
    """(all events with their route, the last firing of each window) of what a stream has now."""
    _through(route_stream(ticks, where, delay, lateness, ttl, after))
    return ended(ticks.sparkSession, where, size, delay, lateness, files)


def ended(spark: SparkSession, where: str, size: int, delay: int, lateness: int, files: int = 8) -> tuple[DataFrame, DataFrame]:
    """What bounded() gives, of events that were routed before; the windows take the files of `files` routed batches at a time."""
    end_mark(spark, where, size, delay, lateness)
    store = Store(spark, where)
    routes = sorted({int(n.split("/")[0][len("batch=") :]) for n, _ in store.files(f"{where}/routed") if n.endswith(".parquet")})
    for k in range(0, len(routes), files):
        window_stream(spark, where, size, delay, lateness, routes[k : k + files]).awaitTermination()
    fired = spark.read.schema(f"{WINDOW}, batch int").parquet(f"{where}/windows")
    last = fired.groupBy("ticker", "window_start").agg(F.max_by(F.struct("window_end", "event_count", "total_volume", "price_sum", "firing"), "firing").alias("w"))
    return routed(spark, where).filter("route <> 'end'"), last.select("ticker", "window_start", "w.*")


def state_rows(spark: SparkSession, where: str, query: str = "route") -> int:
    """Ids, or windows, that a query's state holds, from its checkpoint."""
    return _with_rocksdb(spark, lambda: spark.read.format("statestore").load(f"{where}/checkpoint-{query}").agg(F.sum("value.groupState.n")).first()[0] or 0)
