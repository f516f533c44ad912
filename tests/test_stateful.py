"""The stateful stream against the batch form, whole, stopped and started again."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events
from tidemark.streaming import log, stateful

SIZE, DELAY, LATENESS = 60, 100, 320


@pytest.fixture(scope="module")
def ticks(spark):
    draw = random.Random(4)
    rows, clock = [], 1000
    for seq in range(240):
        clock += draw.randrange(12)
        late = draw.choice([0, 0, 0, 50, 150, 400, 600])
        again = draw.choice(rows)[0] if rows and draw.random() < 0.12 else seq
        rows.append((again, seq, clock - late, draw.choice("AB"), None if draw.random() < 0.05 else float(draw.randrange(100)), 1))
    return spark.createDataFrame(rows, "id long, seq long, ts long, ticker string, price double, volume long").withColumn("price", F.col("price").cast("decimal(18,4)")).coalesce(1)


@pytest.fixture(scope="module")
def topic(spark, ticks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "ticks")
    log.append(ticks.select(F.lit("k").alias("key"), F.to_json(F.struct("*")).alias("value"), F.timestamp_seconds("ts").alias("timestamp"), "seq"), path, 1, ["seq"])
    return path


def stream(spark, topic):
    lines = log.stream(spark, topic, maxOffsetsPerTrigger="20", group=f"g{random.random()}")
    return lines.select(F.from_json("value", stateful.TICK).alias("t")).select("t.*")


def expected(ticks):
    routed = events.route(ticks, id="id", seq="seq", ts="ts", valid=F.col("price").isNotNull(), delay=DELAY, lateness=LATENESS)
    kept = routed.filter("route in ('on_time', 'allowed_late')")
    return sorted((r.id, r.seq, r.route) for r in routed.collect()), sorted((r.ticker, r.window_start, r.event_count, r.total_volume) for r in events.tumbling(kept, "ticker", "ts", SIZE, "price", "volume").collect())


def found(routed, last):
    return sorted((r.id, r.seq, r.route) for r in routed.collect()), sorted((r.ticker, r.window_start, r.event_count, r.total_volume) for r in last.collect())


def test_stream_equals_batch_through_a_restart(spark, ticks, topic, tmp_path):
    where, batches = str(tmp_path / "run"), []

    def stops(n):
        batches.append(n)
        if n == 4:
            raise RuntimeError("stopped in mid-run")

    with pytest.raises(Exception, match="stopped in mid-run"):
        stateful.bounded(stream(spark, topic), where, SIZE, DELAY, LATENESS, after=stops)
    # the state is that of the batches that ended: an entry for each valid id
    assert stateful.state_rows(spark, where) == ticks.filter("seq < 80 and price is not null").select("id").distinct().count()
    got = found(*stateful.bounded(stream(spark, topic), where, SIZE, DELAY, LATENESS, after=batches.append, files=2))
    want = expected(ticks)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert {r for _, _, r in got[0]} == {"invalid", "duplicate", "too_late", "allowed_late", "on_time"}
    assert batches[:6] == [0, 1, 2, 3, 4, 4] and len(set(batches)) >= 10
    # windows fired when the watermark passed them and again for events that were late, and all state went
    firings = spark.read.schema(f"{stateful.WINDOW}, batch int").parquet(f"{where}/windows")
    assert firings.filter("firing > 1").count() > 0 and firings.select("batch").distinct().count() > 3
    assert stateful.state_rows(spark, where, "windows") == 0
