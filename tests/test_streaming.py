import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import prices


def test_decode_sides(spark):
    good = {"event_id": 1, "ts": "2026-01-01T00:00:00", "ticker": "A", "price": 1.5, "volume": 2}
    rows = [json.dumps(good), "{broken", json.dumps({**good, "price": None}), None]
    valid, invalid = prices.decode(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert valid.collect()[0].price == 1.5 and valid.count() == 1 and invalid.count() == 3


def run(spark, tmp_path, dedup, *batches):
    """Replay batches of (id, second), each a file; the source takes files by their time."""
    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    merged, known = tmp_path / "in", set()
    for k, rows in enumerate(batches):
        data = [(i, start + dt.timedelta(seconds=s), "A", 1.0, 1) for i, s in rows]
        spark.createDataFrame(data, prices.TICK).coalesce(1).write.mode("append").parquet(str(merged))
        for f in set(merged.glob("*.parquet")) - known:
            os.utime(f, (1_700_000_000 + 100 * k,) * 2)
            known.add(f)
    stream = prices.ticks_from_files(spark, str(merged), prices.TICK)
    out = prices.replay(prices.windows(stream, "10 seconds", "300 seconds", dedup), str(tmp_path / "run"), ["ticker", "window_start"])
    return {int(r.s): r.event_count for r in out.select((F.unix_timestamp("window_start") - 1767225600).alias("s"), "event_count").collect()}


def test_late_windows_update_until_the_watermark_passes(spark, tmp_path):
    found = run(spark, tmp_path, False, [(1, 5), (2, 1001)], [(6, 1002)], [(3, 699), (4, 700), (5, 705)])
    # late rows of a batch are told by the watermark that the batch before it began with: 701 in the third
    assert found == {0: 1, 1000: 2, 700: 2}


def test_dedup_counts_an_id_once_and_drops_by_event(spark, tmp_path):
    found = run(spark, tmp_path, True, [(1, 1000), (1, 1000), (2, 1001)], [(5, 1002)], [(2, 1001), (3, 700), (4, 702)])
    assert found == {1000: 3, 700: 1}


def test_bronze_stream_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    where, source = str(tmp_path / "b"), str(tmp_path / "in")
    rows = "select {0} as event_id, timestamp'2026-01-02 03:04:05' + make_interval(0, 0, 0, 0, {0}) as ts, concat('p', {0} % 2) as topic"
    schema = "event_id int, ts timestamp, topic string"

    def add(*ids):
        spark.sql(" union all ".join(rows.format(k) for k in ids)).coalesce(1).write.mode("append").parquet(source)

    def read():
        return sorted((r.event_id, r.topic, str(r.event_date), r.event_hour, r.batch_id) for r in spark.read.parquet(where).collect())

    run_once = lambda: prices.bronze_stream(prices.ticks_from_files(spark, source, schema), where, str(tmp_path / "ck"))
    add(1, 2)
    assert run_once() == 2 and run_once() == 0
    add(3, 4)
    whole = prices.bronze

    def breaks(batch, path, number, ts):
        whole(batch, path, number, ts)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(prices, "bronze", breaks)
    with pytest.raises(Exception, match="lost after the write"):
        run_once()
    monkeypatch.setattr(prices, "bronze", whole)
    assert run_once() == 2
    assert read() == [(1, "p1", "2026-01-02", 4, 0), (2, "p0", "2026-01-02", 5, 0), (3, "p1", "2026-01-02", 6, 1), (4, "p0", "2026-01-02", 7, 1)]


def test_polling_ends_in_time(spark, tmp_path):
    rows = [json.dumps({"k": k, "evidence_run_id": f"r{k % 2}"}) for k in range(6)] + ["{broken"]
    spark.createDataFrame([(r,) for r in rows], "value string").repartition(3).write.text(str(tmp_path / "t"))
    read = lambda n, seconds: prices.poll(prices.file_topic(spark, str(tmp_path / "t")), "k int, evidence_run_id string", "r1", n, seconds, str(tmp_path / "w"))
    assert sorted(r.k for r in read(3, 60).collect()) == [1, 3, 5]
    assert read(2, 60).count() == 2
    with pytest.raises(prices.Incomplete, match="expected 4"):
        read(4, 5)


def test_bronze_layout(spark, tmp_path):
    df = spark.sql("select 'p' as topic, timestamp'2026-01-02 03:04:05' as ts, 1 as v")
    prices.bronze(df, str(tmp_path / "b"))
    r = spark.read.parquet(str(tmp_path / "b")).first()
    assert (r.topic, str(r.event_date), r.event_hour) == ("p", "2026-01-02", 3)
