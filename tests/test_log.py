"""The log source: ranges of offsets, rate limits, and streams that start again."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import log


def rows(spark, first, n):
    return spark.range(first, first + n).select((F.col("id") % 7).cast("string").alias("key"), F.col("id").cast("string").alias("value"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("seq"))


def fill(spark, path, parts=((0, 100), (100, 50))):
    for first, n in parts:
        ends = log.append(rows(spark, first, n), path, 3, ["seq"], segment_rows=9)
    return ends


def test_offsets_have_no_gap_and_keep_order(spark, tmp_path):
    path = str(tmp_path / "topic")
    ends = fill(spark, path)
    got = log.read(spark, path).collect()
    assert sorted(int(r.value) for r in got) == list(range(150)) and sum(ends.values()) == 150
    for p, end in ends.items():
        own = sorted((r.offset, int(r.value)) for r in got if r.partition == p)
        assert [o for o, _ in own] == list(range(end)) and [v for _, v in own] == sorted(v for _, v in own)
    assert log.append(rows(spark, 0, 0), path, 3, ["seq"]) == ends


def test_ranges(spark, tmp_path):
    path = str(tmp_path / "topic")
    ends = fill(spark, path)
    start, stop = {str(p): 4 for p in ends}, {str(p): e - 3 for p, e in ends.items()}
    got = log.read(spark, path, startingOffsets=json.dumps(start), endingOffsets=json.dumps(stop)).groupBy("partition").agg(F.min("offset"), F.max("offset"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {(p, 4, e - 4, e - 7) for p, e in ends.items()}
    with pytest.raises(Exception, match="not to 999"):
        log.read(spark, path, endingOffsets='{"0": 999}').collect()
    assert log.read(spark, str(tmp_path / "none")).count() == 0
    assert log.read(spark, "file://" + path).count() == 150


def test_a_stream_starts_again_without_gap_or_repeat(spark, tmp_path):
    path, out, ck = (str(tmp_path / x) for x in ("topic", "out", "ck"))
    fill(spark, path)
    sizes = []

    def run(fail_at=None):
        def take(batch, number):
            if number == fail_at:
                raise RuntimeError("lost on the way")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
            sizes.append(batch.count())

        q = log.stream(spark, path, maxOffsetsPerTrigger="20", group="g").writeStream.foreachBatch(take).option("checkpointLocation", ck).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="lost on the way"):
        run(fail_at=3)
    assert sizes == [20, 20, 20]
    run()
    log.append(rows(spark, 150, 30), path, 3, ["seq"])
    run()
    assert sorted(int(r.value) for r in spark.read.parquet(out).collect()) == list(range(180))
    assert all(n <= 20 for n in sizes) and len(sizes) >= 9
    # another query goes on where the group has come to, at most a batch behind
    log.append(rows(spark, 180, 5), path, 3, ["seq"])
    again = sorted(int(r.value) for r in log.read(spark, path, startingOffsets="group", group="g").collect())
    assert set(range(180, 185)) <= set(again) and len(again) <= 25
