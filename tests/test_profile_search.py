"""Percentiles, sketches, trigram search and pages against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, search


@pytest.mark.parametrize("q, cells", [(0.5, 4), (0.0, 1024), (0.9, 16), (1.0, 2)])
def test_percentiles_equal_sparks(spark, tmp_path, q, cells):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([float(draw.randrange(50)), draw.gauss(0, 1e6), 7.5])) for _ in range(600)]
    rows += [("one", 3.25), ("null", None), ("two", 1.0), ("two", 2.0)] + [("same", 5.0)] * 40 + [("wide", x) for x in (-1e308, 0.0, 1e-300, 1e308)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    want = {r.k: r.p for r in df.groupBy("k").agg(F.percentile("v", F.lit(q)).alias("p")).filter("p is not null").collect()}
    got = {r.k: r.percentile for r in profile.exact_percentile(df, ["k"], "v", q, str(tmp_path), cells).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert profile.exact_percentile(df.filter("v is null"), [], "v", q, str(tmp_path)).count() == 0


def test_sketches_of_days_merge(spark):
    df = spark.range(20_000).select(F.expr("date'2026-01-01' + cast(id % 5 as int)").alias("d"), F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("s"))
    got = {r.column_name: r for r in profile.merged(profile.daily(df, "d", ["n", "s", "d"])).collect()}
    assert got["n"].row_count == 20_000 and got["s"].null_count == df.filter("s is null").count()
    for c in ("n", "s", "d"):
        assert got[c].distinct_values == pytest.approx(df.select(c).filter(f"{c} is not null").distinct().count(), rel=0.03)
    assert got["n"].median == pytest.approx(10_000, rel=0.05) and got["s"].median is None
    assert got["s"].frequent[0]["item"] == "hot" and got["s"].frequent[0]["count"] == pytest.approx(6667, rel=0.1)


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    draw = random.Random(2)
    rows = [(k, "".join(draw.choice("abAB éx") for _ in range(draw.randrange(0, 40)))) for k in range(400)] + [(999, None), (1000, "ab")]
    terms = ["ab", "aba", "ABA b", "éx a", "zzz", "x"]
    df = spark.createDataFrame(rows, "id long, t string").repartition(3)
    asked = spark.createDataFrame([(t,) for t in terms + ["aba"]], "term string")
    search.write_trigrams(df, "id", "t", str(tmp_path / "i"), 5)
    got = sorted((r.term, r.id) for r in search.containing(df, "id", "t", asked, str(tmp_path / "i")).collect())
    want = sorted((t, k) for t in terms for k, x in rows if t.lower() in (x or "").lower())
    assert got == want
    many = search.candidates(asked.filter("length(term) >= 3"), str(tmp_path / "i")).count()
    assert many <= 3 * sum(len(t) >= 3 for t, _ in want)


def test_pages(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b"))
    search.write_blocks(df, ["b", "a"], path, 50, 4)
    whole = [tuple(r) for r in df.orderBy("b", "a").select("b", "a").collect()]
    for offset, limit in ((0, 10), (45, 20), (333, 100), (995, 20), (2000, 5)):
        got = search.page(spark, path, ["b", "a"], offset, limit)
        assert sorted((r.b, r.a) for r in got.collect()) == whole[offset : offset + limit]
        assert len(got.inputFiles()) <= limit // 25 + 3 or offset > 1000
    for at in (0, 48, 500, 999):
        assert [(r.b, r.a) for r in search.page_after(spark, path, ["b", "a"], whole[at], 60).collect()] == whole[at + 1 : at + 61]
