import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import boolean, surrogate_key, typed
from tidemark.operators import aggregates, asof, contracts, dedup, events, facts, labels, layout, quality, scd2
from tidemark.sources import tables

COLUMNS = "ticker report_period total_assets current_assets current_liabilities total_liabilities equity retained_earnings ebit interest_expense net_income sector".split()
BASE = dict(zip(COLUMNS, ("AAA", "2025Q1", 1000.0, 300.0, 200.0, 500.0, 500.0, 150.0, 120.0, 20.0, 80.0, "Industry")))
SCHEMA = ", ".join(f"{c} {'string' if c in ('ticker', 'report_period', 'sector') else 'double'}" for c in COLUMNS)


def labelled(spark, *changes):
    rows = [tuple({**BASE, **c}.values()) for c in changes]
    return labels.label(spark.createDataFrame(rows, SCHEMA)).orderBy("report_period").collect()


def test_healthy_quarter_is_safe(spark):
    (r,) = labelled(spark, {})
    assert (r.z_score, r.distress_label, r.distress_reason, r.label_confidence, r.training_eligible) == (3.0014, 0, "z_score_safe_zone", "high", True)


def test_gray_zone(spark):
    (r,) = labelled(spark, {"current_assets": 250.0, "retained_earnings": 40.0, "ebit": 80.0})
    assert (r.z_score, r.distress_label, r.distress_reason, r.label_confidence, r.training_eligible) == (2.046, 0, "gray_zone_monitor", "low", False)


def test_distress_and_reasons(spark):
    bad = {"total_liabilities": 900.0, "current_assets": 100.0, "current_liabilities": 250.0, "equity": -50.0, "ebit": 10.0}
    first, second = labelled(spark, {"net_income": -10.0}, {**bad, "report_period": "2025Q2", "net_income": -30.0})
    assert second.distress_label == 1
    assert second.distress_reason.split(";")[:4] == ["high_debt_to_asset", "low_current_ratio", "negative_equity", "two_quarter_net_loss"]
    assert "two_quarter_net_loss" not in first.distress_reason


def test_losses_must_be_in_consecutive_quarters(spark):
    apart = labelled(spark, {"net_income": -1.0}, {"net_income": -1.0, "report_period": "2025Q3"})
    assert "two_quarter_net_loss" not in apart[1].distress_reason
    over_years = labelled(spark, {"net_income": -1.0, "report_period": "2024Q4"}, {"net_income": -1.0})
    assert "two_quarter_net_loss" in over_years[1].distress_reason


def test_missing_excluded_capped(spark):
    (r,) = labelled(spark, {"retained_earnings": None})
    assert (r.z_score, r.distress_label, r.distress_reason) == (None, None, "insufficient_data")
    (r,) = labelled(spark, {"sector": " Banks "})
    assert (r.z_score, r.distress_label, r.distress_reason, r.training_eligible) == (None, None, "financial_sector_excluded", False)
    (r,) = labelled(spark, {"total_liabilities": 0.0})
    assert r.z_score > 2.6 and r.distress_reason.endswith("zero_liabilities_x4_capped")
    (r,) = labelled(spark, {"interest_expense": 0.0})
    assert "weak_interest_coverage" not in r.distress_reason


def test_ratios_need_positive_denominators(spark):
    rows = facts.ratios(spark.createDataFrame([tuple({**BASE, "equity": -5.0, "interest_expense": 0.0, "net_income": None}.values())], SCHEMA)).first()
    assert rows.debt_to_equity is None and rows.interest_coverage is None and rows.return_on_assets is None
    assert rows.current_ratio == 1.5


def test_typed_values(spark):
    df = spark.createDataFrame([("1",), (" yes ",), ("t",), ("2026-01-02",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(boolean(F.col("v"))).collect()] == [True, True, None, None, None, None]
    assert [r[0] for r in df.select(typed(F.col("v"), "integer")).collect()] == [1, None, None, None, None, None]
    assert df.select(typed(F.col("v"), "date")).collect()[3][0] == dt.date(2026, 1, 2)


def test_surrogate_key(spark):
    rows = spark.createDataFrame([(" aaa ",), ("",), (None,)], "t string").select(surrogate_key(F.col("t")).alias("k")).collect()
    assert [r.k for r in rows] == ["cb1ad2119d8fafb6", None, None]


def test_contract_splits_every_row_once(spark):
    c = contracts.Contract("p", ("ticker", "price"), ("exchange",), {"price": "float"}, {"exchange": ("HOSE",)})
    rows = [("A", "1.5", "HOSE"), ("A", "x", "HOSE"), (" ", "1", None), (None, None, "??"), ("B", "2", None)]
    valid, failed = contracts.validate(spark.createDataFrame(rows, "` Ticker` string, price string, exchange string"), c)
    assert sorted((r.ticker, r.price) for r in valid.collect()) == [("A", 1.5), ("B", 2.0)]
    reasons = sorted(r.failure_reason for r in failed.collect())
    assert reasons == ["price: not float", "ticker: required", "ticker: required; price: required; exchange: not allowed"]
    valid, failed = contracts.validate(spark.createDataFrame([("A",)], "ticker string"), c)
    assert (valid.count(), failed.count()) == (0, 1)
    problems = contracts.differences(spark.createDataFrame([("A", "1", 2)], "ticker string, price string, z int"), c).collect()
    assert [tuple(p) for p in problems] == [("exchange", "missing"), ("price", "incompatible"), ("z", "extra")]


def test_latest_forms_agree(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d"), (None, 3, "e")], "k int, ts int, v string")
    a = dedup.latest_by_key(df, ["k"], [F.col("ts").desc_nulls_last(), F.col("v").desc()])
    b = dedup.latest_by_aggregate(df, ["k"], ["ts", "v"])
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_scd2_merge_equals_rebuild(spark):
    rows = [("A", "Old", 1, 1), ("A", "Old", 2, 2), ("A", None, 3, 3), ("A", None, 4, 4), ("A", "New", 5, 5), ("B", "X", 2, 6), ("C", "Y", 9, 7)]
    df = spark.createDataFrame(rows, "ticker string, industry string, d int, seq int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400)).drop("d")
    full = scd2.rebuild(df, "ticker", "ts", ["industry"], "seq")
    assert [(r.industry, r.is_current) for r in full.filter("ticker = 'A'").orderBy("valid_from_ts").collect()] == [("Old", False), (None, False), ("New", True)]
    split = F.timestamp_seconds(F.lit(3 * 86400))
    merged = scd2.merge(scd2.rebuild(df.filter(F.col("ts") < split), "ticker", "ts", ["industry"], "seq"), df.filter(F.col("ts") >= split), "ticker", "ts", ["industry"], "seq")
    assert sorted(map(repr, merged.select(full.columns).collect())) == sorted(map(repr, full.collect()))


def test_asof_forms_agree_on_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, "a", 1), (4, "b", 9), (5, None, 5), (6, "a", None)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 3, 1), ("a", 3, 2), ("a", 4, 3), ("b", 10, 4), (None, 1, 5), ("a", None, 6)], "k string, t int, v int")
    x = asof.asof_in_one(left, right, ["k"], "t", "t", ["v"]).select("id", "feature_v")
    y = asof.asof_join(left, right, ["k"], "t", "t", ["v"], slot=lambda t: F.floor(t / 2)).select("id", "feature_v")
    want = [(1, 3), (2, 2), (3, None), (4, None), (5, None), (6, None)]
    assert sorted(map(tuple, x.collect())) == want == sorted(map(tuple, y.collect()))


def test_report_by_ticker_equals_plain(spark):
    s = spark.createDataFrame([(k % 7, f"r{k}", k) for k in range(100)], "ticker int, record_id string, total_assets long")
    c = spark.createDataFrame([(k, "hot" if k < 5 else None) for k in range(7)], "ticker int, sector string")
    assert aggregates.sector_report(s, c).collect() == aggregates.sector_report_by_ticker(s, c).collect()
    assert aggregates.digest(s).first() == aggregates.digest(s.orderBy(F.rand(1))).first()


def test_quality_checks_and_gate(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "a"), (None, "b")], "k int, v string")
    assert quality.unique(df, "t", ["k"]).first().metric_value == 2
    assert quality.not_null(df, "t", "v").first().status == "fail"
    dim = spark.createDataFrame([(1,)], "k int")
    assert quality.referential(df, "t", "k", dim, "k").first().metric_value == 2
    now = F.timestamp_seconds(F.lit(10_000))
    at = lambda s: spark.createDataFrame([(s,)], "s long").select(F.timestamp_seconds("s").alias("ts"))
    found = [quality.freshness(at(s), "t", "ts", now, 60.0).first() for s in (9_000, 1_000, 20_000, None)]
    assert [(f.status, f.severity, f.threshold_value) for f in found] == [("pass", "warning", 60.0), ("warning", "warning", 60.0), ("fail", "critical", 0.0), ("warning", "warning", 60.0)]
    nothing = quality.retention(df, df.limit(0), "t").first()
    assert (nothing.status, nothing.metric_value) == ("warning", 0.0)
    with pytest.raises(quality.CriticalFailure, match="not_null:v"):
        quality.gate(quality.not_null(df, "t", "v"))
    assert quality.gate(quality.retention(df, df, "t")).count() == 1


def test_lateness_equals_a_replay(spark):
    rows = [(f"e{k % 23}", k, (k * 37) % 90 + k, None if k % 11 == 0 else 1.0) for k in range(60)]
    df = spark.createDataFrame(rows, "id string, seq long, ts long, price double")
    found = {r.seq: r.route for r in events.route(df, id="id", seq="seq", ts="ts", valid=F.col("price").isNotNull(), delay=20, lateness=15).collect()}
    seen, top = set(), None
    for i, seq, ts, price in rows:
        if price is None:
            want = "invalid"
        elif i in seen:
            want = "duplicate"
        else:
            seen.add(i)
            top = ts if top is None else max(top, ts)
            want = "too_late" if ts + 15 < top - 20 else "allowed_late" if ts < top - 20 else "on_time"
        assert found[seq] == want, seq


def test_running_max_over_chunks(spark):
    df = spark.createDataFrame([(k, (k * 7919) % 101) for k in range(300)], "seq long, v long")
    found = {r.seq: r.m for r in events.running_max(df, "seq", "v", "m", chunk=16).collect()}
    values = [(k * 7919) % 101 for k in range(300)]
    assert found == {k: max(values[:k], default=None) for k in range(300)}


def test_zorder_interleaves(spark):
    z = spark.createDataFrame([(0, 0), (3, 0), (0, 3), (3, 3)], "a int, b int")
    assert [r.z_key for r in layout.zorder(z, ["a", "b"], bits=2).orderBy("a", "b").collect()] == [0, 10, 5, 15]


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).repartition(20).write.parquet(path)
    s = layout.compact(spark, path, path + "-out").first()
    assert (s.files_before, s.files_after, s["rows"]) == (20, 1, 1000)
    assert layout.file_stats(spark, path + "-out").first().files == 1


def test_optional_raises_other_errors(spark, tmp_path):
    assert tables.optional(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "bad.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        tables.optional(spark, str(tmp_path / "bad.parquet"), "a int").count()


def test_view_names(spark):
    with pytest.raises(ValueError, match="must start"):
        tables.register_views(spark, {"company": spark.range(1)})


def test_plans(spark):
    d = "/root/testdata/sf0.001"
    scan = tables.table(spark, d, "lineitem").filter("l_quantity < 10").select("l_orderkey")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity" in plan and "l_extendedprice" not in plan
    joined = asof.asof_in_one(*[tables.table(spark, d, "events").select("event_id", "ts", "user_id")] * 2, ["user_id"], "ts", "ts")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
