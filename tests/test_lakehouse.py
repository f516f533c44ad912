"""Publishing, quality runs, labels, buffers, contracts and generators, by their edge cases."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_operators import labelled

from tidemark.operators import aggregates, audits, labels, layout, metadata, quality, scd2
from tidemark.sources import generator


def test_publishing(spark, tmp_path):
    target = str(tmp_path / "gold")
    assert layout.current_run(spark, target) is None
    layout.publish(spark.range(3), target, "one")

    def refuse(df):
        raise ValueError("refused")

    for df, run_id, validate, said in ((spark.range(9), "two", refuse, "refused"), (spark.range(9), "two", lambda df: False, "said no"), (spark.range(0), "two", None, "nothing"), (spark.range(9), " ", None, "run_id")):
        with pytest.raises(ValueError, match=said):
            layout.publish(df, target, run_id, validate)
    assert spark.read.parquet(target).count() == 3 and layout.current_run(spark, target) == "one"
    layout.publish(spark.range(4), target, "two")
    assert spark.read.parquet(target).count() == 4 and layout.current_run(spark, target) == "two"
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name or "previous" in p.name] == []


def test_a_publication_cut_off_between_its_renames_comes_back(spark, tmp_path):
    target = str(tmp_path / "gold")
    layout.publish(spark.range(3), target, "one")
    (tmp_path / "gold").rename(tmp_path / "_previous-gold-two")
    assert layout.recover(spark, target) and spark.read.parquet(target).count() == 3
    assert not layout.recover(spark, target)
    (tmp_path / "gold").rename(tmp_path / "_previous-gold-two")
    layout.publish(spark.range(5), target, "three")
    assert spark.read.parquet(target).count() == 5 and layout.current_run(spark, target) == "three"


def test_promotion_rolls_back(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for name, n in (("a", 1), ("b", 2)):
        spark.range(n).write.parquet(f"{root}/{name}")
        spark.range(10 * n).write.parquet(f"{root}/_staging/r/{name}")
    copy = layout.Store.copy

    def failing(self, source, goal):
        if "_staging" in source and source.endswith("/b"):
            raise OSError("no room")
        copy(self, source, goal)

    monkeypatch.setattr(layout.Store, "copy", failing)
    with pytest.raises(OSError, match="no room"):
        layout.promote(spark, root, "r", ["a", "b"])
    assert [spark.read.parquet(f"{root}/{n}").count() for n in "ab"] == [1, 2]
    assert not (tmp_path / "_staging" / "r").exists() and not (tmp_path / "_rollback" / "r").exists()


def test_results_are_persisted_before_a_run_fails(spark, tmp_path):
    bad = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    path = str(tmp_path / "results")
    with pytest.raises(quality.CriticalFailure, match="unique:k"):
        quality.run([quality.unique(bad, "t", ["k"]), quality.retention(bad, bad, "t")], path, "one")
    assert {r.status for r in spark.read.parquet(path).filter("run_id = 'one'").collect()} == {"fail", "pass"}
    assert quality.run([quality.retention(bad, bad, "t")], path, "two").count() == 1


def test_a_run_tried_again_has_one_result(spark, tmp_path):
    path, bad = str(tmp_path / "r"), spark.createDataFrame([(1,), (1,)], "k int")
    for data, passes in ((bad, False), (bad.distinct(), True), (bad.distinct(), True)):
        if passes:
            assert quality.run([quality.unique(data, "t", ["k"])], path, "2026-01-01T00:00").count() == 1
        else:
            with pytest.raises(quality.CriticalFailure):
                quality.run([quality.unique(data, "t", ["k"])], path, "2026-01-01T00:00")
    assert [r.status for r in spark.read.parquet(path).collect()] == ["pass"]
    failed = spark.createDataFrame([("ticker: required", "{}"), ("x", "{1}")], "failure_reason string, raw_payload string")
    where = str(tmp_path / "q")
    quality.quarantine(failed, "t", where, "other")
    assert [quality.quarantine(failed.limit(n), "t", where, "a:b").count() for n in (2, 2, 1, 0)] == [2, 2, 1, 0]
    assert {r.run_id for r in spark.read.parquet(where).collect()} == {"other"}


def test_objects_are_replaced_and_created_once(spark, tmp_path):
    store, p = layout.Store(spark, str(tmp_path)), str(tmp_path / "o.json")
    assert store.write(p, b"one") == 3 and store.write(p, b"three") == 5 and store.read(p) == b"three"
    assert not store.create(p, b"other") and store.create(p + "2", b"new") and store.read(p) == b"three"
    assert [n for n, _ in store.files(str(tmp_path)) if not n.endswith(".crc")] == ["o.json", "o.json2"]


def test_checks_of_a_table_in_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "z"), (None, "b")], "k int, f string")
    dim = spark.createDataFrame([("a",), ("b",)], "f string")
    found = {r.check_name: r.metric_value for r in quality.fact(df, "t", ["k"], "f", dim, "f", ["f"]).collect()}
    assert found == {"not_null:f": 1, "unique:k": 1, "referential:f": 2}
    assert found["referential:f"] == quality.referential(df, "t", "f", dim, "f").first().metric_value
    empty = {r.check_name: r.metric_value for r in quality.fact(df.limit(0), "t", ["k"], "f", dim, "f", ["f"]).collect()}
    assert set(empty.values()) == {0}


def test_retention_of_nothing_and_the_future(spark):
    df = spark.range(3)
    nothing = quality.retention(df, df.limit(0), "t").first()
    assert (nothing.status, nothing.severity, nothing.metric_value) == ("warning", "warning", 0.0)
    now = F.timestamp_seconds(F.lit(10_000))
    future = quality.freshness(df.select(F.timestamp_seconds(F.lit(20_000)).alias("ts")), "t", "ts", now, 60.0).first()
    assert (future.status, future.severity, future.threshold_value) == ("fail", "critical", 0.0)


@pytest.mark.parametrize(
    ("sector", "excluded"),
    [("Banks", True), (" banks ", True), ("Insurance", True), ("Securities", True), ("Diversified Financials", True), ("financial services", True), ("Bank", False), ("Banking", False), ("Financials", False), ("Blood banks", False), (None, False)],
)
def test_excluded_sectors(spark, sector, excluded):
    one = spark.createDataFrame([(sector,)], "s string")
    assert one.select(labels.is_financial(F.col("s"))).first()[0] is excluded
    assert one.select(labels.is_financial(F.lit("Retail"), F.col("s"))).first()[0] is excluded


def test_excluded_codes_and_config(spark, tmp_path):
    one = spark.createDataFrame([("4010", "45102010", "40201040")], "a string, b string, c string")
    none = F.lit(None).cast("string")
    assert one.select(labels.is_financial(none, sector_code=F.col("a"))).first()[0] is True
    assert one.select(labels.is_financial(none, sector_code=F.col("b"), code=F.col("b"))).first()[0] is False
    assert one.select(labels.is_financial(none, code=F.col("c"))).first()[0] is True
    file = tmp_path / "sectors.toml"
    file.write_text('sectors = ["Mining"]\ncodes = []\n')
    assert one.select(labels.is_financial(F.lit("mining"), config=str(file))).first()[0] is True
    assert labels.excluded()["codes"] == ["40", "4010", "4020", "4030"]


def test_warnings_by_name_in_order(spark):
    bad = {"total_liabilities": 900.0, "current_assets": 100.0, "current_liabilities": 250.0, "equity": -50.0, "ebit": 10.0, "net_income": -30.0}
    rows = labelled(spark, {"net_income": -10.0}, {**bad, "report_period": "2025Q2"})
    assert rows[1].distress_reason.split(";")[:5] == ["high_debt_to_asset", "low_current_ratio", "negative_equity", "two_quarter_net_loss", "weak_interest_coverage"]


def test_dimension_keys_are_upper_cased(spark):
    rows = [("aaa", "Old", 1, 1), ("AAA", "New", 2, 2)]
    df = spark.createDataFrame(rows, "ticker string, industry string, d int, seq int").withColumn("ts", F.timestamp_seconds(F.col("d") * 86400)).drop("d")
    found = scd2.rebuild(df, "ticker", "ts", ["industry"], "seq").orderBy("seq").collect()
    assert [(r.ticker, r.industry, r.is_current) for r in found] == [("AAA", "Old", False), ("AAA", "New", True)]
    assert found[0].version_key == hashlib.sha256(b"AAA|1970-01-02T00:00:00+00:00").hexdigest()[:16]


def test_buffers_flush_by_rows_or_seconds(spark):
    waits = [0, 10, 60, 0, 0, 0, 0, 61, 5, None, 70] * 2
    df = spark.createDataFrame([(k % 2, k, w) for k, w in enumerate(waits)], "consumer int, seq long, elapsed int")
    found = {(r.consumer, r.seq): r.flush for r in audits.flushed(df, "consumer", "seq", "elapsed", 3, 60).collect()}
    for consumer in (0, 1):
        held = waited = flush = 0
        for k, w in enumerate(waits):
            if k % 2 == consumer:
                held, waited = held + 1, waited + (w or 0)
                assert found[consumer, k] == flush
                if held >= 3 or waited >= 60:
                    held, waited, flush = 0, 0, flush + 1


def test_contracts_in_markdown():
    text = "# x\n\n## `t`\n\n| Field | Value |\n|---|---|\n| Primary keys | `a`, b |\n| Expected row count | 1,000 to 2,000 |\n\n| Column | Dtype | Nullable | Notes |\n|:--|---|---|---|\n| `a` | varchar | no | k |\n| b | INTEGER | yes | |\n\n## Lineage\n\n| Dataset | Upstream | Downstream |\n|---|---|---|\n| t | s, r | none |\n"
    t = audits.parse_contracts(text)["t"]
    assert (t.keys, t.rows, t.columns) == (("a", "b"), (1000, 2000), (("a", "VARCHAR", False), ("b", "INTEGER", True)))
    assert audits.parse_lineage(text) == [("t", "s", ""), ("t", "r", "")]
    assert audits.parse_contracts("no tables") == {}


def test_digest_of_a_large_table_is_refused(spark):
    with pytest.raises(ValueError, match="at most"):
        aggregates.canonical_digest(spark.range(11), most=10)


def test_bursts_late_and_repeated_events(spark):
    base = spark.createDataFrame([("e1", "AAA", 100), ("e2", "BBB", 101)], "event_id string, ticker string, event_second long")
    b = generator.burst(base, 10, 200).collect()
    assert len(b) == 200 and {r.ticker for r in b} == {"AAA"} and max(r.event_second for r in b) - min(r.event_second for r in b) == pytest.approx(10)
    assert generator.burst(base.limit(0), 5, 3).first().ticker == "AAA"
    for seconds, records in ((0, 5), (5, 0)):
        with pytest.raises(ValueError):
            generator.burst(base, seconds, records)
    moved = {r.event_id: r.event_second for r in generator.late(base, 30).collect()}
    assert 70 <= moved["e1"] < 100 and 71 <= moved["e2"] < 101
    assert generator.repeated(base, 1.0).count() == 4 and generator.repeated(base, 0.0).count() == 2


def test_versions_are_aligned(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, 6, None)], "schema_version int, cash long, kind string")
    found = generator.aligned_versions(df, {"cash": "long", "kind": "string"})
    assert sorted(map(tuple, found.collect())) == [(1, None, None), (2, 6, None)]


def test_metadata_keeps_the_newest_and_refuses_what_it_does_not_know(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.sql("select 'c' as collector_name, 's' as source_system, 'k' as checkpoint_key, v as checkpoint_value, timestamp_seconds(t) as updated_at from values ('old', 1), ('new', 5), ('older', 0) t(v, t)")
    metadata.log(rows, root, "collector_checkpoint")
    metadata.log(rows.limit(0), root, "collector_checkpoint")
    assert [r.checkpoint_value for r in metadata.newest(spark, root, "collector_checkpoint").collect()] == ["new"]
    with pytest.raises(ValueError, match="no column x"):
        metadata.log(spark.sql("select 'r' as run_id, 1 as x"), root, "pipeline_run_log")
    with pytest.raises(Exception, match="run_id is null"):
        metadata.log(spark.sql("select 'd' as dag_id"), root, "pipeline_run_log")


def test_writes_are_fenced(spark):
    rows = [(1, "s", "a", 5), (2, "s", "b", 7), (3, "s", "a", 9), (4, "s", "c", 6), (5, "s", "d", 9), (6, "t", "a", 1)]
    df = spark.createDataFrame(rows, "at int, session string, request string, token int")
    found = {r["at"]: r.outcome for r in audits.fenced(df, "session", "request", "token", "at").collect()}
    assert found == {1: "accepted", 2: "accepted", 3: "replayed", 4: "fenced off", 5: "accepted", 6: "accepted"}
