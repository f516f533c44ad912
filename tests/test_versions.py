"""Publication by manifests: every step at which a run may end, and writers side by side. Compaction and zone maps."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import layout, packing, versions


def ids(df):
    return sorted(r.id for r in df.collect())


def test_a_run_that_ends_at_any_step_leaves_old_or_new(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "gold")
    new = {"a": spark.range(5), "b": spark.range(7)}
    assert versions.publish({"a": spark.range(2), "b": spark.range(3)}, root, "one") == 1
    for name in ("create", "write", "rename", "delete"):
        whole = getattr(layout.Store, name)
        for nth in range(2):
            calls = [0]

            def dies(self, *a, whole=whole, calls=calls, nth=nth):
                calls[0] += 1
                if calls[0] > nth:
                    raise KeyboardInterrupt
                return whole(self, *a)

            before = versions.manifest(spark, root)["number"]
            with monkeypatch.context() as m:
                m.setattr(layout.Store, name, dies)
                try:
                    versions.publish(new, root, "two")
                except KeyboardInterrupt:
                    pass
            after = versions.manifest(spark, root)["number"]
            got = (ids(versions.read(spark, root, "a")), ids(versions.read(spark, root, "b")))
            assert got in (([0, 1], [0, 1, 2]), (list(range(5)), list(range(7)))) and after - before in (0, 1)
            if after > before:
                versions.roll_back(spark, root, 1, "back")
    assert versions.vacuum(spark, root, keep=1, older_than=-1) > 0
    assert ids(versions.read(spark, root, "a")) == [0, 1]


def test_refusals_change_nothing(spark, tmp_path):
    root = str(tmp_path / "gold")
    versions.publish({"a": spark.range(2)}, root, "one")
    for datasets, why in (({"a": spark.range(3), "b": spark.range(0)}, "nothing to publish of b"), ({"a": spark.range(9)}, "said no")):
        with pytest.raises(ValueError, match=why):
            versions.publish(datasets, root, "two", lambda _, df: df.count() < 9)
    with pytest.raises(ValueError):
        versions.publish({"a": spark.range(1)}, root, " ")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "b")
    assert ids(versions.read(spark, root, "a")) == [0, 1] and versions.manifest(spark, root)["number"] == 1


def test_two_writers_lose_no_run(spark, tmp_path):
    root = str(tmp_path / "gold")
    versions.publish({"a": spark.range(1)}, root, "start")
    threads = [threading.Thread(target=lambda k=k: versions.publish({"a": spark.range(10 * k, 10 * k + 2)}, root, f"w{k}", append=True)) for k in range(1, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert versions.manifest(spark, root)["number"] == 5
    assert ids(versions.read(spark, root, "a")) == sorted([0, *(10 * k + j for k in range(1, 5) for j in range(2))])
    assert len({versions.manifest(spark, root, n)["run_id"] for n in range(1, 6)}) == 5


def test_bins():
    assert packing.bins([5, 4, 3, 9, 20, 1], 10) == [[4], [3, 5], [0, 1], [2]]
    assert packing.plan([("p=1/a.parquet", 3), ("p=1/b.parquet", 4), ("p=2/c.parquet", 4), ("p=1/d.parquet", 9), ("_x/e.parquet", 1)], 10) == [("p=1", ["p=1/b.parquet", "p=1/a.parquet"])]


@pytest.fixture
def partitioned(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a b+c:d").when(F.col("id") % 3 == 1, "x").alias("p"))
    df.repartition(6).write.partitionBy("p").parquet(path)
    spark.range(40_000, 90_000).select("id", F.lit("x").alias("p")).coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    return path


def rows(spark, path):
    return sorted((r.id, r.p or "") for r in spark.read.parquet(path).collect())


def test_compaction_keeps_folders_and_large_files(spark, partitioned):
    store = layout.Store(spark, partitioned)
    before, data = dict(store.files(partitioned)), rows(spark, partitioned)
    large = max(before, key=before.get)
    done = packing.compact(spark, partitioned, target=before[large])
    after = {n: s for n, s in store.files(partitioned) if n.endswith(".parquet")}
    assert rows(spark, partitioned) == data and after[large] == before[large]
    assert {n.split("/")[0] for n in after} == {n.split("/")[0] for n in before if "/" in n} and len(after) == 4
    assert done == {"files_before": 19, "files_after": 4, "rewritten": 18}
    assert packing.compact(spark, partitioned, target=before[large])["rewritten"] == 0


def test_a_compaction_that_stops_is_ended_by_the_next(spark, partitioned, monkeypatch):
    data = rows(spark, partitioned)
    for step in range(0, 24, 5):
        left = [step]

        def dies(self, *a, left=left, whole=layout.Store.delete):
            left[0] -= 1
            if left[0] < 0:
                raise KeyboardInterrupt
            return whole(self, *a)

        with monkeypatch.context() as m:
            m.setattr(layout.Store, "delete", dies)
            try:
                packing.compact(spark, partitioned, target=1 << 17)
            except KeyboardInterrupt:
                pass
        packing.recover(spark, partitioned)
        assert rows(spark, partitioned) == data


def test_zones_skip_files(spark, tmp_path):
    path = str(tmp_path / "z")
    df = spark.range(1000).select("id", F.lpad(F.col("id").cast("string"), 5, "0").alias("name"), F.when(F.col("id") < 500, F.col("id") / 2).alias("half"))
    df.repartitionByRange(10, "id").write.parquet(path)
    packing.write_zones(spark, path, ["id", "name", "half"])
    kept = spark.read.parquet(f"{path}/_zones").agg(F.sum("row_count"), F.min("least_id"), F.max("greatest_name"), F.max("greatest_half")).first()
    assert tuple(kept) == (1000, 0, "00999", 249.5)
    picked, of = packing.pick(spark, path, {"id": (420, 430)})
    assert len(picked) <= 2 and of == 10
    got = packing.between(spark, path, {"name": ("00420", "00430"), "id": (None, 425)})
    assert sorted(r.id for r in got.collect()) == list(range(420, 426)) and len(got.inputFiles()) <= 2
    assert packing.between(spark, path, {"id": (5000, None)}).count() == 0
    # all null: no statistics, so the file is read
    assert sorted(r.id for r in packing.between(spark, path, {"half": (249.5, 900.0)}).collect()) == [499]
