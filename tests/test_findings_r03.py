"""What the findings of round 3 name, on small inputs that failed before."""

from pyspark.sql import functions as F

from tidemark.operators import layout
from tidemark.plans import catalog
from tidemark.streaming import log, stateful


def test_compaction_to_one_file_when_orders_exceed_the_usual_target(spark, tmp_path, monkeypatch):
    spark.range(3000).select(F.col("id").alias("o_orderkey"), F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(layout.compact, "__defaults__", (4096, None))
    assert [tuple(r) for r in catalog.compact_files(spark, str(tmp_path)).collect()] == [(12, 1, 3000)]
    assert sorted(r.files_after for r in catalog.compact_guard(spark, str(tmp_path)).collect()) == [1, 12]


def test_a_partition_of_a_log_is_written_by_many_tasks_in_order(spark, tmp_path):
    rows = spark.range(1000, numPartitions=5).select((F.col("id") % 3).cast("string").alias("key"), F.col("id").cast("string").alias("value"), F.timestamp_seconds("id").alias("timestamp"), (-F.col("id")).alias("seq"))
    ends = log.append(rows, f"{tmp_path}/topic", 2, ["seq"], task_rows=100)
    got = log.read(spark, f"{tmp_path}/topic").collect()
    assert sum(ends.values()) == len(got) == len({(r.partition, r.offset) for r in got}) == 1000
    for p in ends:
        own = [int(r.value) for r in sorted(got, key=lambda r: r.offset) if r.partition == p]
        assert own == sorted(own, reverse=True)
    # a task's rows are a range of the order, not a whole partition
    tasks = [len(own) for own in log.segments([n for n, _ in layout.Store(spark, str(tmp_path)).files(f"{tmp_path}/topic")]).values()]
    assert sum(tasks) >= 10


def test_windows_take_the_files_of_a_routed_batch_together(spark, tmp_path):
    """Files of one batch in any order, an event at the edge of what is allowed, events without a ticker: all are counted."""
    ticks = [[(k, k, 10_000 + k, None if k % 5 == 0 else f"T{k % 3}", None, 1, "on_time") for k in range(40)], [(50, 50, 10_039 - 420, "T1", None, 1, "allowed_late")]]
    for n, rows in enumerate(ticks):
        df = spark.createDataFrame(rows, "id long, seq long, ts long, ticker string, price decimal(18,4), volume long, route string").withColumn("price", F.lit("1.5").cast("decimal(18,4)"))
        df.repartition(12 if n == 0 else 1).write.parquet(f"{tmp_path}/routed/batch={n}")
    routed, last = stateful.ended(spark, str(tmp_path), 60, 100, 320, files=1)
    assert routed.count() == 41
    assert sum(r.event_count for r in last.collect()) == 41 and last.filter("ticker is null").agg(F.sum("event_count")).first()[0] == 8


def test_state_is_called_for_by_buckets_and_not_by_ids(spark, tmp_path):
    rows = spark.range(6000).select("id", F.col("id").alias("seq"), F.col("id").alias("ts"), F.lit("T").alias("ticker"), F.lit("2.25").cast("decimal(18,4)").alias("price"), F.lit(1).cast("long").alias("volume"))
    rows.unionByName(rows.limit(100).withColumn("seq", F.col("id") + 6000)).write.parquet(f"{tmp_path}/in")
    ticks = spark.readStream.schema(stateful.TICK).parquet(f"{tmp_path}/in")
    stateful._through(stateful.route_stream(ticks, f"{tmp_path}/run", 100, 320))
    got = stateful.routed(spark, f"{tmp_path}/run")
    assert got.filter("route = 'duplicate'").count() == 100 and got.filter("price = 2.25").count() == 6100
    keys = stateful._with_rocksdb(spark, lambda: spark.read.format("statestore").load(f"{tmp_path}/run/checkpoint-route").count())
    assert keys <= 1024 and stateful.state_rows(spark, f"{tmp_path}/run") == 6000


def test_bpe_holds_nothing_in_an_idle_worker(spark):
    """The codec goes with the task; short and long fragments have the library's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    codec, library = bpe.ForcedBoundaryBPE(path), Tokenizer.from_file(path)
    for text in ["the theatre's haanth équeenoieauch", "a" * 63, "a" * 64, "a" * 65, "ab" * 300, "thonin" * 40, "Don't 12 <|endoftext|> x"]:
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert not hasattr(bpe, "worker_cache")


def test_links_are_contracted_in_a_stage_of_their_own(spark, monkeypatch):
    """Edges that Python finds are a checkpoint before Python contracts them, so a task of op3 or the pipeline has one worker at a time."""
    from tidemark.llm import simhash

    plans, inner = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda edges: plans.append(edges._jdf.queryExecution().executedPlan().toString()) or inner(edges))
    words = [f"w{k}" for k in range(40)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "quite another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_each(df, radius=3).collect()) == [1, 3]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}.keys() == {1, 2, 3}
    assert len(plans) >= 4 and not [p for p in plans if "MapInArrow" in p]


def test_workers_of_the_pipeline_give_memory_back_when_a_task_ends(spark, tmp_path, monkeypatch):
    """A task of fingerprints, components, exact dedup or encode ends by giving back what the allocators of its worker still hold."""
    import os

    import public_tokenizers

    from tidemark.llm import bpe, graph, shared, simhash, suffix

    def mark(folder=str(tmp_path)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()

    shared.give_back()  # does no harm
    monkeypatch.setattr(shared, "give_back", mark)
    df = spark.createDataFrame([(k, f"{k} is the first of some words that stand in all texts and repeat, so they go") for k in range(3)], "doc_id long, text string").coalesce(1)
    for stage in (lambda: simhash.fingerprints(df), lambda: graph.connected_components(spark.range(1, 2).selectExpr("id + 1 a", "id b")), lambda: suffix.remove(df), lambda: bpe.digests(df, public_tokenizers.path("word_bpe_49k.json"))):
        before = len(os.listdir(tmp_path))
        assert stage().count() > 0
        assert len(os.listdir(tmp_path)) > before
