import random

import pytest

from tidemark.llm import linededup
from tidemark.llm.shared import shared_dir
from tidemark.operators.layout import Store


def key(line):
    k = line.strip(" \t\n\v\f\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def brute(rows, least=20, documents=3):
    low = lambda d: -(1 << 70) if d is None else d
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders.setdefault(key(x), set()).add(low(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < documents or max(holders[key(x)]) == low(d)]
        out.append((low(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def got(df):
    return sorted((-(1 << 70) if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect())


@pytest.fixture(scope="module")
def lined(spark):
    """Documents of lines of all kinds: a hot one that two thirds have, others that few share, odd white space, nulls and repeated ids."""
    draw = random.Random(3)
    odd = ["  no ascii space at the ends  ", "é" * 20, "é" * 19, "x" * 19, "y" * 20, "  Y" + "y" * 19 + "\t\r", "", " " * 30, "a\0b" * 10, "\x85" + "z" * 22]
    lines = odd + [f"line number {k} that some documents share" for k in range(25)] + [f"LINE number {k} that some documents SHARE  " for k in range(25)]
    rows = [(None, None), (None, "y" * 20 + "\nline number 3 that some documents share"), (5000, ""), (5001, "\n"), (5002, "\n\n" + "y" * 20 + "\n")]
    for k in range(150):
        own = [f"a line of document {k} alone, {j}" for j in range(draw.randrange(4))]
        some = own + draw.choices(lines, k=draw.randrange(12)) + ["the one line that stands in most documents"] * (k % 3 > 0)
        draw.shuffle(some)
        rows.append((draw.randrange(1000), "\n".join(some)))
    rows += [rows[20], (rows[21][0], rows[22][1])]
    return rows


@pytest.mark.parametrize("batches, fanout, documents", [(6, 2, 3), (1, 4, 3), (9, 3, 2), (6, 4, 5)])
def test_lines_equal_brute_force(spark, lined, batches, fanout, documents):
    df = spark.createDataFrame(lined, "doc_id long, text string").repartition(7)
    assert got(linededup.drop_lines(df, batches=batches, fanout=fanout, documents=documents)) == brute(lined, documents=documents)


def test_clashing_columns_and_no_rows(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(linededup.drop_lines(docs, documents=2)) == brute(rows, documents=2)
    assert linededup.drop_lines(empty).count() == 0


def test_runs_are_levelled_and_come_back(spark, monkeypatch):
    path = f"{shared_dir(spark)}/runs-of-a-test"
    runs = linededup.LineRuns(spark, path, fanout=2)
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, h long, g long")
    seen = []
    for k in range(5):
        # key 0 is in each batch, twice; key k + 1 is new in batch k
        repeats = runs.add(frame((10 - k, 0, 0), (30 - k, 0, 0), (10 - k, k + 1, 7)), f"b{k}")
        seen.append(sorted((r.doc_id, r.h) for r in repeats.read().collect()))
    assert seen == [[(10, 0)]] + [[(10 - k, 0), (30 - k, 0)] for k in range(1, 5)]
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    with pytest.raises(ValueError, match="b3"):
        runs.add(frame((1, 1, 1)), "b3")
    # a batch that is lost on the way counts for nothing
    with monkeypatch.context() as m:
        m.setattr(linededup.LineRuns, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            runs.add(frame((1, 99, 1)), "b5")
    # another application knows the folder only
    for level in runs.levels:
        for name in level:
            spark.sql(f"drop table {name}")
    again = linededup.LineRuns(spark, path, fanout=2)
    assert sorted((r.h, r.n, r.top) for r in again.totals().collect()) == [(0, 10, 30)] + [(k + 1, 1, 10 - k) for k in range(5)]
    again.add(frame((1, 99, 1)), "b5")
    assert [len(level) for level in again.levels] == [0, 1, 1]
    again.drop()
    assert not Store(spark, path).exists(path)


def test_a_batch_meets_runs_without_a_shuffle_of_them(spark):
    runs = linededup.LineRuns(spark)
    runs.add(spark.range(100).selectExpr("id as doc_id", "id % 50 as h", "0L as g"), "a")
    own = runs._write(spark.range(40, 60).selectExpr("id as h", "0L as g", "1L as n", "id as top"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = runs.unseen(runs._read(own))
        assert sorted(r.h for r in fresh.collect()) == list(range(50, 60))
        assert "Exchange" not in fresh._jdf.queryExecution().executedPlan().toString().replace("ShuffleExchange", "Exchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs._forget(own)
        runs.drop()
