import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fim


def expected(doc_id, text, share=90, spm=20, seed=1, marks=("<P>", "<S>", "<M>")):
    p, s, m = marks
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in marks) or h3 % 100 >= share:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", a, b - a, s + text[b:] + p + text[:a] + m + text[a:b]
    return n, "psm", a, b - a, p + text[:a] + s + text[b:] + m + text[a:b]


def check(df, rows, **options):
    made = fim.transform(df, **options)
    back = fim.restored(F.col("output"), F.col("form"), options.get("marks", ("<P>", "<S>", "<M>")))
    got = sorted(made.withColumn("back", back).collect(), key=repr)
    want = sorted((d, *expected(d, t, **{k: v for k, v in options.items() if k != "limit"}), t or "") for d, t in rows)
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_outputs_equal_brute_force(spark, docs, empty, limit):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None]
    check(docs.filter("doc_id is not null"), rows, limit=limit)
    (null,) = fim.transform(docs.filter("doc_id is null")).collect()
    text = docs.filter("doc_id is null").first().text
    assert null.doc_id is None and tuple(null)[1:] == expected(None, text)
    assert fim.transform(empty).count() == 0


def test_marks_quotes_and_odd_characters(spark):
    odd = ["<P>", "a<S>b", "<P", "P><", "<<<>>>", "a\nb\r\n\0c", "\U0001f642" * 9, "éé", "it's '' \"q\"", "<P<S<M" * 5, "x" * 300_000]
    rows = [(k, t) for k, t in enumerate(odd * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, rows)
    check(df, rows, share=100, spm=50, seed=7, marks=("[p'", "[s", "{m"))


def test_ids_of_any_type_and_marks_that_cannot_be_told_apart(spark):
    rows = [("a", "some text"), ("b", "another one")]
    check(spark.createDataFrame(rows, "doc_id string, text string"), rows, share=100)
    for marks in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aa", "b", "c"), ("<a", "b<", "c")):
        with pytest.raises(ValueError):
            fim.transform(spark.createDataFrame(rows, "doc_id string, text string"), marks=marks)
