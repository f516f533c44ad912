import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import mixing, quality


def measured(text):
    t = text or ""
    w = t.encode().split()
    marks = [0] * len(w)
    seen = Counter(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            marks[i : i + 3] = [1, 1, 1]
    lines = [x for x in t.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(marks)


def test_measures_equal_brute_force(docs):
    for r in quality.judge(docs).select("text", "quality.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text), r.text


def test_keep_drops_what_a_rule_breaks(docs, empty):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert quality.judge(docs).columns == [*docs.columns, "quality", "quality_failed"]
    assert {r.quality_text for r in kept.collect()} == {"q"}
    assert {r.text for r in kept.collect()} == {r.text for r in quality.judge(docs).filter(F.size("quality_failed") == 0).collect()}
    assert all(len((r.text or "").split()) >= 50 for r in kept.collect())
    assert quality.keep(empty).count() == 0


def test_rules_are_bounds(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    failed = quality.judge(df, (quality.Rule("n_words", low=3, high=3), quality.Rule("mean_word_length", high=3.0))).first()["quality_failed"]
    assert failed == ["mean_word_length"]


def filled(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Water-filling in rounds: clamp what is above, share out the rest anew."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            open_.discard(s)
            left -= out[s]


def test_targets_and_taken_words(docs, empty):
    rows = mixing.mix(docs, ranges=8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    want = filled(sizes)
    largest = max(r["size"] for r in rows)
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.copies * r["size"] for r in own) - want[s]) <= 2 * largest
        assert max(r.copies for r in own) <= 2
    assert all(r["size"] == len((t or "").encode().split()) for r, t in [(r, None) for r in rows if r["size"] == 0])
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(3), ranges=8).collect()), key=repr)
    assert mixing.mix(empty).count() == 0


def test_repeated_rows_are_the_copies(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    mixed = mixing.repeated(docs)
    assert mixed.columns == docs.columns
    found = Counter(r.doc_id for r in mixed.collect())
    assert {k: v for k, v in copies.items() if v} == dict(found)


def test_projection_stays_native(docs):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Exchange hash", plan)


def test_a_text_of_two_sources_is_repeated_by_each(spark):
    rows = [(None, "one two three four", s) for s in ("a", "b", None) for _ in range(9)] + [(1, "five words stand in here", s) for s in ("a", "b")]
    rows += [(k, " ".join(["w"] * (k % 7)), "b") for k in range(2, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want, found = Counter(), Counter((r.doc_id, r.text, r.source) for r in mixing.repeated(df).collect())
    for r in mixing.mix(df).collect():
        want[r.doc_id, r["size"], r.source] += r.copies
    assert {k: v for k, v in want.items() if v} == {(d, len(t.split()), s): n for (d, t, s), n in found.items()}
    assert len({n for (d, _, s), n in found.items() if d is None}) > 1
