import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix


def brute(rows, length):
    """{(rank, text): report} by comparing every string of `length` bytes."""
    first = {}
    for rank, t in sorted(rows):
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], rank)
    out = {}
    for rank, t in rows:
        marks = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < rank:
                marks[k : k + length] = b"\1" * length
        kept = bytes(c for c, m in zip(t, marks) if not m)
        spans = sum(1 for k in range(len(t)) if marks[k] and (k == 0 or not marks[k - 1]))
        out[rank, t] = (len(t), sum(marks), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def ranked(docs):
    return [(suffix.NULL_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.collect()]


@pytest.mark.parametrize("small", [False, True])
def test_report_equals_brute_force(docs, empty, monkeypatch, small):
    if small:  # pieces, blocks and buckets of a few texts
        monkeypatch.setattr(suffix, "BLOCK", 900)
        monkeypatch.setattr(suffix, "STEP", 120)
        monkeypatch.setattr(suffix, "PER_BUCKET", 3000)
    want = brute(ranked(docs), 50)
    expected = sorted((rank, *w[:4]) for (rank, t), w in ((k, want[k]) for k in ranked(docs)))
    found = sorted((suffix.NULL_ID if r.doc_id is None else r.doc_id, *tuple(r)[1:]) for r in suffix.report(docs).collect())
    assert found == expected
    assert sum(r[2] for r in found) > 1000
    assert suffix.report(empty).count() == 0


def test_remove_keeps_columns_and_nulls(docs, empty):
    want = brute(ranked(docs), 50)
    kept = suffix.remove(docs)
    assert kept.columns == docs.columns
    texts = sorted(((r.doc_id is None, r.doc_id), r.text or "") for r in kept.collect())
    expected = sorted(((r.doc_id is None, r.doc_id), want[suffix.NULL_ID if r.doc_id is None else r.doc_id, (r.text or "").encode()][4].decode("utf-8", "ignore")) for r in docs.collect())
    assert texts == expected
    assert kept.filter("text is null").count() == docs.filter("text is null").count()
    assert suffix.remove(empty).count() == 0


@pytest.mark.parametrize("letters", [b"ab", b"abc\0\xff", b"a"])
def test_deep_shallow_sorts(letters):
    draw = random.Random(len(letters))
    data = bytes(draw.choice(letters) for _ in range(300)) * 2 + bytes(draw.choice(b"ab") for _ in range(200))
    buffer = data + b"\0" * 60
    starts = np.array(draw.sample(range(len(data) - 50), 500))
    order, same = suffix.deep_shallow(buffer, starts, 50)
    keys = [buffer[s : s + 50] for s in starts[order]]
    assert keys == sorted(buffer[s : s + 50] for s in starts)
    assert same.tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]
    assert sorted(order.tolist()) == list(range(500))


def test_equal_windows_have_equal_anchors():
    draw = random.Random(9)
    window = bytes(draw.choice(b"abcdef") for _ in range(50))
    seen = set()
    for _ in range(20):
        left = bytes(draw.choice(b"abcdef") for _ in range(draw.randrange(80)))
        right = bytes(draw.choice(b"abcdef") for _ in range(draw.randrange(80)))
        _, _, start, size, h = suffix.segments([(0, left + window + right)], 50)
        (k,) = [k for k in range(len(start)) if start[k] <= len(left) <= start[k] + size[k] - 50]
        seen.add(int(h[k]))
    assert len(seen) == 1


@pytest.mark.parametrize("length", [16, 20, 50, 150, 300])
def test_lengths(spark, length):
    draw = random.Random(length)
    shared = [bytes(draw.choice(b"abcd\0") for _ in range(n)) for n in (length - 1, length, 3 * length)]
    rows = []
    for k in range(24):
        text = bytes(draw.choice(b"efgh") for _ in range(draw.randrange(0, 2 * length)))
        rows.append((k, text + draw.choice(shared) + text[: length // 2] + b"z" * draw.choice([0, 2 * length])))
    want = brute(rows, length)
    found = suffix.report(spark.createDataFrame([(k, t.decode()) for k, t in rows], "doc_id long, text string").repartition(5), length=length).collect()
    assert sorted(tuple(r) for r in found) == sorted((k, *want[k, t][:4]) for k, t in rows)
    assert sum(r.n_removed for r in found)


def test_lengths_out_of_bounds(docs):
    for length in (0, 15, 30_001):
        with pytest.raises(ValueError):
            suffix.report(docs, length=length)


@pytest.mark.parametrize("texts", [[None], ["short", ""], ["\0" * 100, "\0" * 100], ["a" * 49, "b" * 60]])
def test_blocks_with_few_anchors(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    want = brute([(k, (t or "").encode()) for k, t in rows], 50)
    found = suffix.report(spark.createDataFrame(rows, "doc_id long, text string"), length=50).collect()
    assert sorted(tuple(r) for r in found) == sorted((k, *want[k, (t or "").encode()][:4]) for k, t in rows)


def test_word_order_is_stable():
    draw = np.random.default_rng(3)
    for key in (draw.integers(0, 50, 20_000), draw.integers(0, 1 << 60, 30_000), np.repeat(draw.integers(0, 9, 300), 70)):
        assert (suffix.word_order(key.astype(np.uint64), 100, 16) == np.argsort(key, kind="stable")).all()
