import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import graph, simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x.decode() for x in low.encode().split()]
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[k : k + 3]).encode(), seed=42).intdigest() for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_classes_equal_brute_force(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    given = docs.select("doc_id", "text").collect()
    prints = {fingerprint(r.text) for r in given}
    of = classes(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r in given:
        if r.doc_id is not None:
            root = of[fingerprint(r.text)]
            least[root] = min(least.get(root, r.doc_id), r.doc_id)
    want = sorted((r.doc_id if r.doc_id is not None else -1, fingerprint(r.text), least[of[fingerprint(r.text)]]) for r in given)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in rows) == want
    assert simhash.near_duplicates(empty).count() == 0


def test_masks_cover_every_small_difference():
    masks = simhash.covering_masks(3)
    draw = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(m & bits == 0 for m in masks)
    assert len(masks) == 15


@pytest.mark.parametrize("bucket", [1, 8192])
def test_large_buckets_lose_no_link(spark, bucket):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(3)]
    fps = {b ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(0, 4))) for b in base for _ in range(12)}
    of = classes(sorted(simhash._signed(x & (2**64 - 1)) for x in fps), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    df = spark.createDataFrame([(x,) for x in of], "fp long")
    found = {r.node: r.root for r in graph.connected_components(simhash.links(df, 3, bucket)).collect()}
    assert {n: found.get(n, n) for n in of} == of


@pytest.mark.parametrize("held", [0, 7, 1 << 18])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    draw = random.Random(3)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(7, 7), (None, 3)]
    of = classes(range(60), lambda a, b: (a, b) in edges or (b, a) in edges)
    found = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: found.get(n, n) for n in range(60)} == of


def shingles(text):
    w = (text or "").lower().encode().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("bucket", [4, 4096])
def test_near_texts_against_jaccard(docs, empty, bucket):
    found = {(r.doc_id, r.component_id) for r in simhash.near_texts(docs, bucket=bucket).collect()}
    component = dict(found)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    similar = []
    for a in rows:
        for b in rows:
            x, y = shingles(a.text), shingles(b.text)
            j = len(x & y) / len(x | y)
            if j >= 0.85:
                similar.append(component[a.doc_id] == component[b.doc_id])
            if j == 1:
                assert similar[-1], (a.text, b.text)
            if a.doc_id < b.doc_id and component[a.doc_id] == component[b.doc_id]:
                assert j > 0.5
    assert sum(similar) >= 0.98 * len(similar)
    kept = simhash.one_each(docs, bucket=bucket)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for d, c in found if d is not None})
    assert ids.count(None) == 1
    assert simhash.one_each(empty).count() == 0


def test_one_each_tells_rows_apart_by_text(spark):
    draw = random.Random(4)
    a, b, c, d = (" ".join(draw.choice("abcdefghijklmnop") * 3 + str(draw.randrange(500)) for _ in range(80)) for _ in range(4))
    rows = [(1, a, "x"), (5, a + " more", "x"), (5, b, "x"), (7, c, "x"), (7, d, "x"), (7, d, "y"), (9, b, "z"), (None, a, "n")]
    kept = simhash.one_each(spark.createDataFrame(rows, "doc_id long, text string, gone_id string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a), (5, b), (7, c), (7, d), (0, a)])


@pytest.mark.parametrize("held", [0, 1 << 18])
def test_hub_of_a_star(spark, monkeypatch, held):
    monkeypatch.setattr(graph, "HELD", held)
    monkeypatch.setattr("tidemark.llm.shared.HOT", 20)
    edges = spark.createDataFrame([(0 if k % 2 else 500, k) for k in range(1, 400)] + [(7, 500)], "a long, b long")
    found = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert found == {n: 0 for n in [*range(400), 500]}


def test_stars_join_a_component():
    fps = [0, 1, 3, 7, 15, 7 << 40, -1 << 63]
    assert sorted(simhash.bucket_stars(np.array(fps), 1)) == [(0, -1 << 63), (1, -1 << 63), (3, -1 << 63), (7, -1 << 63), (15, -1 << 63)]
