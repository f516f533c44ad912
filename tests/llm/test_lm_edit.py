import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import editfp, lm


def tokens(text):
    return [*(text or "").encode().translate(lm._LOWER).split(), None]


@pytest.mark.parametrize(("block", "order"), [(2000, 2), (1 << 20, 2), (4000, 3), (1 << 20, 1)])
def test_scores_equal_brute_force(docs, empty, monkeypatch, block, order):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "PER_RANGE", 4 * block)
    rows = [(r.doc_id, tokens(r.text)) for r in docs.collect()]
    fold = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 for i, _ in rows}

    def grams(t, k):
        """The k-gram that ends at each token; "start" stands before the first."""
        padded = ["start"] * (k - 1) + t
        return [tuple(padded[j : j + k]) for j in range(len(t))]

    def counted(keep):
        found, n = [Counter() for _ in range(order)], 0
        for i, t in rows:
            if keep(fold[i]):
                for k in range(order):
                    found[k].update(grams(t, k + 1))
                n += 1
        return found, sum(found[0].values()), n

    everything, heldout = counted(lambda f: f != 2), counted(lambda f: f not in (2, 6))
    total, types = everything[1], len(everything[0][0])

    def estimates(t, j, model):
        """Of the highest order first, and how often the highest order's context was seen."""
        found, tokens_, n = model
        out, seen = [], tokens_
        for k in range(order):
            gram = grams(t, k + 1)[j]
            if k:
                # the context is the gram before; at the start of a text it is the start itself
                seen = n if j == 0 else found[k - 1][grams(t, k)[j - 1]]
            out.append(found[k][gram] / seen if seen else 0.0)
        return out[::-1], seen

    cells = Counter()
    step = lambda e: round(4 * math.log2(e * (types + 1))) if e else -(10**6)
    for i, t in rows:
        if fold[i] == 6:
            for j in range(len(t)):
                own, seen = estimates(t, j, heldout)
                cells[(seen.bit_length(), *map(step, own))] += 1
    weights = lm.learn([(c[0], c[1:], k) for c, k in sorted(cells.items())], order)
    assert np.allclose(weights.sum(axis=1), 1)
    want = []
    for i, t in rows:
        base = sum(math.log10((everything[0][0][w,] + 1) / (total + types + 1)) for w in t)
        s = 0.0
        for j in range(len(t)):
            own, seen = estimates(t, j, everything)
            x = weights[seen.bit_length()]
            s += math.log10(sum(a * b for a, b in zip(x, own)) + x[-1] / (types + 1))
        want.append((-1 if i is None else i, fold[i] == 2, len(t), sum(everything[0][0][w,] > 0 for w in t), total, round(base, 6), round(s, 4)))
    found = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in lm.score(docs, order=order).collect()]
    assert sorted(found) == sorted(want)
    assert lm.score(empty).count() == 0


def test_em_finds_the_mixture():
    draw = np.random.default_rng(4)
    # one estimate is right in 7 of 10 tokens and gives 0 otherwise; the other always gives a little
    cells = [(3, (40, 8), int(x)) for x in draw.multinomial(1000, [1.0])] + [(3, (-(10**6), 8), 430)]
    w = lm.learn(cells, 2)[3]
    assert 0.6 < w[0] < 0.8 and abs(w.sum() - 1) < 1e-9


def test_counts_beyond_32_bits():
    x = np.array([5, (1 << 32) + 5, 0])
    assert (lm._widened(lm._narrow(x)) == x).all() and (lm._widened(lm._narrow(x[:1])) == x[:1]).all()
    assert len(lm._widened(lm._narrow(x[:0]))) == 0


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edits_equal_brute_force(docs, ranges):
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in unique.collect()), reverse=True)
    following = {i: rows[(k + 1) % len(rows)][1] for k, (i, _) in enumerate(rows)}
    own = dict(rows)
    found = editfp.with_edits(unique, ranges=ranges).collect()
    assert len(found) == len(rows)
    for r in found:
        t, f = own[r.doc_id], following[r.doc_id]
        e = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        prints = editfp.embed([t, e, f])
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert [r.fingerprint, r.edited_fingerprint] == [p.hex() for p in prints[:2]]
        assert (r.near_edited, r.near_next) == (editfp.likeness(prints[0], prints[1]), editfp.likeness(prints[0], prints[2]))


def test_edits_with_null_and_repeated_ids(spark, docs, empty):
    assert editfp.with_edits(docs).count() == docs.count()
    assert editfp.with_edits(empty).count() == 0
    # a third of the rows without an id and a third with one id, over several ranges
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text number {k} " * 5) for k in range(90)]
    found = editfp.with_edits(spark.createDataFrame(rows, "doc_id long, text string"), ranges=12).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    texts = {}
    for r in found:
        texts.setdefault(r.doc_id, []).append(r.edited_sha256)
    assert {k: len(v) for k, v in texts.items()} == {k: sum(r[0] == k for r in order) for k in {r[0] for r in order}}
    # every text is the next of one: each edit holds the first characters of another text, and none of them twice
    heads = {hashlib.sha256((t[: len(t) - len(t) // 3] + f[: len(t) // 3]).encode()).hexdigest(): f for _, t in rows for _, f in rows}
    assert sorted(heads[r.edited_sha256][: 30] for r in found) == sorted(t[:30] for _, t in rows)


def walked(text):
    """The fingerprint by walking one step at a time."""
    table, emitted, j = editfp.walk_table(), [], 0
    for k, ch in enumerate(text):
        c = ord(ch)
        wait = int(table[(c & 255) ^ (c >> 8 & 255), j % editfp.PERIOD])
        emitted += [(c << 21) | (ord(text[k + 1]) if k + 1 < len(text) else 0)] * wait
        j += wait
    if not emitted:
        return bytes(editfp.SLOTS)
    out = []
    for places in editfp.sample_places():
        place = max(int(p) for p in places if p < len(emitted))
        x = np.array([place], np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(emitted[place])
        out.append(int(editfp._mixed(x)[0] % np.uint64(255)) + 1)
    return bytes(out)


@pytest.mark.parametrize("together", [1, 64])
def test_embedding_equals_a_plain_walk(texts, monkeypatch, together):
    monkeypatch.setattr(editfp, "TOGETHER", together)
    given = [t or "" for t in texts]
    assert editfp.embed(given) == [walked(t) for t in given]
    assert editfp.embed(given[::-1]) == editfp.embed(given)[::-1]
    assert editfp.likeness(*editfp.embed(["", ""])) == 1.0 and editfp.embed([]) == []


def test_places_are_uniform():
    for length in (3, 50, 1000):
        seen = Counter()
        for seed in range(60):
            seen.update(int(p[np.searchsorted(p, length) - 1]) * 4 // length for p in editfp.sample_places(seed, 1 << 12))
        if length >= 50:
            assert all(0.8 < seen[q] / (60 * editfp.SLOTS / 4) < 1.2 for q in range(4))


def test_a_million_characters_take_seconds():
    draw = random.Random(6)
    text = "".join(draw.choices("abcdefgh ", k=1_000_000))
    began = time.time()
    a, b = editfp.embed([text, text[:400_000] + "x" + text[400_001:]])
    assert time.time() - began < 8 and editfp.likeness(a, b) > 0.9


@pytest.mark.parametrize("bucket", [4096, 6])
def test_classes_have_recall(spark, bucket):
    """Links by bands against all pairs of fingerprints, and all classes of those links."""
    draw = random.Random(12)
    base = ["".join(draw.choices("abcdefghijklmnop ", k=draw.randrange(200, 600))) for _ in range(40)]
    texts = list(base)
    for t in base:
        for _ in range(4):
            at = draw.randrange(len(t))
            texts.append(t[:at] + "".join(draw.choices("xyz", k=draw.randrange(1, 8))) + t[at + draw.randrange(6) :])
    texts += ["", "a", "a b", "ab c"] * 3
    prints = editfp.embed(texts)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if editfp.likeness(prints[i], prints[j]) >= 0.8]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(prints)], "doc_id long, print binary")
    of = {bytes(r["print"]): r.class_id for r in editfp.class_ids(rows, bucket=bucket).collect()}
    together = sum(of[prints[i]] == of[prints[j]] for i, j in linked)
    assert len(linked) > 100 and together >= 0.99 * len(linked)
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        x, y = find(i), find(j)
        parent[max(x, y)] = min(x, y)
    for i in range(len(texts)):  # nothing is connected that no chain of links connects
        assert find(of[prints[i]]) == find(i)


def test_a_hot_band_costs_rows_in_proportion(spark, monkeypatch):
    """Fingerprints of which most agree in most slots, near ones among them: no link is lost, and pairs of blocks are not needed."""
    draw = np.random.Generator(np.random.PCG64(3))
    head = draw.integers(1, 256, 45, dtype=np.uint8)
    rows, near = [], []
    for k in range(3000):
        own = np.concatenate([head, draw.integers(1, 256, 19, dtype=np.uint8)])
        rows.append(own)
        if k % 10 == 0:  # a copy with twelve other slots is near, one with thirteen is not
            for changed in (12, 13):
                copy = own.copy()
                at = draw.choice(64, changed, replace=False)
                copy[at] = copy[at] % 255 + 1
                near.append((len(rows) - 1, len(rows))) if changed == 12 else None
                rows.append(copy)
    prints = np.stack(rows)
    df = spark.createDataFrame([(k, bytes(p)) for k, p in enumerate(prints)], "doc_id long, print binary").repartition(6)
    dealt = []
    whole = editfp.spread_join
    monkeypatch.setattr(editfp, "spread_join", lambda left, *a, **k: (dealt.append(left.count()) if "key" in left.columns else None, whole(left, *a, **k))[1])
    of = {bytes(r["print"]): r.class_id for r in editfp.class_ids(df, bucket=256).collect()}
    assert all(of[bytes(prints[i])] == of[bytes(prints[j])] for i, j in near)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero((prints[:i] == prints[i]).sum(axis=1) >= 52).tolist():
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    assert [of[bytes(p)] for p in prints] == [find(k) for k in range(len(rows))]
    assert len(dealt) > 1 and dealt[1] <= 13 * 13 * len(rows)


def test_a_hot_key_of_copies_is_one_class(spark):
    draw = np.random.Generator(np.random.PCG64(4))
    base = draw.integers(1, 256, 64, dtype=np.uint8)
    prints = set()
    for _ in range(500):
        p = base.copy()
        at = draw.choice(12, 3)  # within the same twelve slots
        p[at] = draw.integers(1, 256, 3)
        prints.add(bytes(p))
    df = spark.createDataFrame([(k, p) for k, p in enumerate(sorted(prints))], "doc_id long, print binary").repartition(4)
    assert {r.class_id for r in editfp.class_ids(df, bucket=20).collect()} == {0}
