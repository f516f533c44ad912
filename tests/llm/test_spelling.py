import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(rows, least_length=5, least_count=3, ratio=2, typos=None):
    found = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if typos and h % typos == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                found[w] += 1
    n = {w: c for w, c in found.items() if c >= least_count}
    about = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in about.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(about[w]), form.get(w, ""), n[form[w]] if w in form else -1, root(w)) for w in n)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", -1 if r.form_n is None else r.form_n, r.root) for r in df.collect())


def vocabulary(draw):
    """Words with all kinds of neighbours: runs of one letter, edits of edits, alphabets at one place, accents."""
    letters = "abcdeéÿA"
    words = {"a" * k for k in range(4, 30)} | {"ab" * k for k in range(2, 12)} | {f"stem{c}" for c in letters} | {f"{c}stem" for c in letters}
    for _ in range(150):
        w = "".join(draw.choice("abé") for _ in range(draw.randrange(5, 14)))
        for _ in range(4):
            words.add(w)
            k = draw.randrange(len(w) + 1)
            w = draw.choice([w[:k] + draw.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + draw.choice(letters) + w[k + 1 :]])
    long = "".join(draw.choice(letters) for _ in range(3000))
    return sorted(words | {long, long[:1700] + "b" + long[1700:], long[:9] + long[10:], long[:-1] + "c"})


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(9)
    words = vocabulary(draw)
    texts = [" ".join(w for w in words for _ in range(draw.choice([0, 1, 1, 2, 5]))) for _ in range(6)]
    return [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (2, texts[2]), (7, None), (8, ""), (9, "12 Multiplication×sign, don't_stop; Œuvre")]


@pytest.mark.parametrize("bound, typos", [(1 << 17, None), (16, None), (100, 7), (1 << 17, 97)])
def test_words_equal_brute_force(spark, rows, bound, typos):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(spelling.variants(df, bound=bound, typos=typos)) == brute(rows, typos=typos)


def test_clashing_columns_and_no_words(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(spelling.variants(docs, least_length=3, least_count=2, ratio=1.5)) == brute(rows, 3, 2, 1.5)
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).count() == 0


def test_long_texts_are_taken_in_pieces(monkeypatch):
    text = " ".join("word" * (k % 40) + "É1" * (k % 3) for k in range(500))
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "PIECE", 37)
    assert spelling.runs_of(text) == whole and sum(whole.values()) > 500


def test_roots_of_a_long_chain(spark):
    forms = spark.createDataFrame([(k, k + 1) for k in range(37)] + [(100, 5)], "id long, form long").repartition(4)
    assert {r.id: r.root for r in spelling._roots(forms).collect()} == dict.fromkeys([*range(37), 100], 37)
