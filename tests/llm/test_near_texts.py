"""Near dedup on texts that differ in one long part."""

import random

import pytest

from tidemark.llm import simhash

DRAW = random.Random(17)
WORDS = ["".join(DRAW.choice("abcdefghij") for _ in range(DRAW.randrange(2, 9))) for _ in range(5000)]


def some(n):
    return [WORDS[int(len(WORDS) ** DRAW.random()) - 1] for _ in range(n)]


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a, b))
    return len(x & y) / len(x | y)


def changed(words, kind):
    n = int(len(words) * DRAW.uniform(0.12, 0.28))
    if kind == "appended":
        return words + some(n)
    if kind == "truncated":
        return words[: -int(0.85 * n)]
    at = DRAW.randrange(len(words))
    return words[:at] + some(n) + words[at:]


@pytest.mark.parametrize("kind", ["appended", "truncated", "inserted"])
@pytest.mark.parametrize("bucket", [4096, 1])
def test_texts_with_a_changed_part_meet(spark, kind, bucket):
    texts = []
    for _ in range(200 if bucket > 1 else 40):
        words = some(DRAW.randrange(100, 800))
        texts.append((words, changed(words, kind)))
    rows = [(2 * k + side, " ".join(pair[side])) for k, pair in enumerate(texts) for side in (0, 1)]
    found = {r.doc_id: r.component_id for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket).collect()}
    assert sum(0.8 <= jaccard(*p) < 0.85 for p in texts) > len(texts) / 10
    assert sum(jaccard(*p) < 0.8 for p in texts) > len(texts) / 20
    for k, pair in enumerate(texts):
        assert (found[2 * k + 1] == found[2 * k]) == (jaccard(*pair) >= 0.8), jaccard(*pair)


def test_stars_are_exact():
    words = [f"w{k}" for k in range(14)]  # 10 shingles
    texts = [words, words[2:], words[3:], words[5:]]  # 10, 8, 7 and 5 of them
    shingles = [simhash.word_prints(" ".join(t))[2] for t in texts]
    assert sorted(simhash.similar_stars([5, 3, 9, 1], shingles, 0.8)) == [(5, 3), (9, 3)]


def test_fingerprints_link_as_in_op3_beside_the_shingles(spark):
    """Texts whose fingerprints are 3 bits apart or less are one class in the pipeline's stage, though their five-word shingles differ."""
    import random

    draw, near = random.Random(3), None
    while near is None:
        words = [draw.choice("abcdefgh") * draw.randrange(1, 4) for _ in range(400)]
        other = list(words)
        for k in range(0, 400, 20):
            other[k] = "new"
        a, b = " ".join(words), " ".join(other)
        if ((simhash.simhash(a) ^ simhash.simhash(b)) & (1 << 64) - 1).bit_count() <= 3:
            near = (a, b)
        cut = lambda w: {tuple(w[k : k + 5]) for k in range(396)}
        assert len(cut(words) & cut(other)) < 0.8 * len(cut(words) | cut(other))
    df = spark.createDataFrame([(1, near[0]), (2, near[1]), (3, "quite another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_each(df, radius=3).collect()) == [1, 3]
    assert simhash.one_each(df).count() == 3
