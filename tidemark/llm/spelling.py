"""Spelling variants: a trie self-join of a corpus' vocabulary with active-node sets, at an edit distance of one.

Words that differ by one inserted, deleted or replaced code point first differ at some place `i` and agree behind it. The
places are halved: for the longer word's length c, a pair whose place lies in [lo, hi) shares the prefix of lo code points
and the suffix behind hi. So the vocabulary is dealt into partitions of (c, lo, hi, prefix, suffix), each the part of the
trie below one prefix, cut off where its words agree again: a word goes to four of them, whatever their number. Partitions
with more than `bound` open code points are halved again, until at [i, i + 1) only an alphabet is left; so no partition
grows with the vocabulary and no pair is lost.

Within a partition one task builds the trie of the open parts and walks it down. Each node has its set of active nodes,
those at a distance of nought (itself) or one; a child's set comes from its parent's by a match, a replacement or an
insertion. Where a word's end meets an active word's end at distance one, they are a pair. The first step after an
insertion must differ from what was inserted, so each pair has one way to be found.

A word's form is its near word of the largest count (ties: the smallest by code point), if that is `ratio` times its own or
more; counts rise along forms, so following them ends, and roots are found by doubling steps.

Null text has no words. Equal rows count twice. A null id counts as an empty one (it matters for `typos` only). An empty
table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Table, cut, discard, spread_join

LETTERS = "A-Za-zÀ-ÿ"
_RUN, _OTHER = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOWER = {k: k + 32 for k in range(65, 91)}
#: Code points of a text looked at at once, and of distinct words that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 1 << 22
#: Open code points of a partition; at least two alphabets' product, so that halving ends.
BOUND = 1 << 17


def runs_of(text: str) -> Counter:
    """How often a text has each run of letters, A-Z lower-cased."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        stop = _OTHER.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = stop.start() if stop else len(text)
        found.update(_RUN.findall(text, at, end))
        at = end
    low: Counter = Counter()
    for w, n in found.items():
        low[w.lower() if w.isascii() else w.translate(_LOWER)] += n
    return low


def counts(df: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = 5, typos: int | None = None) -> DataFrame:
    """(word, n), combined within tasks only. With `typos`, one run of a document in so many loses a code point, by crc32 of `id:run`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        total: dict[str, int] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = crc32(f"{d}:".encode())
                for w, n in runs_of(t.as_py() or "").items():
                    if typos:
                        h = crc32(w.encode(), before)
                        if h % typos == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                    if len(w) >= least_length:
                        if w in total:
                            total[w] += n
                        else:
                            total[w] = n
                            held += len(w)
                if held > HELD:
                    yield flush()
                    held = 0
        yield flush()

    rows = df.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long")


def group_pairs(ids: list[int], mids: list[str], longs: list[bool], width: int) -> list[tuple[int, int]]:
    """The pairs at distance one of a partition: of two long words, or of a long and a short one.

    mids: the words' code points lo to hi. Those of a long word are all open; of a short one the last belongs to what
    follows, and a long word with the same ones differs from it behind hi, in another partition.
    """
    root: tuple[dict, list] = ({}, [])
    for i, mid, long in zip(ids, mids, longs, strict=True):
        node = root
        for c in mid if long else mid[: width - 1]:
            node = node[0].setdefault(c, ({}, []))
        node[1].extend((i, mid, long))
    found = []
    stack = [(root, [(root, 0, "")])]
    while stack:
        node, active = stack.pop()
        if node[1] and node[1][2]:
            i, mid, _ = node[1]
            for v, d, _ in active:
                if d and v[1]:
                    j, other, long = v[1]
                    if i < j if long else other != mid:
                        found.append((i, j))
        for c, child in node[0].items():
            below = []
            for v, d, barred in active:
                if c != barred and c in v[0]:
                    below.append((v[0][c], d, ""))
                if not d:
                    below.extend((w, 1, "") for e, w in v[0].items() if e != c)
                    below.append((v, 1, c))
            stack.append((child, below))
    return found


def _dealt(words: DataFrame, intervals: Column) -> DataFrame:
    """(id, word, c, lo, hi, key, mid, long): words in the partitions of their intervals, an array of (c, lo, hi)."""
    at = words.select("id", "word", F.explode(intervals).alias("x")).select("id", "word", "x.*")
    size = F.char_length("word")
    suffix = F.substring(F.col("word"), F.col("hi") + 1 - (F.col("c") - size), size)
    parts = [F.col("c"), F.col("lo"), F.col("hi"), F.substring(F.col("word"), F.lit(1), F.col("lo")), suffix]
    key = F.struct(F.xxhash64(*parts).alias("h"), F.xxhash64(F.lit(1), *parts).alias("g"))
    return at.withColumns({"key": key, "mid": F.substring(F.col("word"), F.col("lo") + 1, F.col("hi") - F.col("lo")), "long": size == F.col("c")})


def _halves(c: Column, lo: Column, hi: Column) -> list[Column]:
    middle = F.floor((lo + hi) / 2).cast("int")
    return [F.struct(c.alias("c"), a.alias("lo"), b.alias("hi")) for a, b in ((lo, middle), (middle, hi))]


def near_pairs(words: DataFrame, bound: int = BOUND) -> DataFrame:
    """Distinct words (id, word) -> (a, b): the ids of each pair at an edit distance of one, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, mids, longs, width in zip(*batch.columns, strict=True):
                found = group_pairs(ids.as_py(), mids.as_py(), longs.as_py(), width.as_py())
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    size = F.char_length("word").cast("int")
    first = F.array(*[half for c in (size, size + 1) for half in _halves(c, F.lit(0), c)])
    dealt = _dealt(words, first)
    pairs, before = None, None
    while True:
        groups = dealt.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.char_length("mid")).alias("open"), F.max("long").alias("any"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        shared = cut(groups.filter("n > 1 and any").select(F.col("key").alias("on"), "n", "open", "width"))
        total = shared.agg(F.sum("n"), F.count_if((F.col("open") > bound) & (F.col("width") > 1))).first()
        met = spread_join(dealt, shared.select("on", "open", "width"), "key", shared, total[0] or 0)
        whole = (F.col("open") <= bound) | (F.col("width") == 1)
        listed = met.filter(whole).groupBy("key").agg(*[F.collect_list(x).alias(x) for x in ("id", "mid", "long")], F.max("width").alias("width"))
        found = cut(listed.select("id", "mid", "long", "width").mapInArrow(run, "a long, b long"))
        pairs = pairs.unionByName(found) if pairs else found
        open_ = cut(met.filter(~whole).select("id", "word", "c", "lo", "hi")) if total[1] else None
        for done in (shared, before):
            if done:
                discard(done)
        if not open_:
            return pairs
        before = open_
        dealt = _dealt(open_.select("id", F.struct("word", "c", "lo", "hi").alias("w")).select("id", "w.word", "w"), F.array(*_halves(F.col("w.c"), F.col("w.lo"), F.col("w.hi"))))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, form) -> (id, root): where following forms ends; each round doubles the steps."""
    now = cut(forms.select("id", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("id").alias("at"), F.col("root").alias("next"))
        after = cut(now.join(on, F.col("root") == F.col("at"), "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = after.select("id", "root")
        if after.filter("moved").isEmpty():
            return now
        now = cut(now)
        discard(after)


def variants(
    df: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    least_length: int = 5,
    least_count: int = 3,
    ratio: float = 2,
    typos: int | None = None,
    bound: int = BOUND,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of `least_length` code points and `least_count` occurrences or more."""
    many = counts(df, id, text, least_length, typos).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)
    words = Table(many.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words").read()
    pairs = near_pairs(words.select("id", "word"), bound)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form", "form_n", F.col("b").alias("form_id"))).alias("best")
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    taken = F.when(F.col("best.form_n") >= ratio * F.col("n"), F.col("best"))
    formed = cut(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), taken.alias("best")))
    formed = formed.select("id", "word", "n", "n_near", "best.form", "best.form_n", "best.form_id")
    roots = _roots(formed.filter("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = roots.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return formed.join(named, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))
