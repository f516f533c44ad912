"""Language-model scoring by deleted interpolation.

p(w | context) mixes the maximum-likelihood estimates of orders n to 1 and a uniform floor. Which weights are used
depends on how often the context of order n was seen: contexts are put into buckets by the power of two of their
frequency, and each bucket has weights of its own, learned by expectation-maximisation on counts held out of the
training documents. The final estimates then use all training documents.

How it is laid out over the cluster:

1. Documents are cut into blocks of bounded size, one pass over the text: per block the distinct words' hashes and
   the documents as numbers into them, compressed, written once as a table. Held-out documents have blocks of
   their own.
2. Every block asks for the counts of its distinct n-grams (64-bit hashes, so a frequent n-gram costs one entry a
   block), dealt out by hash range; a range adds up what all blocks hold and answers each. Answers are a table.
3. Held-out blocks meet their answers and give a histogram of (context bucket, estimates in steps of a quarter of
   a power of two), which has a bounded number of cells whatever the input; the weights are learned from it.
4. All blocks meet their answers and score their documents.

Words are lower-cased (A-Z) runs without ASCII white space, and each document has one end token. Null text counts
as empty: the end token only. A null id counts as the empty text in the choice of folds, and is kept. Repeated
rows are documents of their own. An empty table gives an empty result, and without any training document every
token has the floor's probability, 1. Very long texts are taken whole: a document's own size bounds its block.
Other columns of the input are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Table, cut

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of text in a block and for which there is a range of hashes.
BLOCK, PER_RANGE = 8 << 20, 8 << 20
#: Beyond so many ranges a task takes several, one after the other.
MOST_TASKS = 20_000
#: Local numbers 0 and 1 of every block: start of text and end of text.
START, END = 0, 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
STEPS = 4  # of the histogram, in a power of two


@dataclass(frozen=True)
class Model:
    """Weights by context bucket, highest order first, the uniform floor last; totals of the training documents."""

    order: int
    tokens: int
    types: int
    documents: int
    weights: np.ndarray = field(repr=False)


def fold(doc_id, folds: int = 7) -> int:
    """The document's fold: CRC-32 of its id as text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [a.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = struct.unpack_from(f"<{len(kinds)}q", raw)
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of numbers, all lowest bytes first: the high ones compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view("u1").reshape(-1, 8).T)


def _from_planes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel()


class Builder:
    """A block under construction."""

    def __init__(self):
        self.known = defaultdict(count(2).__next__)
        self.ids: list = []
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, doc_id, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        words = data.translate(_LOWER).split()
        self.parts.append(np.array([*map(self.known.__getitem__, words), END], np.uint32))
        self.ids.append(doc_id)
        self.sizes.append(len(words) + 1)
        self.bytes += len(data)

    def packed(self) -> bytes:
        from xxhash import xxh64_intdigest

        words = np.array([0, 0, *map(xxh64_intdigest, self.known)], "<u8")
        null = np.array([i is None for i in self.ids], "u1")
        ids = np.array([i or 0 for i in self.ids], "<i8")
        return _pack(words, np.concatenate(self.parts).astype("<u4"), np.array(self.sizes, "<i8"), ids, null)


class Block:
    """The n-grams of a packed block."""

    def __init__(self, data: bytes):
        self.words, self.tokens, self.sizes, self.ids, self.null = _unpack(data, "<u8", "<u4", "<i8", "<i8", "u1")
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)

    def names(self) -> list:
        return [None if n else i for i, n in zip(self.ids.tolist(), self.null.tolist(), strict=True)]

    def grams(self, order: int) -> np.ndarray:
        """The 64-bit hash of the n-gram that ends at each token; starts of texts stand before the first."""
        salt = self.words.copy()
        salt[START], salt[END] = 0x51ED270B, 0x2545F491  # never the hash of a word but by chance
        own = salt[self.tokens]
        x = np.full(len(own), order, np.uint64)
        for back in range(order - 1, -1, -1):
            if back:
                part = np.concatenate([np.zeros(min(back, len(own)), np.uint64), own[:-back]])
                part[self.place < back] = salt[START]
            else:
                part = own
            x = (x ^ part) * _A
            x ^= x >> np.uint64(32)
            x *= _B
            x ^= x >> np.uint64(29)
        return x


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each 64-bit key; not decreasing with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Counts as bytes: their width, 4 or 8, then the numbers in it."""
    kind = "<u4" if not len(x) or int(x.max()) < 1 << 32 else "<u8"
    return np.concatenate([np.array([np.dtype(kind).itemsize], "u1"), x.astype(kind).view("u1")])


def _widened(raw: np.ndarray) -> np.ndarray:
    return np.frombuffer(raw[1:].tobytes(), f"<u{int(raw[0])}").astype(np.int64)


def _asked(block: Block, order: int, n: int, role: int) -> Iterator[tuple[int, bytes]]:
    """(range, packed keys and counts by order): counts are 0 unless the block trains (role 1) or is held out (role 2)."""
    found = [np.unique(block.grams(k), return_counts=True) for k in range(1, order + 1)]
    parts = [ranges_of(keys, n) for keys, _ in found]
    used = np.unique(np.concatenate(parts))
    edges = [(np.searchsorted(p, used, "left"), np.searchsorted(p, used, "right")) for p in parts]
    for k, r in enumerate(used.tolist()):
        arrays = []
        for (keys, counts), (left, right) in zip(found, edges, strict=True):
            part = keys[left[k] : right[k]]
            arrays += [_planes(np.diff(part, prepend=np.uint64(0))), (counts[left[k] : right[k]] * (role > 0)).astype("<u4")]
        yield r, _pack(*arrays)


def _answered(asked: list[tuple[int, int, bytes]], order: int) -> tuple[list[tuple[int, bytes]], int, int, int]:
    """Answers to the (block, role, packed) of one range: (block, packed totals); types, tokens and tokens not held out among unigrams."""
    kinds = ["u1", "<u4"] * order
    parts = [_unpack(data, *kinds) for _, _, data in asked]
    sums: list[list[np.ndarray]] = [[] for _ in asked]
    types = tokens = kept = 0
    for k in range(order):
        keys = [np.cumsum(_from_planes(p[2 * k]), dtype=np.uint64) for p in parts]
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(x) for x in keys])
        size = int(number.max()) + 1 if len(number) else 0
        main, held = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for p, (_, role, _), a, b in zip(parts, asked, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if role:
                (main if role == 1 else held)[number[a:b]] += p[2 * k + 1]
        if k == 0:
            types, kept = int((main + held > 0).sum()), int(main.sum())
            tokens = kept + int(held.sum())
        for place, a, b in zip(range(len(asked)), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            sums[place] += [_narrow(main[number[a:b]]), _narrow(held[number[a:b]])]
    return [(block, _pack(*s)) for (block, _, _), s in zip(asked, sums, strict=True)], types, tokens, kept


def _counts(block: Block, answers: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(main, held) counts of the n-gram that ends at each token, by order."""
    parts = [_unpack(a, *["u1"] * (2 * order)) for a in answers]
    out = []
    for k in range(order):
        _, number = np.unique(block.grams(k + 1), return_inverse=True)
        main, held = (np.concatenate([_widened(p[2 * k + j]) for p in parts]) for j in (0, 1))
        out.append((main[number], held[number]))
    return out


def _estimates(block: Block, counts: list[np.ndarray], tokens: int, documents: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Maximum-likelihood estimates of the highest order to the first, and how often the highest order's context was seen."""
    first = block.place == 0
    found, seen = [], np.full(len(block.tokens), tokens)
    for k, c in enumerate(counts):
        if k == 0:
            context = np.full(len(c), tokens)
        else:
            context = np.concatenate([[0], counts[k - 1][:-1]]) if len(c) else c
            context = np.where(first, documents, context)
        found.append(np.divide(c, context, out=np.zeros(len(c)), where=context > 0))
        seen = context
    return found[::-1], seen


def context_bucket(seen: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the whole part of its frequency's binary logarithm."""
    return np.where(seen > 0, np.frexp(np.maximum(seen, 1).astype(np.float64))[1], 0)


def learn(cells: list[tuple[int, tuple[int, ...], int]], order: int, rounds: int = 60, floor: float = 1e-6) -> np.ndarray:
    """Weights [bucket, component] by expectation-maximisation over histogram cells (bucket, steps of each order's estimate over the floor, count).

    A step of -10**6 stands for an estimate of 0. Buckets without a cell get the weights of all cells together.
    """
    buckets = np.array([c[0] for c in cells], np.int64)
    steps = np.array([c[1] for c in cells], np.float64).reshape(len(cells), order)
    n = np.array([c[2] for c in cells], np.float64)
    p = np.concatenate([np.where(steps > -(10**5), np.exp2(np.maximum(steps, -4000) / STEPS), 0.0), np.ones((len(cells), 1))], axis=1)

    def em(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(order + 1, 1.0 / (order + 1))
        for _ in range(rounds):
            r = p * w
            w = (n[:, None] * r / r.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
            w = np.maximum(w, floor)
            w /= w.sum()
        return w

    every = em(p, n) if len(cells) else np.full(order + 1, 1.0 / (order + 1))
    return np.array([em(p[buckets == b], n[buckets == b]) if (buckets == b).any() else every for b in range(65)])


def mixed(estimates: list[np.ndarray], seen: np.ndarray, model: Model) -> np.ndarray:
    """The interpolated probability of each token."""
    w = model.weights[context_bucket(seen)]
    p = w[:, -1] / (model.types + 1)
    for k, e in enumerate(estimates):
        p = p + w[:, k] * e
    return p


def score(
    df: DataFrame, *, id: str = "doc_id", text: str = "text", order: int = 2, folds: int = 7, out: tuple[int, ...] = (2,), validation: tuple[int, ...] = (6,)
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Folds `out` are not learned from. Of the others, `validation` teaches the weights and all teach the counts.
    base_score is the unigram score with one added to every count, an unknown type included; scores are base-10 logarithms.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def role(doc_id) -> int:
        """0: not learned from, 1: main, 2: held out for the weights."""
        f = fold(doc_id, folds)
        return 0 if f in out else 2 if f in validation else 1

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        builders = [Builder() for _ in range(3)]

        def row(k: int) -> pa.RecordBatch:
            nonlocal made
            b, builders[k], made = builders[k], Builder(), made + 1
            columns = [pa.array([part << 32 | made], pa.int64()), pa.array([k], pa.int32()), pa.array([b.bytes], pa.int64()), pa.array([len(b.ids)], pa.int64()), pa.array([b.packed()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["block", "role", "bytes", "documents", "data"])

        for batch in batches:
            for doc_id, t in zip(*batch.columns, strict=True):
                name = doc_id.as_py()
                k = role(name)
                builders[k].add(name, t.as_py())
                if builders[k].bytes >= BLOCK:
                    yield row(k)
        for k in range(3):
            if builders[k].ids:
                yield row(k)

    blocks = Table(rows.mapInArrow(cut_blocks, "block long, role int, bytes long, documents long, data binary"), "lm-blocks", "uncompressed")
    sizes = {r["role"]: r for r in blocks.read().groupBy("role").agg(F.sum("bytes").alias("bytes"), F.sum("documents").alias("documents")).collect()}
    documents = sum(r["documents"] for k, r in sizes.items() if k)
    main_documents = sizes[1]["documents"] if 1 in sizes else 0
    n = max(partitions, sum(r["bytes"] for r in sizes.values()) // PER_RANGE)
    tasks = max(partitions, min(n, MOST_TASKS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, k, data in zip(*batch.columns, strict=True):
                asked = list(_asked(Block(data.as_py()), order, n, k.as_py()))
                m = len(asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r for r, _ in asked], pa.int32()), pa.array([block.as_py()] * m, pa.int64()), pa.array([k.as_py()] * m, pa.int32()), pa.array([d for _, d in asked], pa.binary())],
                    ["range", "block", "role", "data"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "range", "role", "types", "tokens", "kept", "data"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def rows_of(now: int, held: list) -> pa.RecordBatch:
            answers, types, tokens, kept = _answered(held, order)
            table = [(b, now, k, types * (j == 0), tokens * (j == 0), kept * (j == 0), d) for j, ((b, d), (_, k, _)) in enumerate(zip(answers, held, strict=True))]
            return pa.RecordBatch.from_arrays([pa.array([t[c] for t in table], kind) for c, kind in enumerate(kinds)], names)

        held: list[tuple[int, int, bytes]] = []
        now = None
        for batch in batches:
            for r, block, k, data in zip(*batch.columns, strict=True):
                if r.as_py() != now and held:
                    yield rows_of(now, held)
                    held = []
                now = r.as_py()
                held.append((block.as_py(), k.as_py(), data.as_py()))
        if held:
            yield rows_of(now, held)

    asked = blocks.read().select("block", "role", "data").mapInArrow(ask, "range int, block long, role int, data binary")
    dealt = asked.repartition(tasks, "range").sortWithinPartitions("range")
    schema = "block long, range int, role int, types long, tokens long, kept long, data binary"
    answers = Table(dealt.mapInArrow(answer, schema), "lm-answers", "uncompressed")
    sums = answers.read().agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "tokens", "kept")]).first()
    types, tokens, main_tokens = sums

    def met(only: int | None, run, schema: str) -> DataFrame:
        """run over each block (of one role) with its answers in order of range."""
        a = blocks.read().select("block", "role", F.lit(-1).alias("range"), "data")
        b = answers.read().select("block", "role", "range", "data")
        both = a.unionByName(b)
        both = both if only is None else both.filter(F.col("role") == only)

        def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, got = None, []
            for batch in batches:
                for r, data in zip(*batch.columns, strict=True):
                    if r.as_py() < 0:
                        if block is not None:
                            yield run(block, got)
                        block, got = Block(data.as_py()), []
                    else:
                        got.append(data.as_py())
            if block is not None:
                yield run(block, got)

        return both.repartition(tasks, "block").sortWithinPartitions("block", "range").select("range", "data").mapInArrow(grouped, schema)

    def histogram(block: Block, got: list[bytes]) -> pa.RecordBatch:
        counts = [main for main, _ in _counts(block, got, order)]
        estimates, seen = _estimates(block, counts, main_tokens, main_documents)
        with np.errstate(divide="ignore"):
            steps = [np.where(e > 0, np.rint(STEPS * np.log2(np.where(e > 0, e, 1.0) * (types + 1))), -(10**6)).astype(np.int64) for e in estimates]
        cells, n_of = np.unique(np.stack([context_bucket(seen), *steps]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1:].T.tolist(), pa.list_(pa.int64())), pa.array(n_of, pa.int64())], ["bucket", "steps", "n"])

    cells = met(2, histogram, "bucket int, steps array<long>, n long").groupBy("bucket", "steps").agg(F.sum("n").alias("n"))
    weights = learn([(r["bucket"], tuple(r["steps"]), r["n"]) for r in cells.orderBy("bucket", "steps").collect()], order)
    model = Model(order, tokens, types, documents, weights)

    def scored(block: Block, got: list[bytes]) -> pa.RecordBatch:
        counts = [main + held for main, held in _counts(block, got, order)]
        estimates, seen = _estimates(block, counts, model.tokens, model.documents)
        own = np.log10(mixed(estimates, seen, model))
        base = np.log10((counts[0] + 1) / (model.tokens + model.types + 1))
        total = lambda x: np.add.reduceat(x, block.starts)
        names = block.names()
        columns = [
            pa.array(names, pa.int64()),
            pa.array([fold(i, folds) in out for i in names], pa.bool_()),
            pa.array(block.sizes, pa.int64()),
            pa.array(total((counts[0] > 0).astype(np.int64)), pa.int64()),
            pa.array([model.tokens] * len(names), pa.int64()),
            pa.array(total(base), pa.float64()),
            pa.array(total(own), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result = cut(met(None, scored, schema))
    blocks.drop()
    answers.drop()
    return result
