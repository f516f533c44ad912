"""Document fingerprints by randomised edit embedding.

The embedding walks a text with a pointer. At step j it emits what stands under the pointer (a character and the one
after it) and moves on if a shared random bit for (j, character) is 1. Two texts walk alike up to an edit; after it
their pointers drift and, being random walks on the same bits, meet again after a few steps, from where they emit the
same. So k edits change O(k^2) emitted places, whatever the texts' lengths: edit distance becomes Hamming distance.

A document's fingerprint samples its embedding: each of SLOTS slots keeps one byte of what is emitted at one random
place. The places are the same for all embeddings of a length, and those of a longer one differ from them only as far
as it is longer: a slot's place is the last of a random sequence of places that lies within the embedding, drawn so
that every place of it is as likely. The whole text is walked. Two hexadecimal digits a slot; 00 is the empty text's.
The share of equal slots estimates the share of places at which the embeddings agree.

Near duplicates come from bands of sampled slots: fingerprints that agree in all slots of a band are candidates, and
candidates are verified by all slots. There are as many bands as it takes for every linked pair to agree in one. Equal
fingerprints are one node, a band's links leave a task as stars, and a band key of more than `bucket` nodes is cut into
blocks and, where these stay apart, dealt out anew by the slots that vary below it; no link is lost, and no task holds a hot key.

Texts of a batch are walked together, a step a character, the longest ones each by itself. The random bits repeat
after PERIOD steps. Null text counts as empty. Texts of any length are walked whole. Repeated rows get equal
fingerprints; ties of id are ordered by text. An empty table gives an empty result. Other columns of the input are not
looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.shared import Table, cut, discard, spread_join, worker_cache

SLOTS = 64
#: Steps after which the random bits repeat, and classes that characters are hashed into for the walk.
PERIOD, CLASSES = 4096, 256
#: Texts of a batch are walked together as long as there are so many.
TOGETHER = 64
#: Bytes of text for which there is a range of documents, and how many ranges there are at most.
PER_RANGE, MOST_RANGES = 16 << 20, 20_000


def walk_table(seed: int = 11) -> np.ndarray:
    """[class, step] -> steps until the pointer moves on from a character of that class, counted from 1."""
    bits = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1  # so that every wait ends
    places = np.where(np.concatenate([bits, bits], axis=1) == 1, np.arange(2 * PERIOD), 4 * PERIOD)
    following = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
    return (following - np.arange(PERIOD) + 1).astype(np.uint16)


def sample_places(seed: int = 17, most: int = 1 << 44) -> list[np.ndarray]:
    """For each slot the rising places that it samples: in an embedding of L steps, the last one below L.

    They are the times of records in a sequence of random numbers: after place t - 1, the next one lies beyond place
    m - 1 with probability t / m. So the last one below L is uniform, and stays the same while L grows to m with t / m.
    """
    draw = np.random.Generator(np.random.PCG64(seed))
    out = []
    for _ in range(SLOTS):
        times = [1]
        while times[-1] < most:
            times.append(int(times[-1] / (1.0 - draw.random())) + 1)
        out.append(np.array(times, np.int64) - 1)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (multiply and shift) of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _walked(codes: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, the steps at which its pointer moves on from each of its characters; texts by falling length."""
    table = worker_cache("edit walk", walk_table)
    lengths = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(lengths) - lengths
    flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    base = (flat & 255 ^ flat >> 8 & 255).astype(np.int64) * PERIOD
    waits, left = table.ravel(), np.empty(len(flat), np.int64)
    # all texts that still have a k-th character; those are the first ones
    alive = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if len(codes) else 1), "right")
    together = int((alive >= TOGETHER).sum())
    step = np.zeros(len(codes), np.int64)
    for k, m in enumerate(alive[:together].tolist()):
        at = starts[:m] + k
        j = step[:m]
        j += waits[base[at] + j % PERIOD]
        left[at] = j
    quick = worker_cache("edit walk as a list", lambda: walk_table().ravel().tolist())
    for text in np.flatnonzero(lengths > together).tolist():
        a, b, j, ends = int(starts[text]) + together, int(starts[text] + lengths[text]), int(step[text]), []
        for c in base[a:b].tolist():
            j += quick[c + j % PERIOD]
            ends.append(j)
        left[a:b] = ends
    return [left[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def embed(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text, SLOTS bytes."""
    places = worker_cache("edit places", sample_places)
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(codes[k]))
    out = [bytes(SLOTS)] * len(texts)
    filled = [k for k in order if len(codes[k])]
    if not filled:
        return out
    left = _walked([codes[k] for k in filled])
    lengths = np.array([int(x[-1]) for x in left], np.int64)
    sampled = np.stack([p[np.searchsorted(p, lengths, "left") - 1] for p in places], axis=1)
    for row, (k, ends) in enumerate(zip(filled, left, strict=True)):
        own = codes[k]
        at = np.searchsorted(ends, sampled[row], "right")  # the character under the pointer at that step
        pair = own[at].astype(np.uint64) << np.uint64(21) | np.where(at + 1 < len(own), own[np.minimum(at + 1, len(own) - 1)], 0).astype(np.uint64)
        out[k] = (_mixed(sampled[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ pair) % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots, 0 to 1; two empty texts agree wholly."""
    return float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first characters of the following one."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, print) of each whole text; print is binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(embed([t or "" for t in part.column(1).to_pylist()]), pa.binary())], ["doc_id", "print"])

    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print binary")


def chunks(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes, or one row."""
    sizes = batch.nbytes / max(batch.num_rows, 1)
    rows = max(1, int(limit / max(sizes, 1)))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def print_stars(nodes: list[int], prints: list[bytes], least: float) -> list[tuple[int, int]]:
    """(member, smallest member) for the components of fingerprints that agree in a share of at least `least`."""
    order = np.argsort(np.array(nodes, np.int64))
    names = np.array(nodes, np.int64)[order]
    values = np.frombuffer(b"".join([prints[k] for k in order]), np.uint8).reshape(-1, SLOTS)
    rest, stars = np.arange(len(names)), []
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            near = (values[rest] == values[todo.pop()]).sum(axis=1) >= least * SLOTS - 1e-9
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found.tolist())
                stars.extend((int(names[y]), int(names[root])) for y in found)
    return stars


def _sampled(parent: Column, slots: Column, parts: int) -> Column:
    """The keys of a fingerprint below its key `parent`: `slots` dealt out to `parts` bands, and what stands in each band's."""
    band = lambda g: F.filter(slots, lambda _, k: F.pmod(k, F.lit(parts)) == g)
    values = lambda g: F.transform(band(g), lambda s: F.substring(F.col("print"), s + 1, 1))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda g: F.xxhash64(parent, g, values(g)))


def _varying(members: DataFrame) -> DataFrame:
    """(at, slots): the slots in which the fingerprints of a key differ at all."""
    words = [F.conv(F.hex(F.substring("print", 8 * k + 1, 8)), 16, -10).cast("long") for k in range(SLOTS // 8)]
    both = members.groupBy(F.col("key").alias("at")).agg(F.array(*[F.bit_or(w).bitwiseXOR(F.bit_and(w)) for w in words]).alias("x"))
    every = F.expr(f"filter(sequence(0, {SLOTS - 1}), s -> (shiftrightunsigned(x[cast(floor(s / 8) as int)], cast(8 * (7 - s % 8) as int)) & 255) <> 0)")
    return both.select("at", every.alias("slots"))


def classes(nodes: DataFrame, least: float = 0.8, bucket: int = 4096, levels: int = 3, seed: int = 5) -> DataFrame:
    """Distinct (node, print) -> (node, root): fingerprints linked by `least` or more of their slots, directly or through others.

    Linked fingerprints differ in at most d slots. The slots, in a sampled order, are dealt out to d + 1 bands, so in one
    of them the two agree for certain: candidates are those that share a band's key. A key of up to `bucket` nodes is
    verified by one task. A larger one is settled by itself where its nodes are near copies: blocks of it are verified, each
    with the key's first node. Where they are still apart, the slots that vary within the key are dealt out to d + 1 bands again, below that
    key, and so on for `levels` levels; each sends a node to d + 1 keys, so the work is in proportion to the nodes. A key
    whose nodes vary in d slots or fewer holds links only. What is hot and apart at the last level has each pair of its
    blocks verified, so no link is lost. Fingerprints without a link do not appear.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars = [s for n, p in zip(*batch.columns, strict=True) for s in print_stars(n.as_py(), p.as_py(), least)]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])

    def verified(placed: DataFrame, by: list[str]) -> DataFrame:
        met = placed.groupBy(*by).agg(F.collect_list("node").alias("nodes"), F.collect_list("print").alias("prints"))
        return met.select("nodes", "prints").mapInArrow(verify, "a long, b long")

    bands = math.floor((1 - least) * SLOTS + 1e-9) + 1
    order = np.random.Generator(np.random.PCG64(seed)).permutation(SLOTS).tolist()
    fixed = F.array(*[F.xxhash64(F.lit(g), *[F.substring("print", s + 1, 1) for s in order[g::bands]]) for g in range(bands)])
    dealt = nodes.select("node", F.explode(fixed).alias("key"))
    edges, done = None, []
    for level in range(levels):
        shared = cut(dealt.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1"))
        total = shared.agg(F.sum("n"), F.max("n")).first()
        members = spread_join(dealt, shared.withColumnRenamed("key", "on"), "key", shared.select(F.col("key").alias("on"), "n"), total[0] or 0)
        # fingerprints go only where they are compared
        found = cut(verified(members.filter(F.col("n") <= bucket).join(nodes, "node"), ["key"]))
        edges = edges.unionByName(found) if edges else found
        done += [shared, found]
        if (total[1] or 0) <= bucket:
            break
        crowd = cut(members.filter(F.col("n") > bucket).join(nodes, "node"))
        blocks = F.ceil(F.col("n") / max(bucket // 2, 1)).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        with_first = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
        inside = cut(verified(crowd.select("key", "node", "print", F.explode(with_first).alias("block")), ["key", "block"]))
        # nodes that vary in fewer slots than there are bands are all near
        few = _varying(crowd)
        near = few.filter(F.size("slots") < bands).select("at")
        linked = cut(crowd.join(near, F.col("key") == F.col("at"), "left_semi").filter(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b")))
        edges = edges.unionByName(inside).unionByName(linked)
        done += [crowd, inside, linked]
        known = cut(connected_components(inside.unionByName(linked))).select(F.col("node").alias("met"), "root")
        rooted = crowd.join(known, F.col("node") == F.col("met"), "left").withColumn("root", F.coalesce("root", "node"))
        apart = cut(rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select(F.col("key").alias("at")))
        done.append(apart)
        if apart.isEmpty():
            break
        left = crowd.join(apart, F.col("key") == F.col("at"), "left_semi")
        if level + 1 < levels:
            slots = _varying(left).filter(F.size("slots") >= bands)
            dealt = left.join(slots, F.col("key") == F.col("at")).select("node", F.explode(_sampled(F.col("key"), F.col("slots"), bands)).alias("key"))
        else:
            pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
            edges = edges.unionByName(verified(left.select("key", "node", "print", F.explode(pairs).alias("pair")), ["key", "pair"]))
    components = connected_components(edges)
    for some in done:
        discard(some)
    return components


def class_ids(prints: DataFrame, **options) -> DataFrame:
    """(doc_id, print) -> (print, class_id) of every fingerprint: the smallest id of its class."""
    own = cut(prints.groupBy(F.xxhash64("print").alias("node"), "print").agg(F.min("doc_id").alias("least")))
    components = classes(own, **options).withColumnRenamed("node", "met")
    rooted = cut(own.join(components, F.col("node") == F.col("met"), "left").select("print", "least", F.coalesce("root", "node").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n")).select(F.col("root").alias("on"), "class_id", "n")
    return spread_join(rooted, names.select("on", "class_id"), "root", names, rooted.count()).select("print", "class_id")


def _ranges(rows: DataFrame, n: int) -> tuple[Column, list[int]]:
    """(the range of a row, the ranges' order by falling key): n or so ranges of rows (key, hash) at the keys' quantiles.

    A key that holds several quantiles has a range of its own, cut further by hash, so no key's rows are one task's.
    """
    quantiles = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], max(10_000, 4 * n)).alias("q")).first()["q"] if n > 1 else []
    times: dict[int, int] = {}
    for q in quantiles or []:
        times[q] = times.get(q, 0) + 1
    heavy = {q: min(t + 1, 1 << 15) for q, t in times.items() if t > 1}
    cuts = sorted({*times, *(q - 1 for q in heavy if q > -(1 << 63))})
    base = F.lit(0)
    if cuts:
        # found in two steps, by every m-th cut and then among the m that follow
        m = math.isqrt(len(cuts)) + 1
        below = lambda values: F.size(F.filter(values, lambda c: c < F.col("key")))
        every, coarse = (F.array(*[F.lit(c).cast("long") for c in some]) if some else F.array().cast("array<bigint>") for some in (cuts, cuts[m - 1 :: m]))
        base = below(coarse) * m + below(F.slice(every, below(coarse) * m + 1, m))
    sub = F.lit(0).cast("long")
    if heavy:
        subs = F.create_map(*[F.lit(x).cast("long") for q, t in heavy.items() for x in (q, t)])
        sub = F.coalesce(F.shiftright((F.shiftright("hash", 32) + (1 << 31)) * subs[F.col("key")], 32), sub)
    return F.shiftleft(base.cast("long"), 16) + sub, cuts


def with_edits(df: DataFrame, id: str = "doc_id", text: str = "text", ranges: int | None = None, **options) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id) of each document.

    The next document is the one before it by id, and after the smallest id comes the largest. Ids are cut into
    ranges and each range is sorted by itself; the first document of a range also goes to the end of the range above,
    so every document meets its next one without a global sort in one task. What the driver holds is a few numbers a
    range. Null ids stand below all others. class_id is the smallest id of the documents near to each other by
    classes(), whose options these are; null where none has an id.
    """
    spark = df.sparkSession
    named = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = named.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("hash"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // PER_RANGE, MOST_RANGES))
    part, _ = _ranges(rows, n)
    # the first row of each range, by falling key and rising hash; one row a range comes to the driver
    first = F.max(F.struct("key", F.bitwise_not("hash").alias("not_hash"))).alias("head")
    heads = {r["part"]: (r["head"]["key"], ~r["head"]["not_hash"]) for r in rows.groupBy(part.alias("part")).agg(first).collect()}
    used = sorted(heads, key=lambda p: (-(p >> 16), p & 0xFFFF))
    guests = spark.createDataFrame([(*heads[p], used[k - 1]) for k, p in enumerate(used)], "head_key long, head_hash long, above long")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for some in chunks(batch):
                texts = some.column(1).to_pylist()
                packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts]
                columns = [some.column(0), pa.array(packed, pa.binary()), pa.array(embed(texts), pa.binary()), *some.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "packed", "print", "key", "hash", "part"])

    walked = rows.withColumn("part", part).mapInArrow(walk, "doc_id long, packed binary, print binary, key long, hash long, part long")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
    both = F.array(own, F.struct(F.col("above").alias("part"), F.lit(1).alias("guest")))
    # one row a range: at most MOST_RANGES
    met = walked.join(F.broadcast(guests), (F.col("key") == F.col("head_key")) & (F.col("hash") == F.col("head_hash")), "left")
    sent = met.withColumn("place", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(both)))
    sent = sent.select("doc_id", "packed", "print", "key", "hash", F.col("place.part").alias("part"), F.col("place.guest").alias("guest"))
    lined = sent.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("key").desc(), "hash", "packed").select("doc_id", "packed", "print", "part", "guest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []  # (doc_id, n_chars, edited text, print, next one's print)
        size = 0
        before = None  # the row whose next is still to come

        def flush() -> pa.RecordBatch:
            ids, sizes, changed, prints, nexts = (list(x) for x in zip(*held, strict=True))
            held.clear()
            others = embed(changed)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest() for c in changed], pa.binary()),
                pa.array(prints, pa.binary()),
                pa.array(others, pa.binary()),
                pa.array([likeness(p, o) for p, o in zip(prints, others, strict=True)], pa.float64()),
                pa.array([likeness(p, o) for p, o in zip(prints, nexts, strict=True)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "sha", "print", "other", "near_edited", "near_next"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for d, packed, print, p, g in zip(*[c.to_pylist() for c in batch.slice(k, 256).columns], strict=True):
                    t = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                    if before is not None and before[3] == p:
                        held.append((before[0], len(before[1]), edited(before[1], t), before[2], print))
                        size += len(before[1])
                        if size >= 4 << 20:
                            yield flush()
                            size = 0
                    before = None if g else (d, t, print, p)
        if held:
            yield flush()

    schema = "doc_id long, n_chars long, sha binary, print binary, other binary, near_edited double, near_next double"
    done = Table(lined.mapInArrow(run, schema), "edit-prints").read()
    ids = class_ids(done.select("doc_id", "print"), **options)
    low = lambda c: F.lower(F.hex(c))
    counts = done.groupBy(F.col("print").alias("on")).agg(F.count("*").alias("n"))
    named = spread_join(done, cut(ids.withColumnRenamed("print", "on")), "print", counts, done.count())
    return named.select("doc_id", "n_chars", low("sha").alias("edited_sha256"), low("print").alias("fingerprint"), low("other").alias("edited_fingerprint"), "near_edited", "near_next", "class_id")
