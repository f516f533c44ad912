"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: 64 sums over the XXH64 values of a text's word shingles. Two fingerprints link when they differ in
at most `radius` bits. Candidate pairs come from covering masks: every bit position gets a random vector of
radius + 1 bits, and each non-zero v gives one mask, of the positions whose vector has an odd product with v. For
any `radius` differing positions some mask has none of them, so each linked pair meets in some table for certain.

Equal fingerprints are one node, however many documents share one. A bucket's links are found inside one task
by breadth-first search, and only a star for each component leaves it, never all pairs. Buckets of more than
`bucket` distinct fingerprints are resolved another exact way: two fingerprints at most 3 bits apart have a
point at most 1 bit from the one and at most 2 from the other, so each such fingerprint is sent to the points
around it (2081 for 64 bits), where at most 65 + 2016 can meet; that work is in proportion to their number.

Null text counts as empty; empty text has the fingerprint zero, linked like any other. Repeated rows share
fingerprint and component. A null id keeps its row and takes part in linking, but never names a component; a
component of null ids only has a null name. An empty table gives an empty result. Other columns of the input
are not looked at.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.shared import cut, discard, lean, spread_join, unused

BITS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        hashes = [xxh64_intdigest(whole, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        hashes = [xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], "<u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(over.view("<i8")[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_py(), width, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = df.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 masks; for any `radius` positions, one mask has none of them.

    Position i carries a vector r(i) of radius + 1 bits; the mask of v holds the positions with odd r(i).v. Any
    `radius` vectors span a proper subspace, so some non-zero v is orthogonal to all of them.
    """
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(bits)]
    return [sum(1 << i for i, r in enumerate(vectors) if (r & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def bucket_stars(fps: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) for the components that the fingerprints of one bucket form."""
    import numpy as np

    rest = np.unique(np.array(fps, np.int64))
    stars = []
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            # unsigned, as numpy counts the bits of a signed number's absolute value
            near = np.bitwise_count((rest ^ todo.pop()).view(np.uint64)) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                stars.extend((int(x), int(root)) for x in found)
    return stars


def links(distinct: DataFrame, radius: int = 3, bucket: int = 8192) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all links up to `radius` bits; a checkpoint, so that
    who contracts them in Python has no second worker a task."""
    masks = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), F.lit(_signed(m)).alias("m")) for t, m in enumerate(covering_masks(radius))])
    tables = distinct.select("fp", F.explode(masks).alias("x")).select("fp", F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    shared = tables.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = tables.join(shared, ["t", "key"])
    usual = members.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars = [s for fps in batch.column(0) for s in bucket_stars(fps.values.to_numpy(), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])

    found = usual.select("fps").mapInArrow(lean(run), "a long, b long")
    return cut(found.unionByName(around(members.filter(F.col("n") > bucket).select("fp").distinct(), radius)))


def around(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges between fingerprints by the points around them; exact for a radius up to 3 and any number of rows."""
    if radius > 3:
        raise ValueError("points around fingerprints reach a radius of 3")
    one, two = (radius // 2, radius - radius // 2)
    flips = [(sum(1 << i for i in c), k) for k in range(two + 1) for c in combinations(range(BITS), k)]
    points = F.array(*[F.struct(F.lit(_signed(m)).alias("m"), F.lit(k <= one).alias("close")) for m, k in flips])
    sent = distinct.select("fp", F.explode(points).alias("x")).select(F.col("fp").bitwiseXOR(F.col("x.m")).alias("point"), "fp", F.col("x.close").alias("close"))
    met = sent.groupBy("point").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("b"), F.collect_list("fp").alias("fps"))
    return met.filter("b is not null and size(fps) > 1").select(F.explode("fps").alias("a"), "b").filter("a <> b").distinct()


def near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, seed: int = 42, bucket: int = 8192
) -> DataFrame:
    """(doc_id, fp, component_id): documents in linked classes; component_id is the smallest id of the class."""
    docs = cut(fingerprints(df, id, text, width, seed))
    nodes = cut(docs.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    edges = links(nodes.select(F.col("node").alias("fp")), radius, bucket)
    named = cut(_named(nodes.select("node", "least"), connected_components(edges)))
    discard(edges)
    counts = nodes.select(F.col("node").alias("on"), "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return spread_join(docs, named.select(F.col("node").alias("on"), "component_id"), "fp", counts, total).select("doc_id", "fp", "component_id")


def _named(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(node, least) -> (node, component_id): the least of all nodes that a component connects; alone, a node's own."""
    met = nodes.join(components.withColumnRenamed("node", "met"), F.col("node") == F.col("met"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = cut(met)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).select(F.col("root").alias("on"), "component_id", "n")
    return spread_join(rooted, names.select("on", "component_id"), "root", names, rooted.count()).select("node", "component_id")


#: Bands of candidates' keys and min-hashes in one: texts of a similarity s miss each other with (1 - s ** ROWS) ** BANDS, 3e-6 at 0.8.
BANDS, ROWS = 32, 5
#: Bytes that are kept of a shingle's hash, and of the hashes that one task verifies at a time.
KEPT, AT_ONCE = 5, 32 << 20


_ODD = [random.Random(11).getrandbits(64 * BANDS * ROWS) >> 64 * k & (1 << 64) - 1 | 1 for k in range(BANDS * ROWS)]


def word_prints(text: str | None, width: int = 5) -> tuple[int, list[int], bytes]:
    """(hash of the word sequence, BANDS keys over min-hashes of the word shingles, the distinct shingles as KEPT bytes each)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    whole = b" ".join(words)
    name = _signed(xxh64_intdigest(whole, 1))
    if not words:
        return name, [], b""
    if len(words) <= width:
        hashes = [xxh64_intdigest(whole, 3)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        hashes = [xxh64_intdigest(whole[a:b], 3) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    h = np.unique(np.array(hashes, "<u8"))
    odd = np.array(_ODD, np.uint64)
    by = odd.astype(np.uint32)[:, None]
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1 << 11):
        np.minimum(least, (low[k : k + (1 << 11)] * by).min(axis=1), out=least)
    keys = (least.astype(np.uint64) * odd).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)  # the band is in them: its factors are its own
    shingles = np.unique(h & np.uint64((1 << 8 * KEPT) - 1))
    return name, keys.view(np.int64).tolist(), shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def similar_stars(nodes: list[int], shingles: list[bytes], least: float) -> list[tuple[int, int]]:
    """(member, smallest member) for the components of texts whose shingles have a Jaccard similarity of at least `least`."""
    import numpy as np

    order = np.argsort(np.array(nodes, np.int64))
    names = np.array(nodes, np.int64)[order]
    wide = np.zeros((sum(map(len, shingles)) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(b"".join([shingles[k] for k in order]), np.uint8).reshape(-1, KEPT)
    values, items = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    sizes = np.array([len(shingles[k]) // KEPT for k in order], np.int64)
    ends = np.cumsum(sizes)
    # the items of the texts that are still looked for, and whose they are
    left, owner = items, np.repeat(np.arange(len(names)), sizes)
    mark = np.zeros(len(values), bool)
    rest = np.arange(len(names))
    stars = []
    while len(rest):
        root, todo, rest = rest[0], [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            own = items[ends[x] - sizes[x] : ends[x]]
            mark[own] = True
            both = np.bincount(owner[mark[left]], minlength=len(names))[rest]
            mark[own] = False
            # 1e-9: a product such as 0.8 * 5 may be rounded up
            near = (both >= least * (sizes[x] + sizes[rest] - both) - 1e-9) & (both > 0)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found.tolist())
                stars.extend((int(names[y]), int(names[root])) for y in found)
                open_ = np.zeros(len(names), bool)
                open_[rest] = True
                some = open_[owner]
                left, owner = left[some], owner[some]
    return stars


def near_texts(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, bucket: int = 4096, radius: int | None = None) -> DataFrame:
    """(doc_id, exact, node, best, component_id): classes of documents whose word shingles are similar by `least` (Jaccard), and with
    a radius also of those whose fingerprints (of three-word shingles) links() connects, as near_duplicates() does.

    exact is a hash of the text, node one of its words. component_id is the smallest id of the class, best that id with
    the smallest hash of a text under it; both are null in a class without an id.

    Candidates come from min-hashes of the shingles, BANDS times ROWS of them: wherever two texts differ, in one place
    or in many, they meet in no band with (1 - s ** ROWS) ** BANDS. Texts that bands connect are brought together, and
    every pair of them is verified by the shingles themselves, up to equal hashes of KEPT bytes. Copies up to case and
    white space are one node. Of more than `bucket` connected nodes, or AT_ONCE bytes, those of each band key are, cut
    into blocks where a key has as many. There each block is verified by itself with the key's first node, which a group
    of near copies is settled by; only keys whose nodes are then still apart have each pair of blocks verified, so no
    link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_prints(t.as_py(), width) for t in batch.column(1)]
            columns = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.binary())]
            columns.append(pa.array([None if radius is None else simhash(t.as_py()) for t in batch.column(1)], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "exact", "node", "keys", "shingles", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars = [s for n, k in zip(*batch.columns, strict=True) for s in similar_stars(n.as_py(), k.as_py(), least)]
            yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.int64()) for k in (0, 1)], ["a", "b"])

    def verified(placed: DataFrame, by: list[str]) -> DataFrame:
        met = placed.join(shingles, "node").groupBy(*by).agg(F.collect_list("node").alias("nodes"), F.collect_list("shingles").alias("shingles"))
        return met.select("nodes", "shingles").mapInArrow(lean(verify), "a long, b long")

    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("exact"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    docs = cut(rows.mapInArrow(lean(run), f"doc_id {kind}, exact long, node long, keys array<long>, shingles binary, fp long"))
    shingles = docs.groupBy("node").agg(F.first("shingles").alias("shingles"))
    keyed = docs.groupBy("node").agg(F.first("keys").alias("keys"), F.first(F.octet_length("shingles")).alias("size"))
    dealt = keyed.select("node", "size", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1")
    members = cut(dealt.join(shared, "key").select("key", "node", "size", "first", "n", "bytes"))
    met = connected_components(members.select(F.col("node").alias("a"), F.col("first").alias("b")))
    sizes = members.select("node", "size").distinct()
    met = met.join(sizes, "node")
    many = cut(met.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("size").alias("all")).filter((F.col("nodes") > bucket) | (F.col("all") > AT_ONCE)).select("root"))
    edges = verified(met.join(many, "root", "left_anti").select("node", "root"), ["root"])
    if not many.isEmpty():
        crowd = cut(members.join(met.join(many, "root", "left_semi").select("node"), "node", "left_semi"))
        whole = (F.col("n") <= bucket) & (F.col("bytes") <= AT_ONCE)
        blocks = F.when(whole, 1).otherwise(F.greatest(F.ceil(F.col("n") / max(bucket // 2, 1)), F.ceil(F.col("bytes") / (AT_ONCE // 2)))).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        # first each block by itself, with the key's first node in every block: work in proportion to the nodes
        with_first = F.when(F.col("node") == F.col("first"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
        inside = cut(verified(crowd.select("key", "node", F.explode(with_first).alias("block")), ["key", "block"]))
        # then pairs of blocks, for the keys whose nodes are still in several components
        found = cut(connected_components(inside)).select(F.col("node").alias("met"), F.col("root"))
        placed = crowd.filter(~whole).join(found, F.col("node") == F.col("met"), "left").withColumn("root", F.coalesce("root", "node"))
        open_ = cut(placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("key"))
        edges = edges.unionByName(inside)
        if not open_.isEmpty():
            pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
            left = crowd.join(open_, "key", "left_semi").select("key", "node", F.explode(pairs).alias("pair"))
            edges = edges.unionByName(verified(left, ["key", "pair"]))
    if radius is not None:
        edges = edges.unionByName(_print_stars(cut(docs.groupBy("node").agg(F.first("fp").alias("fp"))), radius))
    edges = cut(edges)  # verified before they are contracted: both in one task would take two Python workers, which stay when idle
    components = connected_components(edges)
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "exact"))
    known = cut(docs.groupBy("node").agg(F.min(own).alias("least"), F.count("*").alias("n")))
    named = cut(_named(known.select("node", "least"), components))
    slim = cut(docs.select("doc_id", "exact", "node"))
    for done in (members, many, docs, edges):
        discard(done)
    counts = known.select(F.col("node").alias("on"), "n")
    placed = spread_join(slim, named.select(F.col("node").alias("on"), F.col("component_id").alias("best")), "node", counts, slim.count())
    return placed.withColumn("component_id", F.col("best.doc_id"))


def _print_stars(nodes: DataFrame, radius: int) -> DataFrame:
    """(node, fp) -> edges (a, b) from each node to the smallest one whose fingerprint links() connects with its own."""
    prints = cut(nodes.groupBy(F.col("fp").alias("on")).agg(F.count("*").alias("n")))
    edges = links(prints.select(F.col("on").alias("fp")), radius)
    roots = cut(connected_components(edges))
    discard(edges)
    total = nodes.count()
    rooted = cut(spread_join(nodes, roots.select(F.col("node").alias("on"), "root"), "fp", prints, total, "left").select("node", F.coalesce("root", "fp").alias("root")))
    groups = cut(rooted.groupBy(F.col("root").alias("on")).agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1"))
    return spread_join(rooted, groups.select("on", "b"), "root", groups, total).filter("node <> b").select(F.col("node").alias("a"), "b")


def one_each(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one row of each class of near texts: the one of the smallest id, of several texts under it the one whose hash is smallest.

    Rows are told apart by id and text, so a text that shares its id with others stays unless it is near to one that
    stays. Rows that are equal in both leave one. Rows without an id stay.
    """
    found = cut(near_texts(df, id, text, **options).select("doc_id", "exact", "best"))
    named = [unused(df, "gone_id"), unused(df, "gone_exact")]
    key = [F.col("doc_id").alias(named[0]), F.col("exact").alias(named[1])]
    same = (F.col(f"`{id}`") == F.col(named[0])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(named[1]))
    gone = cut(found.filter(F.col("doc_id").isNotNull() & (F.struct("doc_id", "exact") != F.col("best"))).select(key).distinct())
    kept = df.join(gone, same, "left_anti")
    twice = cut(found.filter("doc_id is not null").groupBy("doc_id", "exact").agg(F.count("*").alias("n")).filter("n > 1").select(key))
    if not twice.isEmpty():
        exact = unused(df, "exact")
        once = kept.join(twice, same, "left_semi").withColumn(exact, F.xxhash64(F.col(f"`{text}`"))).dropDuplicates([id, exact]).drop(exact)
        kept = kept.join(twice, same, "left_anti").unionByName(once)
    return kept
