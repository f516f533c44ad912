"""Exact repeated-substring removal by distributed suffix sorting.

Every byte is removed that lies in a string of `length` bytes which also starts in a document with a smaller id.

Which suffixes can agree on `length` bytes is settled before anything is sorted. Of the `GRAM`-byte strings in a
window of `length` bytes, the one with the smallest hash is the window's anchor; it depends on the window's bytes
alone, so equal windows have equal anchors at equal places. Consecutive windows with one anchor form a segment of
at most 2 * length - GRAM bytes. The work then goes over the cluster in this way:

1. Rows are packed into blocks of bounded size, written once as a table; documents are known by block and place.
2. Each block asks which of its anchors another block has too: sorted hashes, dealt out by range. The answer is a
   bit an anchor.
3. Segments whose anchor two documents have are dealt out by the anchor's hash, so equal windows meet in one
   bucket. It sorts the suffixes of its segments by their first `length` bytes (deep_shallow below). Neighbours
   that agree on all of them are one class, and in it all but the smallest document's windows are repeats.
4. Blocks meet the stretches found and cut their texts.

Hashes only decide where windows meet: results come from bytes. Equal segments of one block are sent once, for
the smallest document that has them; in the others they are repeats already. So a passage in a third of all
documents costs an entry a block, not an entry a document. The number of ranges, buckets and tasks grows with the
input, so the size of one does not. A block has no more messages than distinct anchors. A long document is taken in overlapping pieces.

Null text counts as empty and stays null. Null ids count as larger than all others. Rows that share an id are
documents of equal rank; repeated rows get equal results. Texts shorter than `length` bytes are kept whole. An
empty table gives an empty result. Other columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import Table, cut, lean

GRAM = 16
#: Bytes of text in a block and in one step of the search for anchors, and for which there is a range or bucket.
BLOCK, STEP, PER_BUCKET = 16 << 20, 2 << 20, 8 << 20
NULL_ID = (1 << 63) - 1
#: Lengths go up to this, as a segment's size has two bytes. Beyond so many ranges a task takes several, one after the other.
LONGEST, MOST_TASKS = 30_000, 20_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _words(buffer: bytes, order: str = "<") -> np.ndarray:
    """The 8 bytes at each place as a number; places up to 8 before the end."""
    return np.ndarray((len(buffer) - 7,), f"{order}u8", buffer, strides=(1,))


def _gram_hashes(buffer: bytes) -> np.ndarray:
    """A hash of the GRAM (two words) bytes at each place, never 0: that stands for no window in segments()."""
    w = _words(buffer)
    n = len(buffer) - GRAM + 1
    x = w[:n] * _M[0]
    x += w[8 : 8 + n] * _M[1]
    x ^= x >> np.uint64(29)
    x *= _M[2]
    x ^= x >> np.uint64(32)
    return np.maximum(x, np.uint64(1), out=x)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over x[i : i + width] for each i, by doubling."""
    span = 1
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def segments(pieces: list[tuple[int, bytes]], length: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of pieces (number, bytes) and for each segment: its piece's place in the list, start in the joined bytes, length, anchor hash."""
    buffer = b"".join(p for _, p in pieces) + b"\0" * (length + 8)
    sizes = np.array([len(p) for _, p in pieces], np.int64)
    ends = np.cumsum(sizes)
    width = length - GRAM + 1
    h = _gram_hashes(buffer)
    low = _sliding(h, width, np.minimum)
    # windows that would cross the end of their piece
    valid = np.zeros(len(low) + 1, np.int8)
    long = sizes >= length
    np.add.at(valid, (ends - sizes)[long], 1)
    np.add.at(valid, (ends - length + 1)[long], -1)
    low[np.cumsum(valid[:-1], dtype=np.int8) == 0] = 0
    del valid
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low])
    top = _sliding(padded, width, np.maximum)
    anchors = np.flatnonzero((top == h[: len(top)]) & (top > 0))
    del top
    first = np.empty(len(anchors), np.int64)
    count = np.empty(len(anchors), np.int64)
    around = np.arange(width)
    for k in range(0, len(anchors), 1 << 15):
        at = anchors[k : k + (1 << 15)]
        fits = padded[at[:, None] + around] == h[at][:, None]  # padded[a + i] is the window that starts at a - width + 1 + i
        first[k : k + len(at)] = at - (width - 1) + fits.argmax(axis=1)
        count[k : k + len(at)] = fits.sum(axis=1)
    # of equal anchors in a window the leftmost counts
    last = first + count
    tie = np.flatnonzero(h[anchors[1:]] == h[anchors[:-1]]) + 1
    first[tie] = np.maximum(first[tie], anchors[tie - 1] + 1)
    some = last > first
    first, last, hashes = first[some], last[some], h[anchors[some]]
    return buffer, np.searchsorted(ends, first, "right"), first, last - first + length - 1, hashes


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, known: int, depth: int) -> np.ndarray:
    """How many first bytes (up to depth) the suffixes at a and b share; `known` are known to be equal."""
    same = np.full(len(a), depth, np.int64)
    open_ = np.arange(len(a))
    at = known
    while at < depth and len(open_):
        x = words[a[open_] + at] ^ words[b[open_] + at]
        differs = x != 0
        d, v = open_[differs], x[differs]
        # the words are big-endian, so the first differing byte holds the highest bit set
        high = np.zeros(len(v), np.int64)
        for shift in (32, 16, 8):
            up = v >> np.uint64(shift)
            big = up != 0
            v = np.where(big, up, v)
            high += np.where(big, shift // 8, 0)
        same[d] = np.minimum(at + 7 - high, depth)
        open_ = open_[~differs]
        at += 8
    return same


def word_order(key: np.ndarray, small: int = 1 << 13, pivots: int = 512) -> np.ndarray:
    """The stable order of words, as multikey quicksort takes one symbol: a partition by pivots into what equals one, which is
    done, and what lies between two, which is partitioned again until it is small."""
    n = len(key)
    if n <= small:
        return np.argsort(key, kind="stable")
    chosen = np.unique(key[:: n // pivots])
    part = np.searchsorted(chosen, key)
    equal = chosen[np.minimum(part, len(chosen) - 1)] == key
    side = (2 * part + equal).astype(np.uint16)
    order = np.argsort(side, kind="stable")  # by counting: 16 bits
    ends = np.cumsum(np.bincount(side, minlength=2 * len(chosen) + 1))
    for k in range(0, 2 * len(chosen) + 1, 2):
        a, b = ends[k - 1] if k else 0, ends[k]
        if b - a > 1:
            own = order[a:b]
            order[a:b] = own[word_order(key[own], small, pivots)]
    return order


def _within(key: np.ndarray, group: np.ndarray, large: int = 1 << 13) -> np.ndarray:
    """The stable order by word within each of the groups, which stand one after the other; large groups one by one."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([heads[1:], [len(group)]])
    out = np.empty(len(key), np.int64)
    rest = np.ones(len(key), bool)
    for k in np.flatnonzero(ends - heads > large).tolist():
        a, b = heads[k], ends[k]
        out[a:b] = a + word_order(key[a:b])
        rest[a:b] = False
    some = np.flatnonzero(rest)
    out[some] = some[np.lexsort((key[some], group[some]))]
    return out


def deep_shallow(buffer: bytes, starts: np.ndarray, depth: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes by their first `depth` bytes: (order, same); same[i]: the i-th in order agrees with the one before it on all of them.

    Shallow: multikey quicksort whose symbol is a word of 8 bytes (word_order below); only suffixes that are equal to
    another go on with their next word, to the depth `shallow`. Deep: each group left is put into a blind trie. A round takes the
    path of one suffix of each group: every other one is compared with it once, and hangs where the two first
    differ, before or after the path by the byte there. Those at one branch with one byte are the next round's
    groups; those that never leave the path are equal. The buffer has at least depth + 8 bytes after each start.
    """
    n = len(starts)
    words = _words(buffer, ">")
    key = words[starts]
    order = word_order(key)
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if n else np.zeros(0, bool)
    at = 8
    while at < min(shallow, depth - 7):
        # members of groups of two or more, with the number of their group
        member = same.copy()
        member[:-1] |= same[1:]
        where = np.flatnonzero(member)
        if not len(where):
            return order, same
        group = np.cumsum(~same[where])
        key = words[starts[order[where]] + at]
        new = _within(key, group)
        order[where] = order[where][new]
        key, group = key[new], group[new]
        same[where] = np.concatenate([[False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])])
        at += 8
    raw = np.frombuffer(buffer, np.uint8)
    member = same.copy()
    if n:
        member[:-1] |= same[1:]
    where = np.flatnonzero(member)
    head = ~same[where]  # the first of each group
    aside = depth * 256  # the branches before the path have numbers below, those after it above
    step = 2 * (aside + 256)
    while len(where):
        group = np.cumsum(head) - 1
        path = order[where[head]][group]
        own = order[where]
        shared = _first_difference(words, starts[own], starts[path], at, depth)
        on_path = shared >= depth
        reach = np.minimum(shared, depth - 1)
        mine, theirs = raw[starts[own] + reach].astype(np.int64), raw[starts[path] + reach]
        branch = np.where(mine < theirs, reach * 256 + mine, aside + (depth - reach) * 256 + mine)
        branch[on_path] = aside
        rank = group * step + branch
        new = np.argsort(rank, kind="stable")
        order[where] = own[new]
        rank, on_path = rank[new], on_path[new]
        equal = np.concatenate([[False], rank[1:] == rank[:-1]])
        same[where] = equal
        # suffixes on the path are done; branches with two or more go on
        more = equal.copy()
        more[:-1] |= equal[1:]
        more &= ~on_path
        where, head = where[more], ~equal[more]
    return order, same


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of maximal runs of True with one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])])
    return at[new], at[np.concatenate([new[1:], [True]])]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed block."""
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


def _gather(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return buffer[:0]
    place = np.arange(int(ends[-1])) + np.repeat(starts - (ends - sizes), sizes)
    return buffer[place]


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, offset, bytes) of about STEP bytes; the pieces of a long text overlap by length - 1."""
    held, size = [], 0
    for doc, data in enumerate(texts):
        for at in range(0, max(len(data) - length + 1, 0), STEP):
            piece = data[at : at + STEP + length - 1]
            held.append((doc, at, piece))
            size += len(piece)
            if size >= STEP:
                yield held
                held, size = [], 0
    if held:
        yield held


def _mixed(h: np.ndarray) -> np.ndarray:
    """Anchors' hashes as evenly spread 56-bit numbers (as minima, the hashes are small)."""
    x = (h ^ (h >> np.uint64(31))) * _M[1]
    return (x ^ (x >> np.uint64(29))) >> np.uint64(8)


def _part(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each 56-bit key; not decreasing with the key."""
    return ((keys >> np.uint64(24)) * np.uint64(n)) >> np.uint64(32)


def _asked(texts: list[bytes], length: int, n: int) -> Iterator[tuple[int, bytes]]:
    """(range, packed sorted keys) of the distinct anchors of a block; nothing for a block without one."""
    found = [np.unique(_mixed(segments([(d, p) for d, _, p in pieces], length)[4])) for pieces in _pieces(texts, length)]
    if not found:
        return
    keys = np.unique(np.concatenate(found))
    if not len(keys):
        return
    used, first = np.unique(_part(keys, n), return_index=True)
    for r, a, b in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        part = keys[a:b]
        planes = np.ascontiguousarray(np.diff(part, prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T)
        yield r, _pack(planes)


def _answered(asked: list[bytes]) -> list[bytes]:
    """For each block's keys of one range: a bit a key, set if another block has it."""
    keys = []
    for data in asked:
        (planes,) = _unpack(data, "u1")
        keys.append(np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64))
    _, number, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    several = times[number] > 1
    ends = np.cumsum([len(k) for k in keys]).tolist()
    return [_pack(np.array([b - a], "<i8"), np.packbits(several[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _segments_sent(block: int, ids: np.ndarray, texts: list[bytes], answers: list[bytes], length: int, n: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed segments) of a block for the anchors that another block, or two of its documents, have.

    Bucket -1: packed stretches (document, first byte, end) that repeat a smaller document of the block.
    """
    bits = []
    for data in answers:
        size, packed = _unpack(data, "<i8", "u1")
        bits.append(np.unpackbits(packed, count=int(size[0])).astype(bool))
    found = []
    for pieces in _pieces(texts, length):
        buffer, piece, start, size, h = segments([(d, p) for d, _, p in pieces], length)
        docs = np.array([d for d, _, _ in pieces], np.int64)
        base = np.cumsum([0, *(len(p) for _, _, p in pieces[:-1])])
        offset = np.array([at for _, at, _ in pieces], np.int64)[piece] + start - base[piece]
        found.append((docs[piece], offset, size, _mixed(h)))
    if not found:
        return
    doc, offset, size, key = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    shared = np.concatenate(bits)
    distinct, number = np.unique(key, return_inverse=True)
    # an anchor of two documents of this block counts as well
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), -1)
    np.minimum.at(low, number, doc)
    np.maximum.at(high, number, doc)
    inner = low != high
    kept = np.flatnonzero((shared | inner)[number])
    if not len(kept):
        return
    doc, offset, size, key, several, elsewhere = doc[kept], offset[kept], size[kept], key[kept], inner[number[kept]], shared[number[kept]]
    whole = b"".join(texts)
    raw = np.frombuffer(whole, np.uint8)
    begin = np.cumsum([0, *map(len, texts[:-1])])
    start = begin[doc] + offset
    # segments of anchors that two documents share are compared by their bytes, as fixed strings
    content = np.arange(len(doc))
    chosen = np.flatnonzero(several)
    most = 2 * length - GRAM
    wide = most + 2  # the size in two bytes, then the bytes
    lanes = np.arange(most)
    order = chosen[np.argsort(key[chosen], kind="stable")]
    at = 0
    while at < len(order):  # a step ends where an anchor does
        to = min(at + (1 << 16), len(order))
        while to < len(order) and key[order[to]] == key[order[to - 1]]:
            to += 1
        part = order[at:to]
        fixed = np.zeros(len(part) * wide + wide + 8, np.uint8)  # deep_shallow looks 8 bytes on
        table = fixed[: len(part) * wide].reshape(-1, wide)
        table[:, 0], table[:, 1] = size[part] & 255, size[part] >> 8
        for k in range(0, len(part), 1 << 14):
            some = part[k : k + (1 << 14)]
            inside = lanes < size[some][:, None]
            table[k : k + len(some), 2:] = np.where(inside, raw[np.minimum(start[some][:, None] + lanes, len(raw) - 1)], 0)
        placed, same = deep_shallow(fixed.tobytes(), np.arange(len(part)) * wide, wide)
        content[part[placed]] = part[placed[~same]][np.cumsum(~same) - 1]
        at = to
    least = np.full(len(doc), np.iinfo(np.int64).max)
    np.minimum.at(least, content, ids[doc])
    local = ids[doc] > least[content]
    if local.any():
        yield -1, _pack(*_joined(doc[local], offset[local], offset[local] + size[local]))
    # of what is left, equal segments of a document are sent once, with all their places; if no other block has
    # the anchor and its segments are all equal here, they can repeat nothing more
    distinct, number = np.unique(key, return_inverse=True)
    low = np.full(len(distinct), np.iinfo(np.int64).max)
    high = np.full(len(distinct), -1)
    np.minimum.at(low, number, content)
    np.maximum.at(high, number, content)
    rest = np.flatnonzero(~local & (elsewhere | (low != high)[number]))
    bucket = _part(key[rest], n).astype(np.int64)
    order = np.lexsort((offset[rest], doc[rest], content[rest], bucket))
    rest, bucket = rest[order], bucket[order]
    if not len(rest):
        return
    new = np.concatenate([[True], (content[rest[1:]] != content[rest[:-1]]) | (doc[rest[1:]] != doc[rest[:-1]])])
    heads = np.flatnonzero(new)
    counts = np.diff(np.concatenate([heads, [len(rest)]]))
    lead = rest[heads]
    edges = np.flatnonzero(np.diff(bucket[heads])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(heads)], strict=True):
        own = lead[a:b]
        places = offset[rest[heads[a] : heads[b - 1] + counts[b - 1]]]
        packed = _pack(key[own], ids[doc[own]], doc[own].astype("<i4"), size[own].astype("<u2"), counts[a:b].astype("<i4"), places.astype("<i4"), _gather(raw, start[own], size[own]))
        yield int(bucket[heads[a]]), packed


def _joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (document, first byte, end), overlapping ones of a document made one."""
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    lift = doc << 33  # so that no document reaches into the next
    new = np.concatenate([[True], (a + lift)[1:] > np.maximum.accumulate(b + lift)[:-1]])
    ends = np.zeros(int(new.sum()), np.int64)
    np.maximum.at(ends, np.cumsum(new) - 1, b)
    return doc[new], a[new], ends


def _bucket_repeats(parts: list[tuple[int, bytes]], length: int) -> Iterator[tuple[int, bytes]]:
    """(block, packed stretches) of what repeats a smaller document, over all (block, packed segments) of a bucket."""
    lists = [_unpack(data, "<u8", "<i8", "<i4", "<u2", "<i4", "<i4", "u1") for _, data in parts]
    block = np.repeat(np.array([b for b, _ in parts], np.int64), [len(x[0]) for x in lists])
    key, ids, doc, size, counts, places, raw = (np.concatenate(x) for x in zip(*lists, strict=True))
    del lists
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    first_place = np.cumsum(counts) - counts
    # anchors that documents of two ids have
    order = np.lexsort((ids, key))
    ks, ds = key[order], ids[order]
    new = np.concatenate([[True], ks[1:] != ks[:-1]])
    group = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(ks)]]) - 1
    kept = np.sort(order[(ds[heads] != ds[tails])[group]])
    if not len(kept):
        return
    buffer = _gather(raw, start[kept], size[kept]).tobytes() + b"\0" * (length + 8)
    size = size[kept]
    start = np.cumsum(size) - size
    windows = size - length + 1
    owner = np.repeat(np.arange(len(kept)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, same = deep_shallow(buffer, start[owner] + inside, length)
    rank = ids[kept][owner]
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(rank[order], heads)
    repeat = np.empty(len(owner), bool)
    repeat[order] = rank[order] > least[np.cumsum(~same) - 1]
    a, b = _runs(repeat, owner)
    if not len(a):
        return
    seg = kept[owner[a]]
    times = counts[seg]
    which = np.repeat(np.arange(len(a)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    place = places[first_place[seg][which] + nth].astype(np.int64)
    own, docs, first, last = block[seg][which], doc[seg][which].astype(np.int64), place + inside[a][which], place + inside[b][which] + length
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, edges):
        yield int(own[part[0]]), _pack(*_joined(docs[part], first[part], last[part]))


def _cut(data: bytes, stretches: list[tuple[int, int]]) -> bytes:
    """What is kept of a text."""
    kept, at = [], 0
    for a, b in stretches:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]) if kept else data


def _rows(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _texts(rows: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ranks (the ids, null last) and texts in UTF-8 of a block's rows."""
    ids = rows.column("__id").fill_null(NULL_ID).to_numpy()
    return ids, [t or b"" for t in rows.column("__text").cast(pa.binary()).to_pylist()]


def _run(df: DataFrame, id: str, text: str, length: int, columns: list, result: str, make) -> DataFrame:
    """make(rows, texts, stretches by document) -> record batch, over all blocks."""
    if not GRAM <= length <= LONGEST:
        raise ValueError(f"length must be from {GRAM} to {LONGEST}")
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"), *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))

        def block() -> pa.RecordBatch:
            nonlocal made, size
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=options) as writer:
                writer.write_table(table)
            made, size = made + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made]), pa.array([table.nbytes]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "bytes", "data"])

        for batch in batches:
            at = 0
            sizes = np.cumsum(np.diff(np.frombuffer(batch.column(1).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(1).offset))) if batch.num_rows else []
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + BLOCK - size, "right")))
                # a copy, so that the batch's memory can go
                held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, to - at)]).take(pa.array(range(to - at))) for c in batch.columns], schema=batch.schema))
                size += int(sizes[to - 1]) - before
                at = to
                if size >= BLOCK or at < batch.num_rows:
                    yield block()
        if held:
            yield block()

    blocks = Table(rows.mapInArrow(lean(pack), "block long, bytes long, data binary"), "suffix-blocks", "uncompressed")
    total = blocks.read().agg(F.sum("bytes")).first()[0] or 0
    n = max(partitions, total // PER_BUCKET)
    tasks = max(partitions, min(n, MOST_TASKS))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(*batch.columns, strict=True):
                asked = list(_asked(_texts(_rows(data.as_py()))[1], length, n))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in asked], pa.int32()), pa.array([block.as_py()] * len(asked), pa.int64()), pa.array([d for _, d in asked], pa.binary())], ["part", "block", "data"])

    def grouped(run):
        """run(part, [(block, data)]) for each part of sorted rows (part, block, data)."""

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, []
            for batch in batches:
                for part, block, data in zip(*batch.columns, strict=True):
                    if part.as_py() != now and held:
                        yield run(now, held)
                        held = []
                    now = part.as_py()
                    held.append((block.as_py(), data.as_py()))
            if held:
                yield run(now, held)

        return over

    def answer(part: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        bits = _answered([d for _, d in held])
        return pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array([b for b, _ in held], pa.int64()), pa.array(bits, pa.binary())], ["part", "block", "data"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "part").sortWithinPartitions("part").select("part", "block", "data")

    kind = "part int, block long, data binary"
    asked = blocks.read().select("block", "data").mapInArrow(lean(ask), kind)
    answers = dealt(asked).mapInArrow(lean(grouped(answer)), kind)

    def met(found: DataFrame, run, schema: str) -> DataFrame:
        """run(block, rows, data of `found` in order of part) for each block."""
        own = blocks.read().select(F.lit(-2).alias("part"), "block", "data")
        both = own.unionByName(found).repartition(tasks, "block").sortWithinPartitions("block", "part").select("part", "block", "data")

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, own, got = None, b"", []
            for batch in batches:
                for part, name, data in zip(*batch.columns, strict=True):
                    if part.as_py() == -2:
                        if block is not None:
                            yield from run(block, _rows(own), got)
                        block, own, got = name.as_py(), data.as_py(), []
                    else:
                        got.append(data.as_py())
            if block is not None:
                yield from run(block, _rows(own), got)

        return both.mapInArrow(lean(over), schema)

    def send(block: int, rows: pa.Table, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, texts = _texts(rows)
        sent = list(_segments_sent(block, ids, texts, got, length, n))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in sent], pa.int32()), pa.array([block] * len(sent), pa.int64()), pa.array([d for _, d in sent], pa.binary())], ["part", "block", "data"])

    def sort(part: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        found = held if part < 0 else list(_bucket_repeats(held, length))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array([b for b, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], ["part", "block", "data"])

    segments_sent = met(answers, send, kind)
    # stretches found within a block pass through, spread by block
    spread = F.when(F.col("part") < 0, F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")).otherwise(F.col("part"))
    in_buckets = segments_sent.withColumn("spread", spread).repartition(tasks, "spread").sortWithinPartitions("part").select("part", "block", "data")
    stretches = in_buckets.mapInArrow(lean(grouped(sort)), kind)

    def cut_texts(block: int, rows: pa.Table, got: list[bytes]) -> Iterator[pa.RecordBatch]:
        texts = _texts(rows)[1]
        by_doc: dict[int, list[tuple[int, int]]] = {}
        if got:
            lists = [_unpack(data, "<i8", "<i8", "<i8") for data in got]
            doc, a, b = _joined(*(np.concatenate(x) for x in zip(*lists, strict=True)))
            for d, x, y in zip(doc.tolist(), a.tolist(), b.tolist(), strict=True):
                by_doc.setdefault(d, []).append((x, y))
        yield make(rows, texts, by_doc)

    finished = met(stretches, cut_texts, result)
    finished = cut(finished) if not columns else Table(finished, "suffix-kept").read()
    blocks.drop()
    return finished


def report(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""

    def make(rows: pa.Table, texts: list[bytes], by_doc: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        none: list = []
        columns = [
            rows.column("__id").combine_chunks(),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([sum(b - a for a, b in by_doc.get(d, none)) for d in range(len(texts))], pa.int64()),
            pa.array([len(by_doc.get(d, none)) for d in range(len(texts))], pa.int64()),
            pa.array([hashlib.sha256(_cut(t, by_doc.get(d, none))).hexdigest() for d, t in enumerate(texts)], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _run(df, id, text, length, [], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)


def remove(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """df with each text cut down to what is kept, as a table in the shared folder. A character that loses some of its bytes goes whole."""
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text] or [F.lit(0).alias("none")]).alias("row")

    def make(rows: pa.Table, texts: list[bytes], by_doc: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
        null = rows.column("__text").is_null().to_pylist()
        kept = [None if n else _cut(t, by_doc.get(d, [])).decode("utf-8", "ignore") for d, (t, n) in enumerate(zip(texts, null, strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), rows.column("row").combine_chunks()], ["kept", "row"])

    schema = df.select(F.lit(None).cast("string").alias("kept"), others).schema
    done = _run(df, id, text, length, [others], schema, make)
    return done.select(*[F.col("kept").alias(text) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
