"""Token ids in a binary file: a wavelet matrix per shard.

A shard file holds the ids of consecutive documents as bit planes, most significant bit first. Each plane is a
bit vector in which the next plane's order is a stable partition of this one's by bit; its bits are kept in
chunks of 2**18, each compressed by itself, with the number of ones before each chunk beside it. So one id, the
number of occurrences of an id before a place, and the place of its k-th occurrence each need one chunk a plane,
and the file is smaller than the plain ids. The layout, all little-endian:

    8 bytes   b"WAVELET1"
    uint32    length of the header, then the header: JSON with n, planes, part, shard, docs and, for each section, [offset, length]
    sections  ids of the documents and their numbers of tokens (int64, zstd), then for each plane: ones before each chunk (uint64, zstd), chunks (zstd)
    4 bytes   b"TVW\\n", the end of the record

Spark's own committer writes the files (so a lost task leaves nothing behind) and its binaryFile source reads
them, on any file system that Spark knows. Documents are range-partitioned and sorted by id, ties by text; a
shard ends once it has `shard_tokens` ids, so memory is bounded by that and by the longest document.

Null text counts as empty: only the end id. Null ids come first. Repeated rows are documents of their own. An
empty table writes no shard, and reading it gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, delete, shared_dir, small_batches, worker_cache

MAGIC, END = b"WAVELET1", b"TVW\n"
CHUNK = 1 << 18
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
#: Characters whose class no Unicode version changes. Any other sends its text to the library whole.
_USUAL = re.compile(rf"[\t\n\r !-~¡¿«»–—‘’“”„…€{_LETTERS}]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
#: Texts that byte classes can cut: no apostrophe, and beyond ASCII only letters of two bytes.
_LATIN = re.compile(rf"[\t\n\r !-&(-~{_LETTERS}]*")
#: A worker's memory starts afresh beyond so many pieces.
KEPT = 1_600_000
_SPACED = re.compile(rf" [{_LETTERS}]+")


# classes of bytes in texts of Latin letters, digits, usual punctuation: letters of two bytes count byte by byte
_LETTER, _DIGIT, _OTHER, _SPACE, _BREAK = range(5)


def byte_classes() -> np.ndarray:
    classes = np.full(256, _OTHER, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalpha():
            classes[c] = _LETTER
        elif 48 <= c <= 57:
            classes[c] = _DIGIT
    classes[[9, 10, 13]] = _BREAK
    classes[32] = _SPACE
    return classes


class PieceTable:
    """The ids of pieces of up to 16 bytes: an open-addressing table in arrays, looked up for many pieces at once.

    A piece's key is its own bytes, filled up with zeros to twice 8. Pieces hold no zero byte (a text with one is not
    cut by byte classes), so equal keys are equal pieces.
    """

    def __init__(self, bits: int = 22):
        self.bits = bits
        self.first, self.last = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.value = np.full(1 << bits, -1, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1, np.int64)  # ids of value v: flat[at[v] : at[v + 1]]

    def __len__(self) -> int:
        return len(self.at) - 1

    def keys(self, words: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes 1 to 8 and bytes 9 to 16. `words` are the 8 bytes from 8 places before each place on."""
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        spare = np.uint64(8) * (np.uint64(8) - np.minimum(size, 8).astype(np.uint64))
        first = words[start + 8] & (full >> spare)
        over = np.maximum(size, 8).astype(np.uint64) - np.uint64(8)
        last = np.where(over > 0, words[start + 16] & (full >> (np.uint64(8) * np.minimum(np.uint64(8) - over, np.uint64(7)))), np.uint64(0))
        return first, last

    def slots(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where to begin to look for each key."""
        mixed = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (last * np.uint64(0xC2B2AE3D27D4EB4F))
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The value of each key, -1 if it is not there."""
        out = np.full(len(first), -1, np.int32)
        todo, place, mask = np.arange(len(first)), self.slots(first, last), (1 << self.bits) - 1
        while len(todo):
            value = self.value[place]
            hit = (value >= 0) & (self.first[place] == first[todo]) & (self.last[place] == last[todo])
            out[todo[hit]] = value[hit]
            on = ~hit & (value >= 0)
            todo, place = todo[on], (place[on] + 1) & mask
        return out

    def add(self, first: np.ndarray, last: np.ndarray, ids: list[bytes]) -> None:
        """Distinct keys that are not there, with their ids. The table doubles before more than half of its slots are in use."""
        base = len(self)
        while 2 * (base + len(ids)) > 1 << self.bits:
            held = self.value >= 0
            first_, last_, value = self.first[held], self.last[held], self.value[held]
            self.bits += 1
            self.first, self.last, self.value = (np.concatenate([x, x]) for x in (self.first, self.last, self.value))
            self.value[:] = -1
            self._place(first_, last_, value)
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        used, more = int(self.at[-1]), int(sizes.sum())
        while used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used : used + more] = np.frombuffer(b"".join(ids), "<u4")
        self.at = np.concatenate([self.at, used + np.cumsum(sizes)])
        self._place(first, last, base + np.arange(len(ids)))

    def _place(self, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> None:
        todo, place, mask = np.arange(len(first)), self.slots(first, last), (1 << self.bits) - 1
        while len(todo):
            free = self.value[place] < 0
            self.value[place[free]] = value[todo[free]]
            own = free & (self.value[place] == value[todo])
            self.first[place[own]], self.last[place[own]] = first[todo[own]], last[todo[own]]
            todo, place = todo[~own], (place[~own] + 1) & mask


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of one of each distinct pair."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    return order[np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])]


class PieceEncoder:
    """The tokenizers library's ids of whole texts under a byte-level file.

    The library cuts a text into pieces and encodes each alone, so equal pieces have equal ids: the library
    encodes each distinct piece once and the ids of a text are those of its pieces in order. New pieces that are
    a space and letters are handed to it as one text, whose words they are again. Texts of usual characters
    without apostrophes are cut by byte classes, all texts of a batch together; with them, by the library's
    pattern; any others are encoded whole by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.planes = (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])).bit_length()
        step = spec["pre_tokenizer"]
        self.by_piece = spec["normalizer"] is None and step["type"] == "ByteLevel" and step["use_regex"] and not step["add_prefix_space"]
        self.known: dict[str, bytes] = {}
        self.table = PieceTable()
        self.classes = byte_classes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def learned(self, pieces: list[str]) -> dict[str, bytes]:
        """The library's ids of pieces."""
        spaced = [p for p in pieces if _SPACED.fullmatch(p)]
        others = list(set(pieces).difference(spaced))
        found: dict[str, bytes] = {}
        joined = [spaced[k : k + 4096] for k in range(0, len(spaced), 4096)]
        for words, e in zip(joined, self.library.encode_batch(["".join(ws) for ws in joined], add_special_tokens=False), strict=True):
            word = np.array(e.word_ids, np.int64)
            if len(word) and word[-1] != len(words) - 1:  # not cut as expected
                others += words
                continue
            data = np.array(e.ids, "<u4").tobytes()
            ends = (4 * np.searchsorted(word, np.arange(len(words)), "right")).tolist()
            found.update(zip(words, [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        found.update(zip(others, self.whole(others), strict=True))
        return found

    def _remember(self, pieces: set[str]) -> dict[str, bytes]:
        if len(self.known) > KEPT // 4:
            self.known.clear()
        self.known.update(self.learned(list(pieces.difference(self.known))))
        return self.known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        usual = [self.by_piece and _USUAL.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        plain = [u and _LATIN.fullmatch(t) is not None for t, u in zip(texts, usual, strict=True)]
        pieces = [_PIECE.findall(t) if u and not p else [] for t, u, p in zip(texts, usual, plain, strict=True)]
        known = self._remember(set().union(*pieces)) if any(pieces) else {}
        odd = iter(self.whole([t for t, u in zip(texts, usual, strict=True) if not u]))
        by_class = iter(self.by_class([t for t, p in zip(texts, plain, strict=True) if p]))
        return [next(by_class) if p else b"".join([known[x] for x in ps]) if u else next(odd) for p, u, ps in zip(plain, usual, pieces, strict=True)]

    def cut(self, data: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The joined texts, where their pieces start, and where the texts end."""
        joined = b"".join(data)
        ends = np.cumsum([len(d) for d in data])
        c = self.classes[np.frombuffer(joined, np.uint8)]
        blank = c >= _SPACE
        start = np.zeros(len(c), bool)
        # a piece starts where the class changes, after a line break, and where white space begins; a space before
        # a word belongs to the word
        word = ~blank[1:] & (((c[1:] != c[:-1]) & ~blank[:-1]) | (c[:-1] == _BREAK))
        start[1:] = word | (blank[1:] & ~blank[:-1])
        # the last of several white characters before a word stands apart from the others
        start[1:-1] |= blank[1:-1] & blank[:-2] & ~blank[2:] & (np.isin(np.arange(2, len(c)), ends, invert=True) if len(c) > 2 else True)
        begins = np.concatenate([[0], ends[:-1]])
        start[begins[begins < len(c)]] = True
        return joined, np.flatnonzero(start), ends

    def by_class(self, texts: list[str]) -> list[bytes]:
        data = [t.encode() for t in texts]
        if not sum(map(len, data)):
            return [b""] * len(data)
        joined, start, ends = self.cut(data)
        size = np.diff(start, append=len(joined))
        table = self.table
        if len(table) > KEPT:
            table = self.table = PieceTable()
        padded = b"\0" * 8 + joined + b"\0" * 16
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        first, last = table.keys(words, start, np.minimum(size, 16))
        value = table.find(first, last)
        long = np.flatnonzero(size > 16)
        value[long] = 0
        missing = np.flatnonzero((value < 0) & (size <= 16))
        if len(missing):
            where = missing[_distinct(first[missing], last[missing])]
            names = [joined[a : a + m].decode() for a, m in zip(start[where].tolist(), size[where].tolist(), strict=True)]
            learned = self.learned(names)
            table.add(first[where], last[where], [learned[x] for x in names])
            value[missing] = table.find(first[missing], last[missing])
        count = table.at[value + 1] - table.at[value] if len(table) else np.zeros(len(value), np.int64)
        own: list[bytes] = []
        if len(long):
            names = [joined[a : a + m].decode() for a, m in zip(start[long].tolist(), size[long].tolist(), strict=True)]
            known = self._remember(set(names))
            own = [known[x] for x in names]
            count[long] = [len(x) // 4 for x in own]
        stop = np.cumsum(count)
        flat = np.empty(int(stop[-1]), np.uint32)
        short = np.ones(len(value), bool)
        short[long] = False
        n = count[short]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat[np.repeat((stop - count)[short], n) + inner] = table.flat[np.repeat(table.at[value[short]], n) + inner]
        if own:
            n = count[long]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat((stop - count)[long], n) + inner] = np.frombuffer(b"".join(own), "<u4")
        # tokens before the first piece at or after each text's end
        total = np.concatenate([[0], stop])
        bounds = total[np.searchsorted(start, ends)].tolist()
        raw = flat.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *bounds[:-1]], bounds, strict=True)]


def build(ids: np.ndarray, planes: int, doc_ids: list, lengths: list[int], part: int, shard: int) -> bytes:
    """The bytes of one shard file, without the end mark."""
    pack = zstandard.ZstdCompressor(level=1)
    sections: list[bytes] = []
    where = {}

    def put(name: str, data: bytes) -> None:
        where[name] = [sum(map(len, sections)), len(data)]
        sections.append(data)

    known = [d is not None for d in doc_ids]
    put("doc_ids", pack.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes()))
    put("lengths", pack.compress(np.array(lengths, "<i8").tobytes()))
    seq = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    chunks_at = []
    for level in range(planes - 1, -1, -1):
        bits = (seq & seq.dtype.type(1 << level)) != 0
        offsets, blobs, before, ones = [0], [], [], 0
        for k in range(0, max(len(bits), 1), CHUNK):
            part_bits = bits[k : k + CHUNK]
            blobs.append(pack.compress(np.packbits(part_bits, bitorder="little").tobytes()))
            before.append(ones)
            ones += int(np.count_nonzero(part_bits))
            offsets.append(offsets[-1] + len(blobs[-1]))
        put(f"ones{level}", pack.compress(np.array([*before, ones], "<u8").tobytes()))
        put(f"bits{level}", b"".join(blobs))
        chunks_at.append(offsets)
        seq = np.concatenate([np.compress(~bits, seq), np.compress(bits, seq)])
    head = {"n": len(ids), "planes": planes, "part": part, "shard": shard, "docs": len(lengths), "null_ids": known.count(False), "sections": where, "chunks": chunks_at}
    header = json.dumps(head, separators=(",", ":")).encode()
    return MAGIC + struct.pack("<I", len(header)) + header + b"".join(sections)


class Shard:
    """Reader of one shard file's bytes; chunks are decompressed only when a question needs them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or data[-4:] != END:
            raise ValueError("not a whole shard file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.head = json.loads(data[12 : 12 + size])
        self.data, self.base = data, 12 + size
        self.n, self.planes = self.head["n"], self.head["planes"]
        self.unpack = zstandard.ZstdDecompressor()
        self.ones = [np.frombuffer(self.unpack.decompress(self.section(f"ones{v}")), "<u8").astype(np.int64) for v in self.levels()]
        self.zeros = [self.n - int(o[-1]) for o in self.ones]

    def levels(self) -> range:
        return range(self.planes - 1, -1, -1)

    def section(self, name: str) -> bytes:
        at, size = self.head["sections"][name]
        return self.data[self.base + at : self.base + at + size]

    def bits(self, plane: int, chunk: int) -> np.ndarray:
        """The bits of one chunk of the plane (0: most significant)."""
        at, _ = self.head["sections"][f"bits{self.planes - 1 - plane}"]
        a, b = self.head["chunks"][plane][chunk : chunk + 2]
        raw = np.frombuffer(self.unpack.decompress(self.data[self.base + at + a : self.base + at + b]), np.uint8)
        return np.unpackbits(raw, bitorder="little", count=min(CHUNK, self.n - chunk * CHUNK)).astype(bool)

    def rank(self, plane: int, i: int) -> int:
        """Ones before place i of a plane."""
        chunk, rest = divmod(i, CHUNK)
        return int(self.ones[plane][chunk]) + (int(self.bits(plane, chunk)[:rest].sum()) if rest else 0)

    def select(self, plane: int, k: int, bit: bool) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ones = self.ones[plane]
        marks = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK, self.n) - ones
        chunk = int(np.searchsorted(marks, k, "right")) - 1
        bits = self.bits(plane, chunk)
        return chunk * CHUNK + int(np.flatnonzero(bits == bit)[k - int(marks[chunk])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            bit = bool(self.bits(p, i // CHUNK)[i % CHUNK])
            ones = self.rank(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, symbol: int, end: int) -> tuple[int, int]:
        a, b = 0, end
        for p in range(self.planes):
            if symbol >> (self.planes - 1 - p) & 1:
                a, b = self.zeros[p] + self.rank(p, a), self.zeros[p] + self.rank(p, b)
            else:
                a, b = a - self.rank(p, a), b - self.rank(p, b)
        return a, b

    def count(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of an id before place `end` (all by default)."""
        if symbol >> self.planes:
            return 0
        a, b = self._interval(symbol, self.n if end is None else end)
        return b - a

    def locate(self, symbol: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._interval(symbol, self.n)[0] + k
        for p in range(self.planes - 1, -1, -1):
            bit = bool(symbol >> (self.planes - 1 - p) & 1)
            i = self.select(p, i - self.zeros[p] if bit else i, bit)
        return i

    def tokens(self) -> np.ndarray:
        """All ids: the planes' partitions are undone from the last to the first."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for p in range(self.planes - 1, -1, -1):
            bits = np.concatenate([self.bits(p, c) for c in range(len(self.ones[p]) - 1)]) if self.n else np.zeros(0, bool)
            above = np.empty(self.n, kind)
            # by place, which is faster than by mask where bits look random
            above[np.flatnonzero(~bits)] = seq[: self.zeros[p]]
            above[np.flatnonzero(bits)] = seq[self.zeros[p] :] | kind(1 << (self.planes - 1 - p))
            seq = above
        return seq

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids of the documents (null ids first) and their numbers of tokens."""
        names = np.frombuffer(self.unpack.decompress(self.section("doc_ids")), "<i8").tolist()
        nulls = self.head["null_ids"]
        return [None] * nulls + names[nulls:], np.frombuffer(self.unpack.decompress(self.section("lengths")), "<i8")


def write(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id: str = "doc_id", text: str = "text", shard_tokens: int = 1 << 22) -> None:
    """Encode every text, add end_id, and write shard files below path in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_cache(f"pieces {tokenizer}", lambda: PieceEncoder(tokenizer))
        part, shard = TaskContext.get().partitionId(), 0
        end = struct.pack("<I", end_id)
        planes = max(encoder.planes, end_id.bit_length())
        held: list[bytes] = []
        names: list = []
        lengths: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, size
            data = build(np.frombuffer(b"".join(held), "<u4"), planes, names, lengths, part, shard)
            shard, size = shard + 1, 0
            held.clear(), names.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["payload"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                for name, ids in zip(rows.column(0).to_pylist(), encoder.encode([t or "" for t in rows.column(1).to_pylist()]), strict=True):
                    held.append(ids + end)
                    names.append(name)
                    lengths.append(len(ids) // 4 + 1)
                    size += lengths[-1]
                    if size >= shard_tokens:
                        yield flush()
        if lengths:
            yield flush()

    rows = df.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    sorted_rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    shards = sorted_rows.mapInArrow(run, "payload binary")
    # the text sink writes a column's bytes as they are, then the end mark
    writer = shards.select(F.col("payload").cast("string").alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", 1)
    with small_batches(df.sparkSession):
        writer.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, shard, place, doc_id, start, n_tokens, ids_crc32, ...) of every document in the files below path; start counts within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_py()
                if not data:
                    continue
                shard = Shard(data)
                names, lengths = shard.documents()
                flat = shard.tokens().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                m = len(names)
                columns = [pa.array([shard.head["part"]] * m, pa.int64()), pa.array([shard.head["shard"]] * m, pa.int64()), pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part long, shard long, doc_id long, start long, n_tokens long, ids_crc32 long")


def written(df: DataFrame, tokenizer: str, end_id: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write df's shards to the shared folder, read them back, and return (doc_id, start, n_tokens, ids_crc32) with start over all shards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write(df, path, tokenizer, end_id, id, text)
    docs = cut(read(spark, path))
    delete(spark, path)
    sizes = docs.groupBy("part", "shard").agg(F.sum("n_tokens").alias("size"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    # one row a partition that was written, in one task
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("size").over(across), F.lit(0)).alias("part_start"))
    shards = sizes.withColumn("shard_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    shards = shards.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("shard").alias("s"), (F.col("part_start") + F.col("shard_start")).alias("before"))
    placed = docs.join(shards, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s")))
    return placed.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
