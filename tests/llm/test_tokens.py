import hashlib
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, tokenbin

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  ", "<|endoftext|>", "a<|startoftext|>b <|x|>", "İstanbul ΣΑΣ ß ﬁ Ａ", "日本語 テスト 123", "١٢٣ ½ ²", "x​y\x1cz\x85w\x0bq", "I'm you're IT'S 'S'd", "🙂🙂 é´", "don't''s !!'s", "a\x00b", "a  b   c \n\n d\n", "!!'re 's", "x 12ab3 é1"]


def test_word_bpe_equals_library(texts):
    library, own = Tokenizer.from_file(WORDS), bpe.ForcedBoundaryBPE(WORDS)
    for t in [t or "" for t in texts] + ODD:
        e = library.encode(t, add_special_tokens=False)
        assert own.encode(t) == e.ids, t
        assert own.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False), t


def test_a_small_memory_gives_the_same_ids(texts, monkeypatch):
    whole = bpe.ForcedBoundaryBPE(WORDS)
    want = [whole.encode(t or "") for t in texts]
    monkeypatch.setattr(bpe, "KEPT_CHARS", 40)
    own = bpe.ForcedBoundaryBPE(WORDS)
    assert [own.encode(t or "") for t in texts] == want
    assert sum(map(len, own.known)) < 10_000 and len(own.fragments) < 50


def test_cuts_cross_no_token():
    own = bpe.ForcedBoundaryBPE(WORDS)
    units = list("xq") + list("zzqj") + ["k</w>"]
    parts = own.cuts(units)
    assert [u for p in parts for u in p] == units
    assert tuple(i for p in parts for i in own.merged(p)) == own.merged(tuple(units))


def test_encode_decode_columns(docs, empty):
    library = Tokenizer.from_file(WORDS)
    both = bpe.decode(bpe.encode(docs, WORDS), WORDS)
    assert both.columns == [*docs.columns, "ids", "decoded"]
    for r in both.collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids == e.ids and r.decoded == library.decode(e.ids, skip_special_tokens=False)
    for r in bpe.digests(docs, WORDS).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        e = library.encode(r.text or "", add_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest() and r.n_tokens == len(e.ids)
    assert bpe.digests(empty, WORDS).count() == 0


def test_pieces_equal_library(texts):
    library, own = Tokenizer.from_file(BYTES), tokenbin.PieceEncoder(BYTES)
    all_texts = [t or "" for t in texts] + ODD
    for t, ids in zip(all_texts, own.encode(all_texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_pieces_of_every_length_are_told_apart():
    """All pieces of a letter and one other byte in it, and what differs only in the last bytes of a long piece."""
    library, own = Tokenizer.from_file(BYTES), tokenbin.PieceEncoder(BYTES)
    pieces = {"".join(p) for n in range(1, 7) for p in itertools.product("ay", repeat=n)}
    pieces |= {"a" * k + c + "a" * (n - k - 1) for n in range(1, 21) for k in range(n) for c in "abyzqé"}
    given = ["w aaaaaaaa aaaaaaaay z", *(f"{p} {p}" for p in sorted(pieces)), " ".join(sorted(pieces)), *(" " * k for k in range(1, 20)), *("\n" * k + "a" for k in range(1, 20)), *("0" * k for k in range(1, 20))]
    for t, ids in zip(given, own.encode(given), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    again = own.encode(given[::-1])[::-1]  # from memory
    assert again == own.encode(given)


@pytest.mark.parametrize("shard_tokens", [50, 1 << 22])
def test_shards_equal_library(spark, docs, empty, tmp_path, shard_tokens):
    library = Tokenizer.from_file(BYTES)
    path = str(tmp_path / "shards")
    tokenbin.write(docs, path, BYTES, 2, shard_tokens=shard_tokens)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = tokenbin.read(spark, path).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    placed = sorted(tokenbin.written(docs, BYTES).collect(), key=lambda r: r.start)
    assert [key((r.doc_id,))[:2] for r in placed] == sorted(key((w[0],))[:2] for w in want)
    at = 0
    for r in placed:
        assert r.start == at
        at += r.n_tokens
    assert tokenbin.written(empty, BYTES).count() == 0


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(1).integers(0, 300, 600_000).astype(np.uint32)
    shard = tokenbin.Shard(tokenbin.build(ids, 16, [None, 7], [200_000, 400_000], 3, 1) + tokenbin.END)
    assert (shard.tokens() == ids).all()
    assert shard.documents()[0] == [None, 7]
    for i in (0, 1, tokenbin.CHUNK - 1, tokenbin.CHUNK, 599_999):
        assert shard.access(i) == ids[i]
    for symbol in (0, 5, 299):
        places = np.flatnonzero(ids == symbol)
        assert shard.count(symbol) == len(places)
        assert shard.count(symbol, 300_000) == (places < 300_000).sum()
        assert [shard.locate(symbol, k) for k in (0, 700, len(places) - 1)] == places[[0, 700, -1]].tolist()
    assert shard.count(65_000) == 0
    with pytest.raises(IndexError):
        shard.locate(65_000, 0)
    with pytest.raises(ValueError):
        tokenbin.Shard(b"WAVELET1 cut off")


def test_the_piece_table_grows():
    table = tokenbin.PieceTable(bits=4)
    keys = np.arange(1, 5000, dtype=np.uint64)
    for part in np.array_split(keys, 7):
        table.add(part, part * np.uint64(3), [int(k).to_bytes(4, "little") * int(k % 3) for k in part])
    value = table.find(keys, keys * np.uint64(3))
    assert value.tolist() == list(range(len(keys))) and table.bits == 14
    assert table.find(keys[:5], keys[:5]).tolist() == [-1] * 5
    own = [table.flat[table.at[v] : table.at[v + 1]].tolist() for v in value]
    assert own == [[int(k)] * int(k % 3) for k in keys]


def test_more_pieces_than_slots(monkeypatch):
    whole = tokenbin.PieceTable
    monkeypatch.setattr(tokenbin, "PieceTable", lambda: whole(bits=6))
    own, library = tokenbin.PieceEncoder(BYTES), Tokenizer.from_file(BYTES)
    text = " ".join(f"{k * 7919 % 100003}" for k in range(3000))
    (ids,) = own.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
