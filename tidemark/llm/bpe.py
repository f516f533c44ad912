"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever build a token of the vocabulary. So where two neighbouring symbols never stand side by
side inside any token, no merge crosses: that place is a certain cut, and the fragments on both sides can be
encoded independently and their ids concatenated. Fragments are short and few are distinct, so each is encoded
once a task and kept.

The vocabulary file is one of the tokenizers library (BPE with an end-of-word suffix, over byte symbols), and
ids equal the library's: text between special tokens is normalised and cut into words as the file says, each
word is turned to byte symbols, split at forced boundaries, and merged. For texts of Latin letters, digits and
usual punctuation the normaliser and the word pattern are applied here; any other character sends the text
through the library's own normaliser and pre-tokenizer, so Unicode details are always the library's.

Null text counts as empty and has no ids; its decoded text is empty. Rows are handled one by one: repeated rows
get equal results, an empty table an empty result, and a text of any length is taken whole. Columns other than
the text are handed through, whatever their names; a result column replaces an input column of its name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, lean

#: Letters whose class, lower case and composition no Unicode version changes; I with a dot is left to the library.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ſ"
_USUAL = re.compile(rf"[\t\n\r !-~¡¿«»–—‘’“”„…€{_LETTERS}]*")
#: Entries of a task's memory, and code points of the words in it, before it starts afresh.
KEPT, KEPT_CHARS = 250_000, 3 << 20
#: Symbols of a fragment up to which each merge looks at all pairs that are left; beyond, all places of a pair are merged at a time.
SHORT = 64


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in set(shown))}
    return [chr(hidden.get(b, b)) for b in range(256)]


class ForcedBoundaryBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.symbols = byte_symbols()
        self.inside = {p for t in self.vocab for w in [self.units(t)] for p in zip(w, w[1:])}
        self.library = Tokenizer.from_file(path)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        plain = split.replace("\\p{L}", _LETTERS).replace("\\p{N}", "0-9")
        self.word = re.compile(plain)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known_chars = self.fragment_chars = 0
        self.known: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[tuple[str, ...], tuple[int, ...]] = {}

    def units(self, token: str) -> list[str]:
        """The symbols of a token; the last one carries the end-of-word suffix if the token does."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return [*token[:-1], token[-1] + self.suffix]
        return list(token)

    def cuts(self, units: list[str]) -> list[tuple[str, ...]]:
        """The fragments between forced boundaries."""
        found, start = [], 0
        for k in range(1, len(units)):
            if (units[k - 1], units[k]) not in self.inside:
                found.append(tuple(units[start:k]))
                start = k
        return [*found, tuple(units[start:])]

    def merged(self, fragment: tuple[str, ...]) -> tuple[int, ...]:
        """The ids of one fragment: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = list(fragment)
        ranks, vocab = self.ranks, self.vocab
        if len(parts) <= SHORT:
            get, none = ranks.get, len(ranks)
            found = [get(p, none) for p in zip(parts, parts[1:])]
            while found and (best := min(found)) < none:
                k = found.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del found[k]
                if k:
                    found[k - 1] = get((parts[k - 1], parts[k]), none)
                if k < len(found):
                    found[k] = get((parts[k], parts[k + 1]), none)
            return tuple([vocab[p] for p in parts if p in vocab])
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: ranks.get(p, len(ranks)))
            if best not in ranks:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == best:
                    out.append(best[0] + best[1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return tuple(vocab[p] for p in parts if p in vocab)

    def of_symbols(self, word: str) -> tuple[int, ...]:
        """The ids of a word given in byte symbols."""
        units = [*word[:-1], word[-1] + self.suffix]
        ids: tuple[int, ...] = ()
        parts = self.cuts(units)
        if len(parts) == 1:  # of_word's callers remember whole words
            return self.merged(parts[0])
        for fragment in parts:
            if fragment not in self.fragments:
                self.fragment_chars += sum(map(len, fragment))
                if len(self.fragments) >= KEPT // 4 or self.fragment_chars > KEPT_CHARS // 4:
                    self.fragments.clear()
                    self.fragment_chars = 0
                self.fragments[fragment] = self.merged(fragment)
            ids += self.fragments[fragment]
        return ids

    def of_word(self, word: str) -> tuple[int, ...]:
        return self.of_symbols("".join(map(self.symbols.__getitem__, word.encode("utf-8"))))

    def stretch(self, text: str) -> tuple[dict, list[str]]:
        """Words of a text without special tokens, and where to look up the ids of each."""
        if _USUAL.fullmatch(text):
            words, make = self.word.findall(text.lower()), self.of_word
            table = self.known
        else:
            normal = self.library.normalizer.normalize_str(text)
            words, make = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)], self.of_symbols
            table = {}
        if len(self.known) > KEPT or self.known_chars > KEPT_CHARS:
            self.known.clear()
            self.known_chars = 0
        for w in set(words).difference(table):
            table[w] = make(w)
            self.known_chars += len(w) if table is self.known else 0
        return table, words

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        text = text or ""
        for part in self.specials.split(text) if any(s in text for s in self.special) else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                table, words = self.stretch(part)
                ids += chain.from_iterable(map(table.__getitem__, words))
        return ids

    def decode(self, ids: list[int]) -> str:
        """As the library decodes when the file names no decoder: the tokens joined by a space; unknown ids are left out."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def _with_column(df: DataFrame, given: str, into: str, kind: str, arrow: pa.DataType, path: str, work) -> DataFrame:
    """df with the column `into`, made by work(codec, value) from the column `given`; the others travel in one struct, whatever their names."""
    others = [c for c in df.columns if c != into]
    row = F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ForcedBoundaryBPE(path)  # goes with the task: an idle worker holds none
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                made = pa.array([work(codec, x.as_py()) for x in part.column(0)], arrow)
                yield pa.RecordBatch.from_arrays([made, part.column(1)], ["made", "row"])

    sent = df.select(F.col(f"`{given}`").alias("given"), row)
    schema = df.select(F.lit(None).cast(kind).alias("made"), row).schema
    return sent.mapInArrow(lean(run), schema).select(*[F.col(f"row.`{c}`").alias(c) for c in others], F.col("made").alias(into))


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of each whole text, as array<int>."""
    return _with_column(df, text, into, "array<int>", pa.list_(pa.int32()), path, lambda codec, t: codec.encode(t))


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text that each row's ids stand for."""
    return _with_column(df, ids, into, "string", pa.string(), path, lambda codec, x: codec.decode(x or []))


def digests(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, so no ids are moved to Spark and back.

    Worked out once, to a checkpoint, over batches of bounded bytes, so a worker's memory does not depend on the length of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ForcedBoundaryBPE(path)  # goes with the task: an idle worker holds none
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for t in batch.column(1):
                ids = codec.encode(t.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(lean(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"))
