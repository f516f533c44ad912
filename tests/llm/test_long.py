"""One text of thirty thousand words among short ones, through every operator."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, editfp, licenses, lm, mixing, quality, simhash, suffix, tokenbin


@pytest.fixture(scope="module")
def long_docs(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(1, 9))) for _ in range(4000)]
    text = " ".join(draw.choice(words) for _ in range(30_000))
    rows = [(1, "short text"), (2, text), (3, text[:5000] + "x"), (4, None)]
    return text, spark.createDataFrame(rows, "doc_id long, text string")


def test_row_operators(spark, long_docs):
    text, docs = long_docs
    at = lambda df: next(r for r in df.collect() if r.doc_id == 2)
    assert at(quality.judge(docs)).quality.n_words == 30_000
    assert at(licenses.scan(docs)).licenses.n_words == 30_000
    assert at(simhash.fingerprints(docs)).fp == simhash.simhash(text)
    assert at(editfp.fingerprints(docs))["print"] == editfp.embed([text])[0]
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids
    assert at(bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))).ids_sha256 == hashlib.sha256(" ".join(map(str, words)).encode()).hexdigest()


def test_corpus_operators(long_docs):
    text, docs = long_docs
    report = {r.doc_id: r for r in suffix.report(docs).collect()}
    assert (report[2].n_removed, report[3].n_removed, report[3].n_spans) == (0, 5000, 1)
    assert {r.doc_id: r.n_tokens for r in lm.score(docs).collect()} == {1: 3, 2: 30_001, 3: len((text[:5000] + "x").split()) + 1, 4: 1}
    bytes_ = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert {r.doc_id: r.n_tokens for r in tokenbin.written(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}[2] == len(bytes_) + 1
    assert sum(r["size"] for r in mixing.mix(docs.selectExpr("*", "'s' as source")).collect() if r.doc_id == 2) == 30_000
