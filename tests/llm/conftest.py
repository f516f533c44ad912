import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, words string, size long, key long, quality_text string, licenses_hits long, gone_id long, made string, row long, __text string"


CLASH = ("q", 4, 5, "m", 6, "t")


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empty and odd ones."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdeéz") for _ in range(draw.randrange(2, 9))) for _ in range(300)] + ["the", "of", "and"] * 30
    make = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = make(60)
    out = [None, "", " \t\n", "x", "The THE the", "a b c\nsame line here\nsame line here\nd", "🙂 é 日本語 １２ \x1c \x85 <|endoftext|> don't"]
    long_ones = [make(draw.randrange(60, 200)) for _ in range(30)]
    out += long_ones + long_ones[:4] + [t.replace(t.split()[30], "changed", 1) for t in long_ones[:6]]
    out += [make(20) + " " + passage + " " + make(10) for _ in range(5)] + ["the of and " * 400, "a" * 500, "ab" * 300]
    out += ["Released under the MIT License.\nAll rights reserved. all rights reserved", "GNU General Public License cc by 4.0", "Licensed under the Apache License, Version 2.0"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns whose names clash with the operators' own, a null id and a repeated row."""
    rows = [(k * 3 % 101, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), 1, "w", 2, 3, *CLASH) for k, t in enumerate(texts)]
    rows += [rows[9], (None, texts[8], "en", "s0", 1, 1, "w", 2, 3, *CLASH)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
