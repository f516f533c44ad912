"""Passages with runs of NUL bytes."""

import pytest

from tidemark.llm import suffix


@pytest.mark.parametrize("run", [15, 16, 17, 40, 200])
def test_windows_over_nul_bytes_are_in_segments(run):
    text = b"before it " * 5 + b"\0" * run + b"and then after" * 4
    _, _, start, size, _ = suffix.segments([(0, text)], 50)
    windows = [w for a, n in zip(start.tolist(), size.tolist(), strict=True) for w in range(a, a + n - 49)]
    assert sorted(windows) == list(range(len(text) - 49))


def test_a_passage_with_nul_bytes_is_removed(spark):
    passage = "shared words " + "\0" * 30 + " more shared words"
    rows = [(1, "the first text, " + passage + " and its end"), (2, "quite another: " + passage + "; then more")]
    found = {r.doc_id: r.text for r in suffix.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == rows[0][1]
    assert "\0" not in found[2] and len(found[2]) <= len(rows[1][1]) - len(passage)
