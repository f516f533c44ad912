"""Fill-in-the-middle: texts cut in three and put together with the middle last, in DuckDB inside mapInArrow.

Each Arrow batch is registered as a table and one SQL statement turns it into the result, which goes back as Arrow: no
Python touches a row. A text is taken apart into its code points by regexp_extract_all, its parts are list_slices
joined by array_to_string, and where it is cut and which form it takes come from the sha256 of seed and id, so a rerun
or a retried task gives the same.

Null text is empty; empty texts, texts that hold one of the marks, and the share that is not to be transformed stay as
they are (plain). A null id draws as an empty one. Equal ids are cut by the same draws, so equal rows give equal rows. An
empty table gives an empty result. Other columns of the input are not looked at. A batch is handed on to DuckDB in slices
of about `limit` bytes, and at least a row, so memory goes with the longest text: some fifty bytes a code point.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes of text that DuckDB gets at a time.
AT_ONCE = 1 << 20


def statement(marks: tuple[str, str, str], share: int, spm: int) -> str:
    """The SQL of one batch, a table `batch` of (doc_id, draw, text)."""
    p, s, m = ("'" + x.replace("'", "''") + "'" for x in marks)
    draws = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::ubigint as h{k + 1}" for k in range(4))
    part = lambda a, b: f"array_to_string(list_slice(chars, {a}, {b}), '')"
    prefix, middle, suffix = part("1", "a"), part("a + 1", "b"), part("b + 1", "n")
    return f"""
with hashed as (select doc_id, coalesce(text, '') as text, sha256(draw) as h from batch),
drawn as (select doc_id, text, {draws}, regexp_extract_all(text, '(?s).') as chars from hashed),
counted as (select *, len(chars)::bigint as n from drawn),
placed as (select *, least(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as a, greatest(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as b,
  case when n = 0 or contains(text, {p}) or contains(text, {s}) or contains(text, {m}) or h3 % 100 >= {share} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end as form from counted)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  case form when 'plain' then text when 'psm' then {p} || {prefix} || {s} || {suffix} || {m} || {middle} else {s} || {suffix} || {p} || {prefix} || {m} || {middle} end as output
from placed"""


def transform(
    df: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    share: int = 90,
    spm: int = 20,
    seed: int = 1,
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
    limit: int = AT_ONCE,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row.

    `share` per cent of the texts are transformed, `spm` per cent of these suffix first, the others prefix first. n
    counts code points; the lengths are null where the text is plain. restored() takes an output back to its text.
    """
    check(marks)
    query = statement(marks, share, spm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                rows = max(1, int(limit * batch.num_rows / max(batch.nbytes, 1)))
                for k in range(0, batch.num_rows, rows):
                    con.register("batch", pa.Table.from_batches([batch.slice(k, rows)]))
                    yield from con.execute(query).to_arrow_table().to_batches()
                    con.unregister("batch")

    draw = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")))
    rows = df.select(F.col(f"`{id}`").alias("doc_id"), draw.alias("draw"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def check(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they stand: none empty or equal, and where one begins no other can go on."""
    if len(set(marks)) < 3 or not all(marks) or any(first[0] in other[1:] for first in marks for other in marks):
        raise ValueError("marks must differ, and their first characters must not stand further on in any of them")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made from; no text that was taken apart holds a mark, so splitting at them is exact."""
    check(marks)
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    whole = {f: F.concat(*[F.get(parts, F.lit(k)) for k in places]) for f, places in order.items()}
    return F.when(form == "psm", whole["psm"]).when(form == "spm", whole["spm"]).otherwise(output)
