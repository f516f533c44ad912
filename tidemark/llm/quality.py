"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Every measure is a built-in expression over one row, so there is no shuffle, no user function and no state
between documents. Texts are used whole. A null text counts as empty and is rejected (it has no words). Rows
are judged one by one: repeated rows get equal verdicts, an empty table gives an empty result, and columns of
the input are handed through untouched, whatever their names: measures live in one struct column whose name is a
parameter, and which replaces an input column of that name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, fixed, unused, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from have in is it not of on or that the this to was were with "
    "aber als auch auf aus bei das dem den der des die ein eine einen für im ist mit nicht sich sie und von zu "
    "au aux ce dans de des du elle en est et il la le les par pas pour qui que sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Keep a document while low <= measure <= high; a missing bound never rejects."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are per word, per character or per line with a word, as their names say.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_length", low=3.0, high=10.0),
    Rule("symbols_per_word", high=0.1),
    Rule("stop_word_ratio", low=0.06),
    Rule("duplicate_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("upper_case_ratio", high=0.4),
)
BASE_RULES = RULES[:2]


def measured(df: DataFrame, text: str = "text", window: int = 3, into: str = "quality") -> DataFrame:
    """df with the struct column `into`: counts and ratios of each whole text.

    The steps are separate projections because Spark would otherwise work out an array anew for each of the
    places that use it.
    """
    t, w, s = (unused(df, f"{into}_{x}") for x in ("text", "words", "sorted"))
    df = df.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.withColumn(w, words(F.col(t)))
    n = F.size(w)
    starts = F.slice(F.col(w), F.lit(1), F.greatest(n - (window - 1), F.lit(0)))
    hashed = F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, window)]).alias("h"), i.alias("i")))
    df = df.withColumn(s, F.sort_array(hashed))
    last = F.size(s) - 1
    seen = F.transform(
        F.col(s),
        lambda x, i: F.when(
            ((i > 0) & (F.get(F.col(s), i - 1)["h"] == x["h"])) | ((i < last) & (F.get(F.col(s), i + 1)["h"] == x["h"])), x["i"]
        ),
    )
    positions = F.sort_array(F.array_compact(seen))
    empty = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).alias("at"))
    repeats = F.aggregate(
        positions,
        empty,
        lambda a, p: F.struct((a["sum"] + F.least(F.lit(window), p - a["at"])).alias("sum"), p.alias("at")),
        lambda a: a["sum"],
    )
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    low = F.transform(F.col(w), lambda x: F.rtrim(ascii_lower(x), F.lit(".,;:!?")))
    counts = {
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.regexp_replace(F.col(t), r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_chars": F.char_length(t).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"),
        "n_repeat_words": repeats,
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_upper": (F.char_length(t) - F.char_length(F.regexp_replace(F.col(t), "[A-Z]+", ""))).cast("long"),
        "n_stop_words": F.size(F.filter(low, lambda x: x.isin(STOP_WORDS))).cast("long"),
    }
    return df.withColumn(into, fixed(F.struct(*[c.alias(k) for k, c in counts.items()]))).drop(t, w, s)


def ratios(q: str = "quality") -> dict[str, Column]:
    """The measures that rules may name; a ratio over nothing is 0."""

    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(f"{q}.{a}").cast("double"), F.col(f"{q}.{b}").cast("double")), F.lit(0.0))

    return {
        "n_words": F.col(f"{q}.n_words"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "duplicate_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "upper_case_ratio": per("n_upper", "n_chars"),
    }


def compiled(rules: tuple[Rule, ...] = RULES, q: str = "quality") -> Column:
    """The table as one expression: the names of the rules that a row breaks, in the table's order."""
    known = ratios(q)
    broken = []
    for rule in rules:
        x = known[rule.measure]
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (x < F.lit(rule.low))
        if rule.high is not None:
            outside = outside | (x > F.lit(rule.high))
        broken.append(F.when(outside, F.lit(rule.measure)))
    return F.array_compact(F.array(*broken))


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """df with `into` (the counts) and `{into}_failed` (names of broken rules; empty: the document is kept)."""
    return measured(df, text, into=into).withColumn(f"{into}_failed", compiled(rules, into))


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule, with df's own columns."""
    into = unused(df, "quality")
    while f"{into}_failed" in df.columns:
        into += "_"
    judged = judge(df, rules, text, into)
    return judged.filter(F.size(f"{into}_failed") == 0).select(*[F.col(f"`{c}`") for c in df.columns])
