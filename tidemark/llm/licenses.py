"""License scans by a positional index of rare template words.

The templates are the standard sentences of licences, a bounded list in this file. The index holds, for each
template word, its postings (template, position) and its inverse document frequency over the templates. From a
document only the words with the highest idf are looked up: those in at most `rare` templates, of which each
template has some. A posting met at word p of the document for position q of a template votes for that template
at offset p - q. Offsets with at least `votes` distinct positions agreeing are candidates; a candidate stands if
every mandatory phrase of the template is found at its own place, and its score is the share of the template's
words that stand where the offset puts them. A text may begin or end inside a notice: offsets may be negative, and
the words that are cut off lower the score.

Everything is arrays of one row and joins against literals: no shuffle, no user function. Texts without any
rare word are told apart by one regular expression and cost nothing more.

Null text counts as empty. Repeated rows get equal results. An empty table gives an empty result; very long
texts are scanned whole. Columns are handed through, whatever their names; what scan() adds is one struct, which
replaces an input column of its name.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, fixed, unused

#: What separates words: all ASCII but digits and small letters, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's sentence; every phrase in `needs` (words of the text) must stand at its place."""

    label: str
    text: str
    needs: tuple[str, ...]


# Notices by which the licences ask to be named, and the openings of their texts.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license", "redistribute it")),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    Template("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("deal in the software without restriction", "sublicense and or sell copies")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("this permission notice shall be included",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code must retain",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived",)),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("distributed in the hope that it will be useful", "gnu general public license")),
    Template("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("copy of the mpl",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization obtaining a copy",)),
    Template("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose", ("anyone is free to copy",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0", ("creativecommons org licenses by 4 0",)),
)

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Index:
    """postings: (word, idf, [(template number, position)]) of the rare words."""

    templates: tuple[Template, ...]
    postings: tuple[tuple[str, float, tuple[tuple[int, int], ...]], ...]


def index(templates: tuple[Template, ...] = TEMPLATES, rare: int = 4) -> Index:
    """The words in at most `rare` templates; a template without any adds the rarest it has."""
    where: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for k, t in enumerate(templates):
        for p, w in enumerate(t.text.split()):
            where[w].append((k, p))
    df = {w: len({k for k, _ in at}) for w, at in where.items()}
    chosen = {w for w, n in df.items() if n <= rare and not w.isdigit()}
    for t in templates:
        if not chosen.intersection(t.text.split()):
            chosen.add(min(t.text.split(), key=lambda w: (df[w], w)))
    idf = {w: math.log((1 + len(templates)) / (1 + df[w])) for w in chosen}
    return Index(templates, tuple((w, idf[w], tuple(where[w])) for w in sorted(chosen, key=lambda w: (-idf[w], w))))


def normal_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _starts(words: Column, phrase: str) -> Column:
    """Where a phrase's words stand consecutively, from 0."""
    parts = phrase.split(" ")

    def here(w: Column, i: Column) -> Column:
        fits = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            fits = fits & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(fits, i)

    return F.array_compact(F.transform(words, here))


def scan(df: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, text: str = "text", votes: int = 2, score: float = 0.5, into: str = "licenses") -> DataFrame:
    """df with the struct `into`: n_words, places (label, at of base phrases), found (label, at, score of templates)."""
    phrases = PHRASES if phrases is None else phrases
    idx = index(templates)
    w, hits, cand = (unused(df, f"{into}_{x}") for x in ("words", "hits", "candidates"))
    df = df.withColumn(w, normal_words(F.col(f"`{text}`")))
    none = F.array().cast("array<struct<label:string,at:int>>")
    first = [p.split(" ")[0] for p in phrases]

    def labelled(label: str):
        return lambda i: F.struct(F.lit(label).alias("label"), i.alias("at"))

    places = F.concat(*[F.transform(_starts(F.col(w), p), labelled(label)) for p, label in phrases.items()])
    places = F.when(F.arrays_overlap(F.col(w), F.array(*map(F.lit, first))), places).otherwise(none)
    # words of the index with their places in the text, then a vote for each of their postings
    rare = [word for word, _, _ in idx.postings]
    met = F.array_compact(F.transform(F.col(w), lambda x, i: F.when(x.isin(rare), F.struct(x.alias("w"), i.alias("at")))))
    df = df.withColumn(hits, F.when(F.arrays_overlap(F.col(w), F.array(*map(F.lit, rare))), met).otherwise(F.array().cast("array<struct<w:string,at:int>>")))
    posting = F.create_map(*[x for word, _, at in idx.postings for x in (F.lit(word), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in at]))])
    cast = F.flatten(F.transform(F.col(hits), lambda h: F.transform(posting[h["w"]], lambda x: F.struct(x["k"].alias("k"), (h["at"] - x["p"]).alias("o")))))
    # equal (template, offset) votes are neighbours once sorted; a run of them is one candidate
    df = df.withColumn(cand, F.sort_array(cast))
    need = F.array(*[F.lit(min(votes, sum(k == t for _, _, at in idx.postings for t, _ in at))) for k in range(len(templates))])
    agreed = F.filter(
        F.transform(
            F.col(cand),
            lambda x, i: F.struct(
                x["k"].alias("k"),
                x["o"].alias("o"),
                ((i == 0) | F.coalesce(F.get(F.col(cand), i - 1) != x, F.lit(True))).alias("first"),
                F.coalesce(F.get(F.col(cand), i + F.get(need, x["k"]) - 1) == x, F.lit(False)).alias("enough"),
            ),
        ),
        lambda x: x["first"] & x["enough"],
    )
    words_of = F.array(*[F.array(*map(F.lit, t.text.split())) for t in templates])
    needs_of = F.array(*[F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("w")) for p, s in _mandatory(t)]) for t in templates])
    df = df.withColumn(cand, agreed)

    def judged(c: Column) -> Column:
        whole = F.get(words_of, c["k"])
        same = F.size(F.filter(F.transform(whole, lambda x, p: F.coalesce(F.get(F.col(w), c["o"] + p) == x, F.lit(False))), lambda x: x))
        verified = F.forall(F.get(needs_of, c["k"]), lambda x: F.coalesce(F.get(F.col(w), c["o"] + x["p"]) == x["w"], F.lit(False)))
        labels = F.array(*[F.lit(t.label) for t in templates])
        return F.struct(F.get(labels, c["k"]).alias("label"), c["o"].alias("at"), F.when(verified, same / F.size(whole)).otherwise(F.lit(0.0)).alias("score"))

    found = F.filter(F.transform(F.col(cand), judged), lambda x: x["score"] >= score)
    return df.withColumn(into, fixed(F.struct(F.size(w).cast("long").alias("n_words"), places.alias("places"), found.alias("found")))).drop(w, hits, cand)


def _mandatory(t: Template) -> list[tuple[int, str]]:
    """(position, word) of the mandatory phrases in the template."""
    whole, out = t.text.split(), []
    for phrase in t.needs:
        parts = phrase.split()
        at = next(k for k in range(len(whole)) if whole[k : k + len(parts)] == parts)
        out += [(at + k, p) for k, p in enumerate(parts)]
    return out
