"""License scans by a positional index of rare words, with DataFrame functions alone.

A template is a licence's name, notice or phrase: its words, and the key phrases
in it that are mandatory. The first key phrase must stand at its place, the
others within SLACK words of theirs.

1. How many documents hold each word of the templates' first key phrases is
   counted over all documents. Of each template, the LOOKED_UP words of highest
   inverse document frequency are indexed, with their places in the template. A
   template that is anywhere in a file has these words there, so the choice
   decides the cost and never the result.
2. The words of a file that are indexed are looked up. A word at place i that
   stands at place p of a template posts a start, i - p.
3. Postings are sorted by template and start; where all looked-up words of a
   template post the same start, it is a candidate. Sorting makes this linear
   also for a file that is full of licence words.
4. A candidate is verified by its key phrases. Its score is the share of the
   template's words that stand at their places.

All of it is done row by row on arrays: no text is shuffled, so no hot key, source
or text can make a hot task. Only the counts of template words, some hundred rows
at most, reach the driver. Words are compared with A-Z in lower case; the rest of
Unicode stays as it is.

Defined cases: a null or blank text has no words and no licences. Repeated rows,
null and equal ids each get a row. Very long texts are read whole. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import id_and_text

LOOKED_UP, SLACK = 3, 5
#: Words, with A-Z not yet in lower case.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> list[str]:
    return [w.translate(str.maketrans(UPPER, LOWER)) for w in re.findall(WORD, text)]


@dataclass
class Template:
    """base: whether it is one of the phrases that every scan reports."""

    label: str
    words: list[str]
    phrases: list[tuple[int, list[str]]] = field(default_factory=list)  # place in words, words
    base: bool = False


def template(label: str, text: str, *phrases: str, base: bool = False) -> Template:
    """phrases: the mandatory ones, the telling one first; without any, the whole text."""
    words, found = words_of(text), []
    for phrase in phrases or (text,):
        part = words_of(phrase)
        found.append((next(i for i in range(len(words)) if words[i : i + len(part)] == part), part))
    return Template(label, words, found, base)


#: Phrases that every scan reports.
BASE = (
    template("gpl", "gnu general public license", base=True),
    template("apache", "apache license", base=True),
    template("cc-by", "cc by", base=True),
    template("mit", "mit license", base=True),
)
#: Names and notices of licences, with their mandatory phrases.
OWN = (
    template("gpl-2", "gnu general public license version 2"),
    template("gpl-3", "gnu general public license version 3"),
    template("gpl-3", "gnu gpl v3"),
    template("lgpl", "gnu lesser general public license"),
    template("agpl", "gnu affero general public license"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template(
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    template("cc-by-nc", "cc by nc"),
    template("cc-by-sa", "cc by sa"),
    template("cc-by-nd", "cc by nd"),
    template("cc-by", "creative commons attribution"),
    template("cc0", "cc0 1 0"),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "to deal in the software without restriction",
    ),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
        "redistribution and use in source and binary forms",
        "provided that the following conditions are met",
    ),
    template("bsd", "bsd license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    template("isc", "isc license"),
    template("mpl", "mozilla public license"),
    template("epl", "eclipse public license"),
    template("boost", "boost software license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    template("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    *(
        template(label, f"spdx license identifier {name}")
        for label, name in (
            ("agpl", "agpl 3 0"), ("apache-2.0", "apache 2 0"), ("boost", "bsl 1 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"),
            ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"), ("mpl", "mpl 2 0"),
        )
    ),
)
TEMPLATES = (*BASE, *OWN)


def lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, UPPER, LOWER)


def document_frequencies(rows: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many rows each wanted word stands, from rows of words; as many rows as wanted words reach the driver."""
    # lower() takes some signs of other scripts to a-z; what it lets through is looked at again.
    some = F.filter("words", lambda w: F.lower(w).isin(wanted))
    held = rows.select(F.explode(F.array_distinct(F.transform(some, lower))).alias("word")).where(F.col("word").isin(wanted))
    return {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}


def rare_words(templates: tuple[Template, ...], frequency: dict[str, int]) -> list[list[tuple[str, int]]]:
    """For each template, the words of its first key phrase that are looked up, and their places in the template."""
    found = []
    for t in templates:
        place, words = t.phrases[0]
        first = {w: place + i for i, w in reversed(list(enumerate(words)))}
        found.append(sorted(first.items(), key=lambda x: (frequency.get(x[0], 0), x[1]))[:LOOKED_UP])
    return found


def _table(rows: list, make) -> Column:
    return F.array(*[make(r) for r in rows])


def licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """One row per row of docs: id, n_words, found.

    found has an entry for each place of a template: label, base, start (a word's
    number, from 0), n (words) and score.
    """
    rows = id_and_text(docs, id_col, text_col).select("id", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    wanted = sorted({w for t in templates for w in t.phrases[0][1]})
    rare = rare_words(templates, document_frequencies(rows, wanted))
    indexed = sorted({w for found in rare for w, _ in found})

    postings = _table(
        [(w, number, place) for number, found in enumerate(rare) for w, place in found],
        lambda p: F.struct(F.lit(p[0]).alias("word"), F.lit(p[1]).alias("t"), F.lit(p[2]).alias("place")),
    )
    needed = _table(rare, lambda found: F.lit(len(found)))
    texts = _table(templates, lambda t: _table(t.words, F.lit))
    phrases = _table(
        templates,
        lambda t: _table(
            list(enumerate(t.phrases)),
            lambda p: F.struct(
                F.lit(p[1][0]).alias("place"), F.lit(len(p[1][1])).alias("n"), F.lit(f" {' '.join(p[1][1])} ").alias("text"),
                F.lit(SLACK if p[0] else 0).alias("slack"),
            ),
        ),
    )
    names = _table(templates, lambda t: F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(len(t.words)).alias("n")))

    def posted(hit: Column) -> Column:
        return F.transform(
            F.filter(postings, lambda p: p.word == hit.word), lambda p: F.struct(p.t, (hit.i - p.place).alias("start"), p.word)
        )

    def agreed(first: Column, j: Column) -> Column:
        """Whether this is the first of as many postings of one start as the template needs; each word posts it once."""
        last = F.get("posted", j + F.get(needed, first.t) - 1)
        return (last.t == first.t) & (last.start == first.start)

    def there(start: Column, phrase: Column) -> Column:
        a = F.greatest(F.lit(0), start + phrase.place - phrase.slack)
        b = F.least(F.col("n_words"), start + phrase.place + phrase.n + phrase.slack)
        window = F.array_join(F.slice("words", a + 1, F.greatest(F.lit(0), b - a)), " ")
        return F.contains(F.concat(F.lit(" "), lower(window), F.lit(" ")), phrase.text)

    def scored(c: Column) -> Column:
        own = F.get(texts, c.t)
        same = F.size(F.filter(own, lambda w, k: lower(F.get("words", c.start + k)) == w))
        name = F.get(names, c.t)
        return F.struct(name.label.alias("label"), name.base.alias("base"), c.start.alias("start"), name.n.alias("n"), (same / F.size(own)).alias("score"))

    hits = F.filter(
        F.transform("words", lambda w, i: F.when(F.lower(w).isin(indexed), F.struct(i.alias("i"), lower(w).alias("word")))),
        lambda h: h.isNotNull(),
    )
    none = F.array().cast("array<struct<t:int,start:int,word:string>>")
    any_hit = F.exists("words", lambda w: F.lower(w).isin(indexed))
    found = rows.select("id", "words", F.size("words").alias("n_words")).withColumn(
        "posted", F.when(any_hit, F.sort_array(F.flatten(F.transform(hits, posted)))).otherwise(none)
    )
    candidates = F.filter("posted", agreed)
    verified = F.filter(candidates, lambda c: F.forall(F.get(phrases, c.t), lambda p: there(c.start, p)))
    return found.select("id", F.col("n_words").cast("long").alias("n_words"), F.transform(verified, scored).alias("found"))
