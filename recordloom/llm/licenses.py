"""License scan by a positional rare-token index, in DataFrame functions only.

Templates are short licence notices.  How many documents hold each licence word is counted
over the whole corpus and gives the words' inverse document frequencies.  The index has for
each template the postings (word, template, position) of its rarest mandatory words: every
match of the template holds them, so they are the highest that a file with one can look up,
and nothing is lost by asking for no others.

A file's words are looked up once.  Each place of an indexed word and each of its postings
give a start that a template would have; the postings of a template intersect at a start
which all of them give.  There the mandatory phrases are verified word by word.

Everything about a file happens in its own row: no text is shuffled and no file's words
leave their task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import once

# Notices as their licences state them, with the phrases that must be there.
TEMPLATES: dict[str, list[tuple[str, list[str]]]] = {
    "mit": [
        ("Released under the MIT License.", ["mit license"]),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction",
            ["permission is hereby granted free of charge", "to deal in the software without restriction"],
        ),
    ],
    "apache": [
        ("Licensed under the Apache License, Version 2.0", ["licensed under the apache license"]),
        (
            "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
            ["except in compliance with the license"],
        ),
    ],
    "gpl": [
        ("licensed under the GNU General Public License, version 3", ["gnu general public license"]),
        (
            "it under the terms of the GNU General Public License as published by the Free Software Foundation",
            ["terms of the gnu general public license", "free software foundation"],
        ),
    ],
    "lgpl": [("under the terms of the GNU Lesser General Public License as published by", ["gnu lesser general public license"])],
    "agpl": [("under the terms of the GNU Affero General Public License as published by", ["gnu affero general public license"])],
    "bsd": [
        (
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met",
            ["redistribution and use in source and binary forms", "following conditions are met"],
        )
    ],
    "isc": [
        (
            "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted",
            ["permission to use copy modify", "with or without fee"],
        )
    ],
    "mpl": [("This Source Code Form is subject to the terms of the Mozilla Public License", ["mozilla public license"])],
    "cc-by-nc": [("Licensed under CC BY-NC 4.0", ["cc by nc"])],
    "cc-by-sa": [("Licensed under CC BY-SA 4.0", ["cc by sa"])],
    "unlicense": [
        ("This is free and unencumbered software released into the public domain", ["free and unencumbered software"])
    ],
}
# Phrases and labels of the contract's base columns.
BASE: dict[str, str] = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Different words that have to agree on a template's start (all of a shorter template's), and words of
#: each template that are indexed, if its phrases have as many.
MATCHES = 3


def words_of(text: str) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


class _Template:
    def __init__(self, label: str, text: str, phrases: list[str]) -> None:
        self.label, self.words = label, words_of(text)
        self.phrases = []
        for p in phrases:
            w = p.split()
            at = [k for k in range(len(self.words)) if self.words[k : k + len(w)] == w]
            if not at:
                raise ValueError(f"{p!r} isn't in its template")
            self.phrases.append((at[0], w))


def _templates() -> list[_Template]:
    return [_Template(label, *t) for label, ts in TEMPLATES.items() for t in ts]


#: Words too common in any text to be looked up or counted.
_PLAIN = set("a and any are as at by for in is it may of or that the this to use with you".split())


def licence_words() -> list[str]:
    return sorted({w for t in _templates() for w in t.words} - _PLAIN)


def _words(text: Column) -> Column:
    """Words in order.  Lowering more than A-Z changes neither where words begin and end nor
    whether a word of ASCII letters stands there."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BETWEEN, " ")
    return F.array_remove(F.split(spaced, " "), "")


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_frequencies(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many documents each licence word stands; counted over all of them."""
    found = docs.select(F.explode(F.array_intersect(_strings(licence_words()), _words(F.col(text_col)))).alias("w"))
    rows = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()  # the index's words at most
    return {r["w"]: r["n"] for r in rows}


def _phrase_at(words: Column, start: Column, phrase: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.get(words, start + k).eqNullSafe(F.lit(w)) for k, w in enumerate(phrase)])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A-Z are lowered; words are runs of ASCII letters and digits and anything not ASCII.
    ``n_base`` counts all places of base phrases, ``first_word`` and ``last_word`` are the least
    and greatest of their starts (null without any).  ``labels`` adds those of templates that
    match.  ``score`` is 1 with a base phrase, else the largest share of a matched template's
    indexed words that stand at their places, else 0.  Labels are distinct, sorted and joined
    by commas.  Null or empty texts have no words; null or repeated ids and repeated rows
    keep their rows; an empty table gives no rows; other columns are not read.
    """
    postings = index(word_frequencies(docs, text_col))
    asked = sorted({*postings, *(w for phrase in BASE for w in phrase.split())})
    # The words are kept only where one that is asked for is among them; whatever follows is null elsewhere.
    words = docs.select(F.col(id_col).alias("doc_id"), once(_words(F.col(text_col))).alias("_w"))
    words = words.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"), F.when(F.arrays_overlap("_w", _strings(asked)), F.col("_w")).alias("_w")
    )
    found = words.select("doc_id", "n_words", "_w", once(_base_places(F.col("_w"))).alias("_p"), once(_starts(F.col("_w"), postings)).alias("_s"))
    found = found.select("doc_id", "n_words", "_p", once(_matches(F.col("_w"), F.col("_s"))).alias("_t"))
    base_labels = F.transform("_p", lambda x: x["label"])
    labels = F.concat(base_labels, F.transform("_t", lambda x: x["label"]))
    starts = F.transform("_p", lambda x: x["place"].cast("long"))
    n_base = F.size("_p").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_t", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def index(counts: dict[str, int]) -> dict[str, list[tuple[int, int, int]]]:
    """By word: template, position, and how many words of the template are indexed."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for number, t in enumerate(_templates()):
        place: dict[str, int] = {}
        for at, phrase in t.phrases:
            for k, w in enumerate(phrase):
                place.setdefault(w, at + k)
        # Highest inverse document frequency first; words that aren't counted are in any text.
        rarest = sorted(place, key=lambda w: (w in _PLAIN, counts.get(w, 0), w))[:MATCHES]
        for w in rarest:
            out.setdefault(w, []).append((number, place[w], len(rarest)))
    return out


def _holds(words: Column, needed: list[str]) -> Column:
    """Whether all of these words are there, asked one after another until one isn't."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(words, w), F.lit(False)) for w in needed])


def _base_places(words: Column) -> Column:
    """Where base phrases stand, with their labels."""

    def places(phrase: list[str], label: str) -> Column:
        at = F.transform(words, lambda x, i: F.when((x == phrase[0]) & _phrase_at(words, i, phrase), F.struct(i.alias("place"), F.lit(label).alias("label"))))
        return F.when(_holds(words, phrase), F.array_compact(at)).otherwise(F.array().cast("array<struct<place:int,label:string>>"))

    return F.concat(*[places(phrase.split(), label) for phrase, label in BASE.items()])


def _starts(words: Column, postings: dict[str, list[tuple[int, int, int]]]) -> Column:
    """Templates and starts on which all postings of the template agree; null without an indexed word."""
    held = F.create_map(
        *[x for w, ps in sorted(postings.items()) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(n).alias("n")) for t, p, n in ps]))]
    )
    indexed = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains(_strings(sorted(postings)), x["w"]))
    given = F.flatten(
        F.transform(indexed, lambda x: F.transform(F.element_at(held, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("start"), p["n"].alias("n"))))
    )
    # A posting gives a start once, so a start that n of them give follows itself n - 1 times.
    agreed = F.transform(F.array(F.sort_array(given)), lambda all_: F.filter(all_, lambda x, k: x.eqNullSafe(F.get(all_, k + x["n"] - 1))))[0]
    return F.when(F.arrays_overlap(words, _strings(sorted(postings))), agreed)


def _matches(words: Column, starts: Column) -> Column:
    """Labels and shares of templates that stand at their starts, phrases and all."""
    templates = _templates()
    text = F.array(*[_strings(t.words) for t in templates])
    labels = _strings([t.label for t in templates])
    phrases = F.array(*[F.array(*[F.lit(at + k) for at, p in t.phrases for k in range(len(p))]) for t in templates])
    counted = [[k for k, w in enumerate(t.words) if w not in _PLAIN] for t in templates]
    others = F.array(*[F.array(*map(F.lit, ks)) for ks in counted])
    least = F.array(*[F.lit(min(MATCHES, len({t.words[k] for k in ks}))) for t, ks in zip(templates, counted)])

    def stands(s: Column, k: Column) -> Column:
        return F.get(words, s["start"] + k).eqNullSafe(F.get(F.get(text, s["t"]), k))

    def share(s: Column) -> Column:
        agreeing = F.size(F.filter(F.get(others, s["t"]), lambda k: stands(s, k)))
        verified = F.forall(F.get(phrases, s["t"]), lambda k: stands(s, k)) & (agreeing >= F.get(least, s["t"]))
        return F.when(verified, F.struct(F.get(labels, s["t"]).alias("label"), (agreeing / F.size(F.get(others, s["t"]))).alias("share")))

    return F.coalesce(F.array_compact(F.transform(starts, share)), F.array().cast("array<struct<label:string,share:double>>"))
