"""Licence notices in texts, found by a positional index of their rarest words.

A template is a notice as a sequence of words with mandatory key phrases in it. Over all documents it is counted how many have
each word of a key phrase, which gives the words' inverse document frequencies.

1. *Index.* Each template is posted under the ``RARE`` words of its key phrases with the highest frequency of that kind,
   with their positions in the template.
2. *Look-up.* A text's words that are in the index are its rare licence words. Each says where the templates that it is posted for
   would begin: its own position less that in the template.
3. *Intersection by relative position.* Only beginnings on which a template's rare words agree are left.
4. *Verification.* Every key phrase must stand, word by word, at its place, and ``LEAST`` of all words of the template.

As a notice has all words of its key phrases, the look-up loses none. A short phrase is a template that is one key phrase.
All of it is expressions over a row: texts stay where they are and nothing is shuffled but the counts of words,
of which there are as many as words in key phrases.

Words are runs of ASCII letters, digits and anything that is not ASCII; A to Z are lower-cased. Null texts count as empty and have no words
or places. Repeated rows each give a row, of which all places are listed; an empty table gives none. Only the id and the
text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words, with each character that ends one listed: Java looks these up in a table, but tries ranges one after the other.
LISTED = "[^" + "".join(f"\\x{c:02X}" for c in range(0x80) if not re.fullmatch(WORD, chr(c))) + "]+"
RARE, LEAST = 2, 0.75
#: The one letter beyond ASCII that lower-cases into ASCII, and what it is replaced by.
KELVIN, OTHER = "\u212a", "\ufffd"

#: Phrases that name a licence, with its label.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Notices of public licences with their labels and mandatory key phrases.
NOTICES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "software and associated documentation files"),
    ),
    (
        "boost-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation",
        ("any person or organization", "the software and accompanying documentation"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("permission to use copy modify", "for any purpose with or without fee is hereby granted"),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "the following conditions are met"),
    ),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("not use this file except in compliance with the license",),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("source code form is subject to the terms of the mozilla public license",),
    ),
    ("gpl", "under the gnu general public license", ("gnu general public license",)),
    ("gpl", "under the terms of the gnu general public license", ("terms of the gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("epl", "under the terms of the eclipse public license", ("terms of the eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    (
        "cc0-1",
        "waived all copyright and related or neighboring rights to this work",
        ("waived all copyright and related or neighboring rights",),
    ),
    ("cc-by", "under a creative commons attribution 4 0 international license", ("under a creative commons attribution", "international license")),
    ("cc-by-sa", "under a creative commons attribution sharealike 4 0 international license", ("under a creative commons attribution sharealike",)),
    ("cc-by-nc", "under a creative commons attribution noncommercial 4 0 international license", ("under a creative commons attribution noncommercial",)),
)


@dataclass(frozen=True)
class Template:
    """A notice; ``keys`` are (position, words) of its mandatory phrases."""

    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]
    is_phrase: bool = False

    @classmethod
    def of(cls, label: str, text: str, keys: tuple[str, ...] | None = None) -> Template:
        words, placed = tuple(text.split()), []
        for key in keys or (text,):
            phrase = tuple(key.split())
            places = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
            if not places:
                raise ValueError(f"{key!r} is not in the notice of {label}")
            placed.append((places[0], phrase))
        return cls(label, words, tuple(placed), keys is None)

    def key_words(self) -> dict[str, int]:
        """Position of each word of the key phrases, its first one."""
        found: dict[str, int] = {}
        for start, phrase in self.keys:
            for k, word in enumerate(phrase):
                found.setdefault(word, start + k)
        return found


TEMPLATES = tuple(Template.of(*x) for x in (*PHRASES, *NOTICES))


def _words(text: str | Column) -> Column:
    lowered = F.lower(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.regexp_extract_all(lowered, F.lit(LISTED), F.lit(0))


def document_frequencies(docs: DataFrame, text_column="text", templates=TEMPLATES) -> dict[str, int]:
    """In how many rows of ``docs`` each word of a key phrase occurs."""
    wanted = sorted({word for t in templates for word in t.key_words()})
    found = docs.select(_words(text_column).alias("words"))
    found = found.select(F.explode(F.array_distinct(F.filter("words", lambda w: w.isin(wanted)))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {word: counts.get(word, 0) for word in wanted}


def rare_words(template: Template, frequencies: dict[str, int], rare=RARE) -> list[tuple[str, int]]:
    """The rarest words of a template's key phrases with their positions; of equally rare ones the first in order."""
    words = template.key_words()
    return [(word, words[word]) for word in sorted(words, key=lambda w: (frequencies[w], w))[:rare]]


def find_notices(docs: DataFrame, id_column="doc_id", text_column="text", templates=TEMPLATES, rare=RARE, least=LEAST) -> DataFrame:
    """Rows (doc_id, n_words, places), one for each row of ``docs``; a place is a struct of the label, whether it is that of a
    phrase, the first word's number and the share of the template's words in their place."""
    frequencies = document_frequencies(docs, text_column, templates)
    posted = [rare_words(t, frequencies, rare) for t in templates]
    index = sorted({word for words in posted for word, _ in words})

    rows = docs.select(F.col(id_column).alias("doc_id"), _words(text_column).alias("words"))
    hit = lambda w, i: F.when(w.isin(index), F.struct(i.alias("at"), w.alias("word")))
    rows = rows.withColumn("hits", F.array_compact(F.transform("words", hit)))

    def beginnings(word: str, position: int) -> Column:
        return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - position)

    def verified(start: Column, template: Template) -> Column:
        holds = F.lit(True)
        for position, phrase in template.keys:
            holds = holds & (F.slice("words", start + position + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase)))
        return F.when(start >= 0, holds).otherwise(False)

    def in_place(start: Column, template: Template) -> Column:
        same = [F.coalesce(F.get("words", start + k) == word, F.lit(False)).cast("int") for k, word in enumerate(template.words)]
        return sum(same[1:], same[0]) / F.lit(len(template.words))

    def places(template: Template, words: list[tuple[str, int]]) -> Column:
        starts = beginnings(*words[0])
        for other in words[1:]:
            starts = F.array_intersect(starts, beginnings(*other))
        found = F.transform(
            F.filter(starts, lambda s: verified(s, template)),
            lambda s: F.struct(
                F.lit(template.label).alias("label"), F.lit(template.is_phrase).alias("is_phrase"),
                s.cast("bigint").alias("word"), in_place(s, template).alias("share"),
            ),
        )
        return F.filter(found, lambda p: p["share"] >= least)

    listed = F.flatten(F.array(*(places(t, words) for t, words in zip(templates, posted))))
    none = F.array().cast("array<struct<label:string,is_phrase:boolean,word:bigint,share:double>>")
    return rows.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.when(F.size("hits") > 0, listed).otherwise(none).alias("places")
    )


def summary(docs: DataFrame, id_column="doc_id", text_column="text", templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: its words, the places of phrases, and the labels of phrases and of all notices."""
    found = find_notices(docs, id_column, text_column, templates)
    found = found.withColumn("base", F.filter("places", lambda p: p["is_phrase"]))
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(places["label"])), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base")["word"]).alias("first_word"),
        F.array_max(F.col("base")["word"]).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.col("places")["share"]), F.lit(0.0)).alias("score"),
    )


def brute_force_sql(templates=TEMPLATES, least=LEAST) -> str:
    """SQL that tries every template at every word of every document."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    parts = []
    for t in templates:
        keys = " AND ".join(f"a[s + {p + 1}:s + {p + len(words)}] = {listed(words)}" for p, words in t.keys)
        share = f"len(list_filter(range(0, {len(t.words)}), lambda k: a[s + k + 1] = {listed(t.words)}[k + 1])) / {len(t.words)}"
        parts.append(
            f"CASE WHEN list_has_all(a, {listed(t.key_words())}) THEN list_transform(list_filter(range(0, len(a)), lambda s: {keys}), "
            f"lambda s: {{'label': '{t.label}', 'is_phrase': {str(t.is_phrase).lower()}, 'word': s, 'share': {share}}}) ELSE [] END"
        )
    places = ",\n            ".join(parts)
    return rf"""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS a
        FROM documents
    ), p AS (
        SELECT doc_id, len(a) AS n_words, list_filter(flatten([
            {places}]), lambda x: x.share >= {least}) AS places
        FROM w
    ), b AS (SELECT *, list_filter(places, lambda x: x.is_phrase) AS base FROM p)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
        CAST(list_min(list_transform(base, lambda x: x.word)) AS BIGINT) AS first_word,
        CAST(list_max(list_transform(base, lambda x: x.word)) AS BIGINT) AS last_word,
        array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS labels,
        CAST(coalesce(list_max(list_transform(places, lambda x: x.share)), 0) AS DOUBLE) AS score
    FROM b"""
