"""License scans with a positional index of rare licence words. DataFrame functions only.

Templates are licence notices as short runs of words with mandatory key
phrases. The index posts, for the rarest word of every key phrase (highest IDF
over all documents), where that word stands in its template. A file's words are
looked up there; a hit at file position ``p`` for template position ``q`` says
that the template would begin at ``p - q``. Hits of one template that agree on
that place (within ``SLACK`` words, for edited notices) support each other, and
every key phrase is verified word for word. Every place of a key phrase holds
its rarest word, so the lookup misses none. A notice whose phrases stand far
apart, or that is in use with different words between them, has a template for
each such distance, under one label.

``score`` is the best share of a template's key phrases verified at one place.
A template whose score is 1 gives its label. Base labels are templates of one
phrase.

Cases: a null or empty text has no words and no label and scores 0; repeated
rows are judged alike; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower

#: label, phrase: templates that are one phrase.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Words of public licence notices, and SPDX identifiers.
#: label, name, version words: licences that are named with their version, which follows the name in one of ``AFTER``.
VERSIONED = (
    ("gpl-2.0", "gnu general public license", "version 2"),
    ("gpl-3.0", "gnu general public license", "version 3"),
    ("lgpl-2.1", "gnu lesser general public license", "version 2 1"),
    ("lgpl-3.0", "gnu lesser general public license", "version 3"),
    ("agpl-3.0", "gnu affero general public license", "version 3"),
    ("gfdl-1.3", "gnu free documentation license", "version 1 3"),
    ("apache-2.0", "apache license", "version 2 0"),
    ("mpl-2.0", "mozilla public license", "version 2 0"),
    ("mpl-2.0", "mozilla public license", "v 2 0"),
    ("epl-2.0", "eclipse public license", "v 2 0"),
    ("epl-2.0", "eclipse public license", "version 2 0"),
    ("cddl-1.0", "common development and distribution license", "version 1 0"),
    ("bsl-1.0", "boost software license", "version 1 0"),
    ("ofl-1.1", "sil open font license", "version 1 1"),
    ("psf-2.0", "python software foundation license", "version 2"),
    ("osl-3.0", "open software license", "version 3 0"),
    ("afl-3.0", "academic free license", "version 3 0"),
    ("eupl-1.2", "european union public licence", "v 1 2"),
)
AFTER = (0, 1, 8)  # words between name and version: none, an abbreviation, "as published by the free software foundation either"
#: Versions named first: "under version 3 of the GNU General Public License".
BEFORE = ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0")
#: label, key phrases with their first word's place in the notice. Places of one notice grow.
NOTICES = (
    ("apache-2.0", ((0, "licensed under the apache license"), (5, "version 2 0"))),
    ("apache-2.0", ((0, "licensed under the apache license"), (5, "version 2 0"), (9, "you may not use this file except in compliance with the license"), (32, "http www apache org licenses license 2 0"))),
    ("mpl-2.0", ((0, "subject to the terms of the mozilla public license"), (9, "v 2 0"), (12, "if a copy of the mpl was not distributed with this file"))),
    ("mpl-2.0", ((0, "subject to the terms of the mozilla public license"), (9, "v 2 0"))),
    ("mit-notice", ((0, "permission is hereby granted free of charge"), (87, "the software is provided as is without warranty"))),
    ("mit-notice", ((0, "permission is hereby granted free of charge"), (66, "the above copyright notice and this permission notice shall be included"), (87, "the software is provided as is without warranty"))),
    ("bsd", ((0, "redistribution and use in source and binary forms"), (12, "are permitted provided that the following conditions are met"))),
    ("bsd-3-clause", ((0, "redistribution and use in source and binary forms"), (12, "are permitted provided that the following conditions are met"), (71, "neither the name of"))),
    ("isc", ((0, "permission to use copy modify and or distribute this software for any purpose"), (34, "the software is provided as is and the author disclaims all warranties"))),
    ("unlicense", ((0, "this is free and unencumbered software released into the public domain"), (11, "anyone is free to copy modify publish use compile sell or distribute this software"))),
    ("zlib", ((0, "this software is provided as is without any express or implied warranty"), (12, "in no event will the authors be held liable"))),
    ("postgresql", ((0, "permission to use copy modify and distribute this software and its documentation for any purpose without fee"),)),
    ("openssl", ((0, "this product includes software developed by the openssl project"),)),
    ("artistic-2.0", ((0, "the artistic license 2 0"),)),
    ("cc0-1.0", ((0, "cc0 1 0 universal"),)),
    ("cc-by-4.0", ((0, "creative commons attribution 4 0 international"),)),
    ("cc-by-sa-4.0", ((0, "creative commons attribution sharealike 4 0 international"),)),
    ("cc-by-nc-4.0", ((0, "creative commons attribution noncommercial 4 0 international"),)),
    ("cc-by-nd-4.0", ((0, "creative commons attribution noderivatives 4 0 international"),)),
    ("cc-by-nc-sa-4.0", ((0, "creative commons attribution noncommercial sharealike 4 0 international"),)),
    ("cc-by-nc-nd-4.0", ((0, "creative commons attribution noncommercial noderivatives 4 0 international"),)),
    ("cc-by-nc-4.0", ((0, "cc by nc"), (3, "4 0"))),
    ("cc-by-sa-4.0", ((0, "cc by sa"), (3, "4 0"))),
    ("cc-by-4.0", ((0, "cc by 4 0"),)),
)
#: Each is a template "SPDX-License-Identifier: <it>" under itself as label.
SPDX = (
    "mit", "apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "bsd-2-clause", "bsd-3-clause", "isc", "mpl-2.0",
    "unlicense", "cc0-1.0", "epl-2.0", "bsl-1.0", "zlib", "cc-by-4.0", "cc-by-sa-4.0", "ofl-1.1", "postgresql",
)
SLACK = 2
DRIFT = 7  # a later phrase may stand a DRIFT-th of its distance from its place
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def forms(phrases: tuple[tuple[int, str], ...]) -> list[tuple[tuple[int, str], ...]]:
    """The notice with its far phrases moved in steps that ``SLACK`` fills, up to a ``DRIFT``-th of their distance."""
    step = 2 * SLACK + 1
    most = [max(0, -(-(at // DRIFT - SLACK) // step)) for at, _ in phrases]
    moves = product(*(range(-m, m + 1) for m in most))
    return [tuple((at + step * k, words) for (at, words), k in zip(phrases, ks, strict=True)) for ks in moves]


def notices() -> list[tuple[str, tuple[tuple[int, str], ...]]]:
    """All templates of more than the base phrases: label and key phrases with their places."""
    out = []
    for label, name, version in VERSIONED:
        n = len(name.split())
        out += [(label, ((0, name), (n + gap, version))) for gap in AFTER]
        if label in BEFORE:
            out.append((label, ((0, version), (len(version.split()) + 2, name))))
    out += [(label, form) for label, phrases in NOTICES for form in forms(phrases)]
    return out + [(name, ((0, "spdx license identifier " + " ".join(re.split("[-.]", name))),)) for name in SPDX]


def key_phrases() -> list[dict]:
    """One row per key phrase: template, its label, the phrase's number, place and words, and how many the template has."""
    rows = []
    for t, (label, phrase) in enumerate(BASE):
        rows.append({"t": t, "label": label, "i": 0, "n": 1, "at": 0, "words": phrase.split(), "base": True})
    for t, (label, phrases) in enumerate(notices(), len(BASE)):
        for i, (at, phrase) in enumerate(phrases):
            rows.append({"t": t, "label": label, "i": i, "n": len(phrases), "at": at, "words": phrase.split(), "base": False})
    return rows


def words_of(text: Column) -> Column:
    r"""Runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def licence_words() -> list[str]:
    return sorted({w for p in key_phrases() for w in p["words"]})


def document_frequencies(words: DataFrame) -> DataFrame:
    """``word, df`` of the licence words over all rows of ``_words``; a row per licence word at most."""
    vocabulary = F.array(*[F.lit(w) for w in licence_words()])
    found = words.select(F.explode(F.array_intersect("_words", vocabulary)).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("df"))


def index(words: DataFrame) -> DataFrame:
    """The index as one row ``{word: [posting]}``: each key phrase under its word of the highest IDF (ties: the first)."""
    spark = words.sparkSession
    schema = "t int, label string, i int, n int, at int, words array<string>, base boolean"
    phrases = spark.createDataFrame([tuple(p.values()) for p in key_phrases()], schema)
    parts = phrases.select("*", F.posexplode("words").alias("_q", "word"))
    rated = parts.join(document_frequencies(words), "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = rated.groupBy(*phrases.columns).agg(F.min(F.struct("df", "_q", "word")).alias("_r"))
    posting = F.struct("t", "label", "i", "n", "words", "base", F.col("_r._q").alias("q"), (F.col("at") + F.col("_r._q")).alias("tq"))
    posts = rarest.groupBy(F.col("_r.word").alias("word")).agg(F.collect_list(posting).alias("posts"))
    return posts.agg(F.map_from_entries(F.collect_list(F.struct("word", "posts"))).alias("index"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    Two passes over the texts: one counts the licence words, one looks them up.
    Neither shuffles texts; the index has a posting per key phrase.
    """
    words = docs.select("doc_id", words_of(F.col("text")).alias("_words"))
    vocabulary = licence_words()
    hits = F.filter(
        F.transform("_words", lambda w, p: F.when(w.isin(vocabulary), F.struct(w.alias("w"), p.alias("p")))),
        lambda h: h.isNotNull(),
    )
    looked_up = words.select("doc_id", "_words", F.size("_words").cast("long").alias("n_words"), hits.alias("_hits")).where(F.lit(True))
    lookup = index(words).scalar()
    # A hit with its postings; words that index no phrase have none.
    posted = F.flatten(
        F.transform(
            "_hits",
            lambda h: F.transform(
                F.coalesce(F.try_element_at(F.col("_index"), h["w"]), F.array().cast(_POSTS)),
                lambda post: F.struct(post.alias("post"), (h["p"] - post["q"]).alias("start"), (h["p"] - post["tq"]).alias("origin")),
            ),
        )
    )
    verified = F.filter(
        posted,
        lambda x: (x["start"] >= 0) & (F.slice("_words", F.greatest(x["start"], F.lit(0)) + 1, F.size(x["post"]["words"])) == x["post"]["words"]),
    )
    any_hit = F.size("_hits") > 0
    places = looked_up.withColumn("_index", F.when(any_hit, lookup)).select(
        "doc_id", "n_words", F.when(any_hit, verified).otherwise(F.array().cast(_PLACES)).alias("_places")
    )
    base = F.filter("_places", lambda x: x["post"]["base"])
    starts = F.transform("_base", lambda x: x["start"].cast("long"))
    # Phrases of a notice that agree on where it begins: rounded to SLACK words
    # from two offsets, numbered template, band, phrase, so that equal bands are
    # neighbours after sorting.
    codes = F.flatten(
        F.transform(
            "_places",
            lambda x: F.transform(
                F.array(F.lit(0), F.lit(SLACK)),
                lambda shift: (
                    (x["post"]["t"].cast("long") * (1 << 40) + (F.floor((x["origin"] + shift + 2 * SLACK * 64) / (2 * SLACK)) * 2 + (shift > 0).cast("int")) * 16 + x["post"]["i"])
                ),
            ),
        )
    )
    out = places.withColumn("_base", base).withColumn("_codes", F.array_sort(F.array_distinct(codes)))
    runs = F.aggregate(
        "_codes",
        F.struct(F.lit(-1).cast("long").alias("band"), F.lit(0).alias("run"), F.array().cast("array<struct<t:int,run:int>>").alias("best")),
        lambda s, code: _step(s, code),
    )
    out = out.withColumn("_best", F.when(F.size("_codes") > 0, runs["best"]).otherwise(F.array().cast("array<struct<t:int,run:int>>")))
    templates = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(n).alias("n")) for t, label, n in _templates()])
    scored = F.transform(
        templates,
        lambda t: F.struct(
            t["label"].alias("label"),
            (F.coalesce(F.array_max(F.transform(F.filter("_best", lambda b: b["t"] == t["t"]), lambda b: b["run"])), F.lit(0)) / t["n"]).alias("score"),
        ),
    )
    out = out.withColumn("_scored", F.when(F.size("_best") > 0, scored).otherwise(F.array().cast("array<struct<label:string,score:double>>")))
    named = lambda entries: F.array_join(F.array_sort(F.array_distinct(entries)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(F.transform("_base", lambda x: x["post"]["label"])).alias("base_labels"),
        named(F.transform(F.filter("_scored", lambda s: s["score"] == 1.0), lambda s: s["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("_scored", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def _step(s: Column, code: Column) -> Column:
    """Count distinct phrases per (template, band); note a template's run when it grows past any noted for it so far."""
    band = F.floor(code / 16)
    run = F.when(band == s["band"], s["run"] + 1).otherwise(F.lit(1))
    noted = F.struct(F.floor(code / (1 << 40)).cast("int").alias("t"), run.alias("run"))
    best = F.when(F.array_contains(s["best"], noted), s["best"]).otherwise(F.array_append(s["best"], noted))
    return F.struct(band.alias("band"), run.alias("run"), best.alias("best"))


def _templates() -> list[tuple[int, str, int]]:
    return sorted({(p["t"], p["label"], p["n"]) for p in key_phrases()})


_POST = "struct<t:int,label:string,i:int,n:int,words:array<string>,base:boolean,q:int,tq:int>"
_POSTS = f"array<{_POST}>"
_PLACES = f"array<struct<post:{_POST},start:int,origin:int>>"
