"""Text operators against plain readings of their rules, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidemill.llm import decontaminate, jaccard, licenses, mixing, quality, suffixes, wavelet
from tidemill.llm.components import components
from tidemill.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, _words string, h string"


def documents(spark, texts, sources=None):
    """Rows with extra columns whose names the operators use inside."""
    rows = []
    for i, text in enumerate(texts):
        source = sources[i] if sources else "a"
        rows.append((i, text, "en", source, len(text or ""), 1, "x", "y", "z"))
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [None, "", " ", "\n\t", "x", "É é", "a b c d", "a b c d", "." * 200, "word " * 30000]


# -- licences ---------------------------------------------------------------
def test_licences(spark):
    texts = [
        *AWKWARD,
        "Released under the MIT License.",
        "gnu GENERAL public license, version 3 and Apache License Version 2.0 cc-by",
        "licensed under the Apache License, Version 2.0. mit license mit license",
        "apache x license",
        "Licensed under CC BY-NC 4.0.",
    ]
    got = {r.doc_id: r for r in licenses.scan(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        lower = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        places = [(p, label) for label, phrase in licenses.BASE for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        starts = [p for p, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    n = len(AWKWARD)
    assert got[n + 1].labels == "apache,cc-by,gpl,gpl-3.0"
    assert got[n + 2].labels == "apache,apache-2.0,mit"
    assert got[n + 4].labels == "cc-by,cc-by-nc-4.0"


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""


def test_standard_notices(spark):
    duckdb = pytest.importorskip("duckdb")
    cases = {
        "int main() {}\nCopyright (c) 2020 Someone\n" + MIT: "mit-notice",
        MIT.replace("and this permission notice", "and this permission notice (including the next paragraph)"): "mit-notice",
        MIT.replace("and associated documentation files ", ""): "mit-notice",
        MIT.replace("THE SOFTWARE IS PROVIDED", "x " * 30 + "THE SOFTWARE IS PROVIDED"): "",
        GPL: "gpl,gpl-3.0",
        GPL.replace("version 3", "version 2"): "gpl,gpl-2.0",
        GPL.replace("either version 3 of the License", "version 3"): "gpl,gpl-3.0",
        "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991": "gpl,gpl-2.0",
        "under the terms of version 2 of the GNU General Public License as published by the": "gpl,gpl-2.0",
        GPL.replace("either version 3", "x " * 30 + "version 3"): "gpl",
        "* " + BSD: "bsd",
        "/* " + MPL + " */": "mpl-2.0",
        "x = 1\n" + APACHE: "apache,apache-2.0",
    }
    docs = documents(spark, list(cases))
    got = licenses.scan(docs)
    assert [r.labels for r in got.orderBy("doc_id").collect()] == list(cases.values())
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = con.execute(ORACLES["op1_license_scan"])
    columns = [d[0] for d in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(columns).collect())


# -- quality ------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(5, 300)) for _ in range(300)] + [("%%% " + prose(rng, rng.randrange(5, 200))).upper().replace(" ", "!! ") for _ in range(150)] + AWKWARD
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(450)] + [(0, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(out) == len(texts)
    held = [r for i, r in out.items() if i < 450 and r.held_out]
    assert {r.doc_id for r in out.values() if r.held_out} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == int(r.doc_id < 300) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in out.items() if r.predicted}


def test_quality_without_one_class(spark):
    docs = documents(spark, ["a b", None])
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score_documents(docs, labels).collect()} == {1.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0


# -- decontamination ------------------------------------------------------------
def test_contaminated(spark):
    rng = random.Random(2)
    items = [prose(rng, 30, 5000) for _ in range(6)] + ["too short", "", None]
    edited = items[1].split()
    edited[5], edited[20] = "changed", "words"
    del edited[12]
    half = " ".join(items[2].split()[:8])
    texts = [*AWKWARD, prose(rng, 200, 5000) + " " + items[0].upper() + "! " + prose(rng, 50, 5000), " ".join(edited), half + " " + prose(rng, 100, 5000), items[3] + " " + items[4], items[3] + " " + items[4]]
    docs = documents(spark, texts)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contaminated(docs, benchmark).collect()
    n = len(AWKWARD)
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, 0), (n + 1, 1), (n + 3, 3), (n + 3, 4), (n + 4, 3), (n + 4, 4)]
    exact = next(r for r in got if r.doc_id == n)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 200, 229)
    assert 0.7 < next(r for r in got if r.doc_id == n + 1).score < 1
    kept = decontaminate.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [*range(n), n + 2]
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.clean(docs.limit(0), benchmark).count() == 0


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 20, 400)) for i in range(9)]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    assert sum(len(b.ids) for b in decontaminate.blocks(benchmark, 45)) == 9
    assert max(sum(map(len, b.words)) for b in decontaminate.blocks(benchmark, 45)) <= 45


@pytest.mark.parametrize("beside", [False, True], ids=["alone", "beside an exact copy"])
def test_edited_copies_equal_alignment_without_seeds(spark, beside):
    rng = random.Random(4)
    items = [prose(rng, rng.randrange(16, 27), 5000) for _ in range(12)]
    texts = list(items) if beside else []
    for every in (0.1, 0.15, 0.2, 0.25, 4, 5):
        for item in items:
            words = [f"new{rng.randrange(10**6)}" if (k % every == every - 1 if every > 1 else rng.random() < every) else w for k, w in enumerate(item.split())]
            texts.append(prose(rng, 40, 5000) + " " + " ".join(words) + " " + prose(rng, 40, 5000))
    texts += [" ".join(w for word in items[0].split() for w in (word, "between")), " ".join(w for k, w in enumerate(items[1].split()) if k % 3), "of the"]
    items.append("nothing of the sort")
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in decontaminate.contaminated(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    number = {}
    coded = lambda text: np.array([number.setdefault(w, len(number)) for w in decontaminate.words_of(text)])
    scores = {(d, i): decontaminate.align(coded(item), coded(text))[0] / (2 * len(item.split())) for d, text in enumerate(texts) for i, item in enumerate(items)}
    assert got == {k: round(s, 9) for k, s in scores.items() if s >= 0.5 and k[1] < 12}
    assert len(got) >= 12 * 5 + 12 * beside


def test_passages_of_long_items(spark):
    rng = random.Random(5)
    items = [prose(rng, n, 5000) for n in (59, 300, 300)]
    part = lambda i, a, n: " ".join(items[i].split()[a : a + n])
    put = lambda text: prose(rng, 60, 5000) + " here " + text + " there " + prose(rng, 60, 5000)
    edited = part(2, 100, 30).split()
    edited[8], edited[20] = "changed", "words"
    texts = [put(part(0, 10, 25)), put(part(1, 90, 120)), put(part(1, 200, 13)), put(part(1, 0, 11)), put(" ".join(edited)), put(part(2, 287, 13)) + put(part(0, 0, 10))]
    docs, benchmark = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.last_word) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert sorted(got) == [(0, 0), (1, 1), (2, 1), (4, 2), (5, 2)]
    assert got[0, 0] == (25 / 59, 61, 85)
    assert got[1, 1] == (0.4, 61, 180)
    assert got[2, 1] == (13 / 300, 61, 73)
    assert [r.doc_id for r in decontaminate.clean(docs, benchmark).collect()] == [3]


@pytest.mark.parametrize("seed", range(5))
def test_alignment_equals_the_plain_recurrence(seed):
    rng = np.random.default_rng(seed)
    item, doc = rng.integers(0, 4, 12), rng.integers(0, 4, 25)
    table = np.zeros((13, 26), int)
    for i in range(12):
        for j in range(25):
            table[i + 1, j + 1] = max(0, table[i, j] + (2 if item[i] == doc[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
    assert decontaminate.align(item, doc)[0] == table.max()


# -- token files ------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path(corpus_pipeline.TOKENIZER)


def plain_tokens(path, texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return [np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def test_token_files_round_trip(spark, tokenizer):
    rng = random.Random(4)
    marks = ["a", "b ", " ", ".", ",", "\n", "é", "1", "!", "Ж", "<|endoftext|>", "'s", "\t", "日", "Word", " the"]
    texts = [*AWKWARD, *("".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(300))]
    shards = wavelet.write_shards(documents(spark, texts), tokenizer, shard_tokens=5000)
    assert shards.count() > 4  # more files than partitions
    got = {r.doc_id: r for r in wavelet.read_documents(shards).collect()}
    want, start = plain_tokens(tokenizer, texts), 0
    for i, ids in enumerate(want):
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    every = np.concatenate(want)
    common = [int(t) for t, _ in Counter(every.tolist()).most_common(3)] + [50255]
    assert {r.token: r.n for r in wavelet.token_counts(shards, common).collect()} == {t: int((every == t).sum()) for t in common}
    assert wavelet.occurrences(shards, common[0]).count() == int((every == common[0]).sum())
    assert wavelet.read_documents(wavelet.write_shards(documents(spark, ["a"]).limit(0), tokenizer)).count() == 0


def test_a_piece_met_again_is_not_encoded_again(tokenizer):
    """Three hundred thousand pieces, all remembered until they are met again."""
    own = wavelet.Encoder(tokenizer)
    texts = [" ".join(f"x{i:x}" for i in range(a, a + 1000)) for a in range(0, 300_000, 1000)]
    asked = []
    learn = own._learn
    own._learn = lambda pieces: asked.append(len(pieces)) or learn(pieces)
    first = [own.encode(texts[a : a + 20]) for a in range(0, len(texts), 20)]
    seen = sum(asked)
    assert [own.encode(texts[a : a + 20]) for a in range(0, len(texts), 20)] == first
    assert sum(asked) == seen


def test_pieces_are_kept_from_task_to_task_of_a_job(tokenizer, monkeypatch):
    own, asked = wavelet.Encoder(tokenizer), []
    learn = own._learn
    own._learn = lambda pieces: asked.append(len(pieces)) or learn(pieces)
    texts = ["one two  three.\nFour, five", "two four, one.\n\nThree"]
    own.work_on("a job")
    first = own.encode(texts)
    seen = sum(asked)
    own.work_on("a job")
    assert own.encode(texts) == first and sum(asked) == seen
    own.work_on("another job")
    assert own.encode(texts) == first and sum(asked) == 2 * seen
    monkeypatch.setattr(wavelet, "PIECES", len(own._known) + 2)
    assert own.encode(["six seven", *texts, "eight nine", *texts]) == own.encode(["six seven"]) + first + own.encode(["eight nine"]) + first


@pytest.mark.parametrize("seed", range(4))
def test_pieces_end_where_the_library_parts_words(tokenizer, monkeypatch, seed):
    rng = random.Random(seed)
    marks = [" ", " ", " ", "\n", "\n", ".", ",", "-", "'", "'s", "'ll", "a", "Word", "the", "é", "à", "Å", "×", "1", "½", "\t", "\r\n", "\x1c", "\x00"]
    marks += ["\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u3000", "“", "…", "€", "Ж", "ა", "日", "हि", "😀", "e\u0301", "\u0120", "<|", "<|endoftext|>"]
    texts = ["".join(rng.choices(marks[: rng.choice([12, len(marks) - 1, len(marks)])], k=rng.randrange(60))) for _ in range(1500)]
    want = [ids[:-1].tolist() for ids in plain_tokens(tokenizer, texts)]
    own = wavelet.Encoder(tokenizer)
    assert [np.frombuffer(ids, own.dtype).tolist() for ids in own.encode(texts)] == want
    monkeypatch.setattr(wavelet, "TEXT_AT_ONCE", 300)
    table = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    blocks = list(wavelet._blocks(iter(table.to_batches(max_chunksize=70))))
    assert [i for names, _ in blocks for i in names] == list(range(len(texts))) and len(blocks) > 50
    got = [own.tokens(block) for _, block in blocks]
    assert np.concatenate([ids for ids, _ in got]).tolist() == [i for ids in want for i in ids]
    assert np.concatenate([counts for _, counts in got]).tolist() == [len(ids) for ids in want]


def test_token_files_without_ids(spark, tokenizer):
    docs = spark.createDataFrame([(None, "one two"), (3, None), (None, None), (3, "x")], "doc_id long, text string")
    rows = sorted(wavelet.read_documents(wavelet.write_shards(docs, tokenizer)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 3, 3]
    assert [r.n_tokens for r in rows] == [1, 3, 1, 2]


@pytest.mark.parametrize("n,bits", [(0, 4), (1, 1), (64, 3), (1000, 16), (777, 20)])
def test_wavelet_matrix(n, bits):
    ids = np.random.default_rng(n).integers(0, min(1 << bits, 50), n).astype(np.uint32)
    data = wavelet.write_file(ids, np.array([n]), [None], bits)
    matrix, lengths, names = wavelet.read_file(data)
    assert (matrix.decode() == ids).all() and lengths.tolist() == [n] and names == [None]
    if n:
        assert (matrix.access(np.arange(n)) == ids).all()
    for token in range(min(1 << bits, 52)):
        assert matrix.count(token) == int((ids == token).sum())
        assert matrix.rank(token, n // 2) == int((ids[: n // 2] == token).sum())
        assert matrix.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()


# -- mixing -------------------------------------------------------------------------
def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, all_weight = total - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if weight[s] * left > 3 * sizes[s] * all_weight]
        if not over:
            return {**fixed, **{s: weight[s] * left / all_weight for s in rest}} if rest else fixed
        fixed |= {s: float(3 * sizes[s]) for s in over}


def test_mix(spark):
    rng = random.Random(5)
    sources = [rng.choice(["a", "b", "ü", None, "z", "tiny"] + ["a"] * 6) for _ in range(1500)]
    texts = [rng.choice([None, "", prose(rng, 3)]) if s == "tiny" else prose(rng, rng.randrange(0, 60)) for s in sources]
    docs = documents(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    own = Counter()
    for s, n in zip(sources, size, strict=True):
        own[s] += n
    want, taken = plain_targets(dict(own)), Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], own[s])
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in own:
        assert abs(taken[s] - want[s]) <= max(8, 0.02 * want[s])
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, rows))
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = Counter()
    for r in out.select("doc_id", "text").collect():
        assert r.text == texts[r.doc_id]  # whole
        copies[r.doc_id] += 1
    words = Counter()
    for r in rows:
        assert r.size == 0 or r.taken // r.size <= copies[r.doc_id] <= -(-r.taken // r.size)
        words[sources[r.doc_id]] += copies[r.doc_id] * r.size
    for s in own:
        assert abs(words[s] - want[s]) <= max(60, 0.03 * want[s])


def test_rows_without_an_id_are_dealt_to_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    rows = [(i, f"text number {k}", "a") for k in range(400) for i in ([None, 7] if k % 2 else [k])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shards = {}
    for r in mixing.mix(docs).collect():
        shards.setdefault(r.doc_id if r.doc_id in (None, 7) else "own", Counter())[r.shard] += 1
    for of in shards.values():
        assert len(of) > 15 and max(of.values()) < 0.2 * sum(of.values())


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague_equals_seat_by_seat(spark, seed):
    rng = random.Random(seed)
    votes = [rng.choice([0, 1, 5, rng.randrange(1000)]) for _ in range(7)]
    seats = rng.randrange(40) if any(votes) else 0
    df = spark.createDataFrame([(0, i, float(v), seats) for i, v in enumerate(votes)], "g int, i int, v double, s long")
    got = {r.i: r.won for r in mixing.sainte_lague(df, ["g"], "v", "s", "i", "won").collect()}
    plain = dict.fromkeys(range(7), 0)
    for _ in range(seats):
        best = max((i for i in plain if votes[i]), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
        plain[best] += 1
    assert got == plain


# -- repeated strings -----------------------------------------------------------------
def plain_cut(texts):
    seen, out = set(), {}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        own = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = bytearray(len(data))
        for k, s in enumerate(own):
            if s in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(3))
def test_repeated_strings(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, 12) for _ in range(4)] + ["é" * 30, "a" * 60, "ab" * 40, "x" * 49, "y" * 50]
    texts = [*AWKWARD, *("".join(rng.choice([prose(rng, 5), rng.choice(shared), " ", rng.choice(shared)[3:]]) for _ in range(rng.randrange(8))) for _ in range(120))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.without_repeats(documents(spark, texts)).collect()}
    assert got == plain_cut(texts)


def test_repeated_strings_without_ids(spark):
    text = "z" * 70
    docs = spark.createDataFrame([(None, text), (None, text), (4, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in suffixes.without_repeats(docs).collect()) == [(-1, 70), (-1, 70), (4, 0)]
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


# -- shingle groups ---------------------------------------------------------------------
def plain_groups(texts):
    sets = []
    for text in texts:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    changed = True
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in linked:
            low = min(root[i], root[j])
            changed |= (root[i], root[j]) != (low, low)
            root[i] = root[j] = low
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


@pytest.mark.parametrize("seed", range(3))
def test_shingle_groups(spark, seed):
    rng = random.Random(seed)
    bases = [prose(rng, rng.randrange(6, 120), 40) for _ in range(12)]

    def near(text):
        w = text.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
        return " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)

    texts = [*AWKWARD, *(near(rng.choice(bases[: 3 if rng.random() < 0.6 else 12])) for _ in range(150))]
    docs = documents(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect()}
    want = dict(enumerate(plain_groups(texts)))
    assert got == want
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c in want.values()})


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 3, 500, 511, 512, 3000, 40000):
        own = np.unique(rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2))
        for share in (0, 0.1, 0.14, 0.2, 0.6):
            gone = int(share * len(own))
            other = np.unique(np.concatenate((own[gone:], rng.integers(0, 1 << 63, gone, np.uint64))))
            both = len(np.intersect1d(own, other))
            may = jaccard.may_link(len(own), len(other), jaccard.parities(own), jaccard.parities(other))
            assert may or 100 * both < 75 * (len(own) + len(other) - both)
            assert not may or n < 500 or share < 0.6


def test_shingle_groups_without_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, "A b c D e f")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.similar_groups(docs).collect())
    assert rows == [(-1, -1), (2, 2), (2, 2), (5, 2)]
    assert jaccard.similar_groups(docs.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_repeats(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)] + [(129, 100), (5, 5)]
    links = spark.createDataFrame(chain + star + chain[:3], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


# -- pipeline -----------------------------------------------------------------------------
def test_pipeline_equals_plain_steps(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    rows = {r.doc_id: r.text for r in docs.collect()}
    scored = quality.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    good = sorted(r.doc_id for r in scored if r.predicted)
    grouped = plain_groups([rows[i] for i in good])
    kept = [i for k, i in enumerate(good) if grouped[k][1] == k]
    grams = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() for w in [decontaminate.words_of(r.text)] for k in range(len(w) - 12)}
    leaked = {i for i in kept for w in [decontaminate.words_of(rows[i])] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    kept = [i for i in kept if i not in leaked]
    taken = {r.doc_id: r.taken for r in mixing.mix(docs.where(docs.doc_id.isin(kept))).collect()}
    texts = []
    for i in sorted(i for i in kept if taken[i]):
        size = len(rows[i].split())
        whole, part = divmod(taken[i], size)
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}:{hashlib.md5(rows[i].encode()).hexdigest()}".encode()).hexdigest()[8:16], 16)
        texts += [rows[i]] * (whole + (draw * size < part << 32))
    want = plain_tokens(tokenizer, texts)
    got = sorted(out, key=lambda r: r.start)
    assert [r.ids_crc32 for r in got] == [zlib.crc32(x.tobytes()) for x in want]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
