"""Spelling variants, byte-pair encoding and the conversation trie against plain readings of their rules."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe, spelling, tries

SCHEMA = "doc_id long, text string, word string, key string, n int, ids string"
AWKWARD = [None, "", " ", "\n\t", "x", "É é", "a b c d", "a b c d", "." * 200, "word " * 30000]


def documents(spark, texts, first=0):
    """Rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i + first, t, "x", "y", 1, "z") for i, t in enumerate(texts)], SCHEMA)


# -- spelling variants --------------------------------------------------------
def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    head = 0
    while head < len(a) and a[head] == b[head]:
        head += 1
    return a[head + 1 :] == b[head + 1 :] if len(a) == len(b) else a[head:] == b[head + 1 :]


def plain_variants(words):
    out = {}
    for w, n in words.items():
        near = sorted(((-words[x], x) for x in words if one_edit(w, x)))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [form, w, n, len(near), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def edited(rng, word, letters):
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:]])


def test_spelling_variants_against_all_pairs(spark):
    rng = random.Random(3)
    letters = "abcéÿß×"
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 63, 64, 65, 70]))) for _ in range(12)]
    base += ["aaaaaaaa", "aaaaaaaaa", "abababab", "a" * 64, "a" * 65, "a" * 66, "z" * 3000, "z" * 2999 + "y"]
    heavy = [w for w in base for _ in range(40)]
    once = [edited(rng, rng.choice(base), letters) for _ in range(250)]
    twice = [edited(rng, w, letters) for w in once]
    heavy += ["spelling"] * 600 + ["spellinq"] * 50 + ["spellinqx"] * 3  # a chain of forms
    words = heavy + once * 2 + twice * 2 + [w.upper() if w.isascii() else w for w in base[-8:]]
    rng.shuffle(words)
    texts = [*AWKWARD, *(" ".join(words[i : i + 20]) + "." for i in range(0, len(words), 20))]
    docs = documents(spark, texts).unionAll(spark.createDataFrame([(None, "Spelling spelling speling", "", "", 0, "")], SCHEMA))
    docs = docs.unionAll(docs.where("doc_id = 12"))
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()]))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == want
    assert any(r[0] for r in want.values()) and any(r[1] != r[0] and r[0] for r in want.values())


def test_spelling_pairs_come_once(spark):
    words = spark.createDataFrame([("aaaaaaaa", 5), ("aaaaaaa", 5), ("aaaaaaab", 5), ("aaaabaaa", 5), ("bbbbbbbb", 5)], "word string, n long")
    pairs = [frozenset((r.word, r.other)) for r in spelling.near_words(words).collect()]
    assert len(pairs) == len(set(pairs)) == 5


def test_candidates_of_one_reduced_word_are_split_by_halves(spark):
    """Words that all reduce to one word, of which none are near: candidates stay few."""
    same = [chr(c) for c in range(0xC0, 0x100) if spelling.symbols_of(np.array([c]))[0] == 0]
    rng = random.Random(1)
    words = {"".join(rng.choice(same) for _ in range(12)) for _ in range(2000)}
    table = spark.createDataFrame([(w, w, 2) for w in words], "word string, name string, n long")
    assert spelling._candidates(table).count() < 50 * len(words)


def test_no_words(spark):
    assert spelling.variants(documents(spark, ["a"]).limit(0)).collect() == []
    assert spelling.variants(documents(spark, AWKWARD[:3])).collect() == []


# -- byte-pair encoding -----------------------------------------------------------
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    return bpe.Bpe(PATH), library


def same(own, library, texts):
    got = list(bpe.Encoder(own).encode(texts))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g.tolist() for g in got] == want
    assert [own.decode(g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_every_near_character_splits_as_in_the_library(both):
    own, library = both
    near = [chr(c) for c in range(0x3000) if not own._far.match(chr(c))]
    assert len(near) > 580
    same(own, library, [t for c in near for t in (c, f"a{c}b", f"1{c}'s{c}{c}.", f"{c}́x")])


def test_awkward_texts_encode_as_in_the_library(both):
    own, library = both
    texts = ["", " ", "<|endoftext|>x<|startoftext|> Y<|endoftext|>", "<|ENDOFTEXT|>", "ÀÉ İI ǅ ΣΑΣ σας", "a" * 5000, "aaaa aaa aa abab", "日本語 ① ½", "é", "\x1cq\x85z　", "it's I'LL we’ve", "👩‍👩‍👧"]
    same(own, library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aabTHE hen's\n12.é"), st.characters(codec="utf-8")), max_size=60), max_size=5))
def test_any_text_encodes_as_in_the_library(texts):
    own, library = bpe.Bpe(PATH) if not hasattr(test_any_text_encodes_as_in_the_library, "own") else test_any_text_encodes_as_in_the_library.own, Tokenizer.from_file(PATH)
    test_any_text_encodes_as_in_the_library.own = own
    same(own, library, texts)


def plain_merge(word, ranks):
    """Merge the first of the lowest-ranked pairs until none is left."""
    while True:
        found = [(ranks[p][0], i) for i, p in enumerate(zip(word, word[1:], strict=False)) if p in ranks]
        if not found:
            return word
        _, i = min(found)
        word = word[:i] + [ranks[word[i], word[i + 1]][1]] + word[i + 2 :]


def test_merging_places_of_a_rank_at_once_equals_one_at_a_time():
    rng = random.Random(5)
    for _ in range(200):
        made, merges, pairs = 3, [], set()
        for _ in range(rng.randrange(1, 14)):
            pair = rng.randrange(made), rng.randrange(made)
            if pair not in pairs:
                pairs.add(pair)
                merges.append((*pair, made))
                made += 1
        table = bpe.Merges.of(merges, made)
        words = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(20)]
        out, lengths = bpe.merged(table, np.concatenate([np.array(w) for w in words]), np.array([len(w) for w in words]))
        cuts = np.cumsum(lengths)[:-1]
        ranks = {(a, b): (r, m) for r, (a, b, m) in enumerate(merges)}
        assert [x.tolist() for x in np.split(out, cuts)] == [plain_merge(w, ranks) for w in words]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        bpe.Merges.of([(3, 0, 4), (0, 1, 3)], 5)


def test_small_blocks_and_stores(both, monkeypatch):
    own, library = both
    monkeypatch.setattr(bpe, "BLOCK_LETTERS", 50)
    monkeypatch.setattr(bpe, "STORE_BYTES", 2000)
    monkeypatch.setattr(bpe, "TEXT_AT_ONCE", 300)
    rng = random.Random(2)
    same(own, library, [" ".join("".join(rng.choice("abcdefé") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40)])


def test_round_trips_of_documents(spark, both):
    _, library = both
    texts = [*AWKWARD, "Hello <|endoftext|> world's 12 ½ Ⅷ", "ab" * 40000]
    docs = documents(spark, texts).unionAll(spark.createDataFrame([(None, "no id", "", "", 0, ""), (3, "again", "", "", 0, "")], SCHEMA))
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.round_trips(docs, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.doc_id: r.ids for r in bpe.encoded(docs.where("doc_id = 4"), PATH).collect()} == {4: library.encode("x").ids}
    assert bpe.decoded(docs.where("doc_id = 10"), PATH).first().decoded == library.decode(library.encode(texts[10]).ids, skip_special_tokens=False)
    assert bpe.round_trips(docs.limit(0), PATH).collect() == []


# -- conversation trie --------------------------------------------------------------
def plain_trie(rows):
    convs = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    original = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    node = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = original.get(c - c % 5, [])[:h] + turns[h:]
        for d in range(len(rebuilt) + 1):
            size = len(rebuilt[d - 1][1].encode()) if d else 0
            found = node.setdefault(tuple(rebuilt[:d]), {"members": [], "ends": [], "kids": set(), "size": size})
            found["members"].append(c)
            if d == len(rebuilt):
                found["ends"].append(c)
            if d:
                node[tuple(rebuilt[: d - 1])]["kids"].add(tuple(rebuilt[:d]))
    out = []
    for path in sorted(node, key=len, reverse=True):
        f = node[path]
        f["leaves"] = sum(node[k]["leaves"] for k in f["kids"]) or 1
        f["saved"] = (len(f["members"]) - 1) * f["size"] + sum(node[k]["saved"] for k in f["kids"])
        ends = hashlib.sha256(",".join(map(str, sorted(f["ends"]))).encode()).hexdigest()
        above = min(node[path[:-1]]["members"]) if path else None
        out.append((min(f["members"]), len(path), above, len(f["members"]), len(f["kids"]), f["leaves"], f["saved"], ends))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, key string, part string"


def talk(rng, n, words="abé"):
    """Conversations that share many beginnings, with odd rows."""
    rows = []
    for c in range(n):
        k = rng.choice([0, 1, 2, 3, 6, 12])
        rows += [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.1 else "user", rng.choice(words), 1, "k", "p") for t in range(k)]
    rows += [(200 + i, t, "user", "x", 1, "k", "p") for i in range(40) for t in range(9)]  # copies
    rows += [(300, None, None, None, 1, "k", "p"), (300, 0, "user", None, 1, "k", "p"), (None, 0, "user", "lost", 1, "k", "p")]
    rows += [(305, 1, "user", "same", 1, "k", "p")] * 3 + [(306, t, "u", "long " * 2000, 1, "k", "p") for t in range(150)]
    rows += [(70000 * i, t, "user", "far", 1, "k", "p") for i in range(1, 6) for t in range(10)]  # equal, in several slices
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_turns", [1, 7, 60, 1 << 18])
def test_trie_against_plain_trie(spark, block_turns):
    rows = spark.createDataFrame(talk(random.Random(block_turns), 120), CONVERSATIONS)
    got = [tuple(r) for r in tries.nodes(tries.shared_heads(rows), block_turns).collect()]
    assert sorted(got, key=repr) == sorted(plain_trie(rows.collect()), key=repr)


def test_trie_of_nothing_and_of_no_turns(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert tries.nodes(tries.shared_heads(none)).collect() == []
    alone = spark.createDataFrame([(4, [])], "conv_id long, turns array<struct<key string, size long>>")
    assert [tuple(r) for r in tries.nodes(alone).collect()] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]


def plain_nodes(keys):
    """Checksums aside, the nodes of a set of keys with their members."""
    node = defaultdict(list)
    for i, key in enumerate(keys):
        for d in range(len(key) // tries.WIDTH + 1):
            node[key[: d * tries.WIDTH]].append(i)
    return sorted((len(k) // tries.WIDTH, len(m), min(m)) for k, m in node.items())


def test_forests_merge_however_they_are_cut():
    rng = random.Random(9)
    for _ in range(150):
        turns = [bytes([rng.randrange(2)] * tries.WIDTH) for _ in range(2)]
        keys = sorted({b"".join(rng.choices(turns, k=rng.randrange(6))) for _ in range(rng.randrange(1, 40))})
        last, found = tries.Spine(), []
        at = 0
        while at < len(keys):  # tasks of blocks
            task, own = None, rng.randrange(1, 12)
            end = min(len(keys), at + own)
            while at < end:
                z = min(end, at + rng.randrange(1, 5))
                some = keys[at:z]
                block = tries.Block(some, [np.ones(len(k) // tries.WIDTH, int) for k in some], [1] * len(some), list(range(at, z)), ["e"] * len(some))
                block.build()
                task = task or tries.Spine(block.first)
                for node in block.spine:
                    task.add(node)
                found += [(r[2], r[4], r[3]) for r in block.rows]
                at = z
            task.close()
            found += [(r[0], r[3], r[4]) for r in task.final]
            for node in sorted(task.open, key=lambda n: (n[2], n[0])):
                last.add(node[:10])
        last.close()
        found += [(r[0], r[3], r[4]) for r in last.final]
        assert sorted(found) == plain_nodes(keys)
