"""Sharding, URL filters and embeddings against plain readings, and every query on the smallest tables."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from check import rows_of
from tidemill.llm import embeddings, queries, sharding, urls
from tidemill.tables import SCHEMAS

FOLDER = "/root/testdata/sf0.001"


# -- sharding ---------------------------------------------------------------
def test_shards_are_even_and_places_have_no_gaps(spark):
    rng = random.Random(1)
    texts = [None, "", "é", "same", "same", *("x" * rng.randrange(2000) for _ in range(3000))]
    docs = spark.createDataFrame([(i, t, "s", 5) for i, t in enumerate(texts)] + [(None, "n", "s", 5)], "doc_id long, text string, shard string, slot int")
    out, slot_map = sharding.shard(docs, 8)
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    size, places = dict.fromkeys(range(8), 0), {s: [] for s in range(8)}
    for r in rows:
        text = ("n" if r.doc_id is None else texts[r.doc_id]) or ""
        assert (r.size, r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert (r.law, r.grown_shard, r.map_version) == ("bytes", None, 2)
        assert slot_map.shard_of[r.virtual_slot] == r.shard
        size[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert max(size.values()) - min(size.values()) <= 2
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(repr, sharding.shard(docs, 8)[0].collect())) == sorted(map(repr, rows))
    assert sharding.shard(docs.limit(0), 8)[0].count() == 0


def plain_places(rows, slot_map):
    """Shard and place of every row by the stored map alone."""
    out, at = [], dict.fromkeys(range(slot_map.n_shards), 0)
    order = lambda r: (r.virtual_slot, r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
    for r in sorted(rows, key=order):
        shard = slot_map.shard_of[r.virtual_slot]
        out.append((r.doc_id, r.text_crc32, shard, at[shard]))
        at[shard] += 1
    return sorted(out, key=repr)


def test_shards_follow_the_stored_map(spark, tmp_path):
    rng = random.Random(6)
    texts = ["x" * rng.randrange(500) for _ in range(4000)] + [None, "", "same", "same"]
    frame = lambda n: spark.createDataFrame([(i, t) for i, t in enumerate(texts[:n])] + [(None, "n"), (3, "again")], "doc_id long, text string")
    store = str(tmp_path / "maps")
    before, first = sharding.shard(frame(4004), 8, store)
    rows = before.collect()
    assert first == sharding.SlotMap.stored(spark, store) and first.version == 2
    assert plain_places(rows, first) == sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in rows), key=repr)
    again, second = sharding.shard(frame(4004), 8, store)  # nothing to edit: the same map, the same rows
    assert second == first and sorted(map(repr, again.collect())) == sorted(map(repr, rows))
    fewer, third = sharding.shard(frame(3500), 8, store)  # other loads: an edit of the stored map
    moved = sum(a != b for a, b in zip(first.shard_of, third.shard_of, strict=True))
    assert third.version == 3 and 0 < moved < 400
    size = Counter()
    for r in fewer.collect():
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 4
    grown, fourth = sharding.shard(frame(3500), 9, store)
    assert (fourth.version, fourth.n_shards) == (4, 9)
    assert all(a == b or b == 8 or fourth.shard_of.count(a) for a, b in zip(third.shard_of, fourth.shard_of, strict=True))
    assert plain_places(grown.collect(), sharding.SlotMap.stored(spark, store)) == sorted(((r.doc_id, r.text_crc32, r.shard, r.slot) for r in grown.collect()), key=repr)


def test_map_is_edited_not_made_anew(spark):
    rng = random.Random(2)
    load = [rng.randrange(1, 100) for _ in range(256)]
    first = sharding.SlotMap.first(4, 256).rebalanced(load)
    grown = first.rebalanced(load, 5)
    total = [sum(x for x, s in zip(load, grown.shard_of, strict=True) if s == k) for k in range(5)]
    assert max(total) - min(total) <= 3
    moved = sum(a != b for a, b in zip(first.shard_of, grown.shard_of, strict=True))
    assert moved <= 0.45 * 256 and grown.version == first.version + 1
    stored = first.table(spark).unionAll(grown.table(spark))
    assert sharding.SlotMap.read(stored) == grown


# -- URLs -------------------------------------------------------------------
@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme/casino", "", "", None, "block"),
        ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://x.com/fr/casino", "x.com", "/fr/casino", "com/fr/", "allow"),
        ("http://x.net/casino", "x.net", "/casino", None, "block"),
        ("http://x.net/casinos", "x.net", "/casinos", None, "allow"),
        ("http://x.net/free/free/free", "x.net", "/free/free/free", None, "allow"),
        ("http://free.net/Bonus?q=win", "free.net", "/Bonus", None, "block"),
        ("x://y://z/w", "y:", "//z/w", None, "allow"),
        ("http://h?q=/es/", "h", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "r", "v")], "page_id long, url string, rule string, host string")
    (r,) = urls.judge(pages).collect()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)
    assert urls.judge(pages.limit(0)).count() == 0


# -- embeddings ---------------------------------------------------------------
def plain_links(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    linked = {k: [] for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                linked[a].append(b)
                linked[b].append(a)
    root = {k: good[k][0] for k in linked}
    for _ in range(len(good)):
        root = {k: min([root[k], *(root[j] for j in linked[k])]) for k in linked}
    return sorted((good[k][0], len(linked[k]), root[k]) for k in linked)


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # so that groups are cut into blocks
    rng = np.random.default_rng(3)
    rows, base = [], rng.standard_normal((6, 12))
    for i in range(240):
        v = base[0 if i % 3 == 0 else i % 6] + rng.standard_normal(12) * rng.choice([0.02, 0.3])
        rows.append((i, np.float32(v).tolist()))
    rows += [(300 + k, rows[0][1]) for k in range(40)]
    odd = [(400, None), (401, []), (402, [0.0] * 12), (403, [float("nan")] * 12), (404, [None] + [1.0] * 11), (405, [float("inf")] + [1.0] * 11), (None, rows[0][1]), (406, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows + odd], "vec_id long, embedding array<float>, label int, links int")
    got = embeddings.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    want = plain_links(rows + odd)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and (r.vec_id < 400 or r.vec_id == 406))
    assert [(i, c) for i, _, c in found] == [(i, c) for i, _, c in want]
    assert 0.99 * sum(n for _, n, _ in want) <= sum(n for _, n, _ in found) <= sum(n for _, n, _ in want)
    assert all(a[1] <= b[1] for a, b in zip(found, want, strict=True))
    for r in got:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)
        if r.vec_id is None or 400 <= r.vec_id < 406:
            assert (r.n_links, r.component_id) == (0, r.vec_id)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_with_one_id_on_several_vectors(spark):
    x, y, z, u, v = np.eye(8)[:5].tolist()
    near = lambda a: (np.array(a) + 0.1 * np.eye(8)[7]).tolist()
    rows = [(1, x), (7, x), (3, y), (7, y), (4, z), (4, u), (9, near(z)), (8, u), (6, v), (5, near(v))]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert {r[0]: r[2] for r in got} == {1: 1, 3: 1, 7: 1, 4: 4, 8: 4, 9: 4, 5: 5, 6: 5}
    assert [r[1] for r in got] == [1] * 10
    assert all(len({r[2] for r in got if r[0] == i}) == 1 for i, _ in rows)
    assert [r[0] for r in got if r[3]] == [1, 4, 4, 5]


def test_cosines_in_double_precision_at_any_scale(spark):
    y = (1 - 0.9**2) ** 0.5
    turned = lambda angle: [0.9 - angle * y, y + angle * 0.9]
    rows = [(1, [1.0, 0.0]), (2, turned(1e-10)), (3, [-1e30, 0.0]), (4, [-x * 1e-30 for x in turned(-1e-10)]), (5, [0.0, -1e-300])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_planted_pairs_near_the_threshold_are_found(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((3000, 32))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9001, 0.93, (3000, 1))
    near = c * base + np.sqrt(1 - c**2) * side
    rows = [(2 * i + k, v.tolist()) for i, both in enumerate(zip(base, near, strict=True)) for k, v in enumerate(both)]
    got = {r.vec_id: r.component_id for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(3000)) >= 0.99 * 3000


def test_tables_grow_so_that_pairs_at_the_threshold_are_found():
    for n in (10, 10**4, 10**7, 10**10):
        bits, tables = embeddings.plan(n)
        meet = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - meet) ** tables >= embeddings.RECALL
        assert n / 2**bits <= embeddings.BUCKET


# -- queries --------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    tables = {n: n for n in SCHEMAS}
    con = duckdb.connect()
    for n in tables:
        con.execute(f"create view {n} as select * from '{FOLDER}/{n}.parquet'")
    if name in queries.ORACLES:
        cur = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(columns, cur.fetchall())
    elif not name.startswith("op3_"):
        source = "embeddings" if name.startswith("op5_") else "documents"
        assert len(rows) == con.execute(f"select count(*) from {source}").fetchone()[0]


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
