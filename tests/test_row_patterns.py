"""The pattern automaton, row patterns over blocks of rows, and row patterns on streams."""

import random
import re
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streams import SCHEMA, T0, at, files, rows
from tidemill.operators import row_patterns as R
from tidemill.operators.automaton import RESET, Machine, Ref, Rules, State, Test, bounds, ended
from tidemill.operators.ordered import Skew
from tidemill.streaming import in_order, run

QUANTIFIERS = ["", "*", "+", "?", "{2}", "{1,3}", "{2,}", "{0,2}"]


def plain(pattern, masks):
    """Matches as (start, rows of each element), by a regular expression over one letter a row."""
    names = list(dict.fromkeys(n for n, _ in pattern))
    groups = ["([" + "".join(chr(0x4E00 + m) for m in range(1 << len(names)) if m >> names.index(n) & 1) + "]" + q + ")" for n, q in pattern]
    rule, text, out, i = re.compile("".join(groups)), "".join(chr(0x4E00 + m) for m in masks), [], 0
    while i <= len(text) and (m := rule.search(text, i)):
        if m.end() > m.start():
            out.append((m.start(), tuple(m.end(g) - m.start(g) for g in range(1, rule.groups + 1))))
        i = max(m.end(), m.start() + 1) if m.end() > m.start() else m.start() + 1
    return out


def in_runs(rules, masks, cuts, values=None):
    """The same through runs of rows, each begun from the shape its predecessor ends in."""
    state, shape, found = State(), RESET, []
    for a, z in zip(cuts, cuts[1:], strict=False):
        machine = Machine(rules, shape)
        for i in range(a, z):
            machine.step(i, masks[i], {"v": values[i]} if values else {})
        found += [(o, n.counts) for o, n in machine.take()]
        effect = machine.effect()
        state, across = state.after(effect)
        found, shape = found + across, effect.shape
    return sorted(found + ended(shape, state))


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_regular_expressions(seed):
    rng = random.Random(seed)
    for _ in range(800):
        pattern = [(rng.choice("ABCD"), rng.choice(QUANTIFIERS)) for _ in range(rng.randrange(1, 5))]
        names, bias = {n for n, _ in pattern}, rng.random()
        masks = [sum((rng.random() < bias) << b for b in range(len(names))) for _ in range(rng.randrange(0, 25))]
        rules, want = Rules(pattern), plain(pattern, masks)
        cuts = sorted({0, len(masks), *(rng.randrange(len(masks) + 1) for _ in range(3))})
        assert in_runs(rules, masks, [0, len(masks)]) == want
        assert in_runs(rules, masks, cuts) == want


def test_what_is_kept_does_not_grow_with_a_run():
    rules = Rules([("A", ""), ("B", "+"), ("C", "")], {"B": Test(("v",), (Ref(None, "v"),), lambda v, b: v > b)})
    machine = Machine(rules)
    sizes = []
    for i in range(3000):
        machine.step(i, 7, {"v": i})
        sizes.append(sum(len(s.threads) for s in machine.starts))
    assert max(sizes) < 8


def price_drops(values):
    """A B* C with B > A - 10, C < A - 10, start by start."""
    out, i = [], 0
    while i < len(values):
        j = i + 1
        while j < len(values) and values[j] > values[i] - 10:
            j += 1
        if j < len(values) and values[j] < values[i] - 10:
            out.append((i, (1, j - i - 1, 1)))
            i = j + 1
        else:
            i += 1
    return out


def drop_tests():
    a = Ref("A", "v")
    return {"B": Test(("v",), (a,), lambda v, x: v > x - 10), "C": Test(("v",), (a,), lambda v, x: v < x - 10)}


def test_conditions_on_rows_matched_before():
    rng = random.Random(4)
    rules = Rules([("A", ""), ("B", "*"), ("C", "")], drop_tests())
    for _ in range(300):
        values = [rng.randrange(40) for _ in range(rng.randrange(30))]
        cuts = sorted({0, len(values), *(rng.randrange(len(values) + 1) for _ in range(2))})
        assert in_runs(rules, [7] * len(values), cuts, values) == price_drops(values)


def test_a_null_or_missing_row_never_satisfies_a_test():
    rules = Rules([("A", "?"), ("B", "")], {"B": Test(("v",), (Ref("A", "v"),), lambda v, a: True)})
    assert in_runs(rules, [2, 3, 3, 2], [0, 4], [1, None, 2, 3]) == [(2, (1, 1))]


def test_quantifiers_and_unknown_variables():
    assert bounds("{2,}") == (2, float("inf")) and bounds("?") == (0, 1)
    with pytest.raises(ValueError):
        bounds("+?")
    with pytest.raises(ValueError):
        Rules([("A", "")], {"B": Test((), (), lambda: True)})


# -- over tables --------------------------------------------------------------------
def found(matched):
    """Each match as its key and its rows' variables and ids."""
    by_match = matched.groupBy("k", "match_id").agg(F.array_sort(F.collect_list(F.struct("position", F.concat("classifier", F.col("id").cast("string")).alias("x")))).alias("m"))
    return sorted(((r.k, [x.x for x in r.m]) for r in by_match.collect()), key=str)


def wanted(data, pattern, letters):
    out = []
    for k in {r[1] for r in data}:
        mine = sorted((r[2], r[0], r[3]) for r in data if r[1] == k)
        names = list(dict.fromkeys(n for n, _ in pattern))
        masks = [sum((int(v) in letters[n]) << i for i, n in enumerate(names)) for _, _, v in mine]
        for start, counts in plain(pattern, masks):
            labels = [n for (n, _), c in zip(pattern, counts, strict=True) for _ in range(c)]
            out.append((k, [f"{n}{mine[start + i][1]}" for i, n in enumerate(labels)]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_rows", [3, 8, 1 << 20])
@pytest.mark.parametrize("skew", [Skew(), Skew(share=0.01, min_rows=5, oversplit=2, min_bytes=0)])
def test_blocks_and_heavy_keys_change_nothing(spark, block_rows, skew):
    rng = random.Random(block_rows)
    data = [(i, rng.choice([None, 1, 1, 1, 2]), at(rng.randint(0, 60)), float(rng.choice([0, 0, 0, 1, 2]))) for i in range(120)]
    data += [(200 + i, 3, at(i), 0.0) for i in range(30)]  # one single run
    df = spark.createDataFrame(data, SCHEMA)
    pattern, letters = [("A", "+"), ("B", "{0,2}"), ("C", "?")], {"A": {0}, "B": {0, 1}, "C": {2}}
    define = {n: F.col("v").isin(*map(float, s)) for n, s in letters.items()}
    got = R.matched_rows(df, ["k"], "ts", pattern, define, ties=["id"], skew=skew, block_rows=block_rows)
    assert found(got) == wanted(data, pattern, letters)


def test_eight_variables(spark):
    data = [(i, 1, at(i), float(i % 9)) for i in range(40)]
    pattern = [(chr(65 + i), "") for i in range(8)]
    letters = {n: {i} for i, (n, _) in enumerate(pattern)}
    got = R.matched_rows(spark.createDataFrame(data, SCHEMA), ["k"], "ts", pattern, {n: F.col("v") == float(*s) for n, s in letters.items()}, ties=["id"], block_rows=5)
    assert found(got) == wanted(data, pattern, letters)


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_price_drops_over_blocks(spark, block_rows):
    rng = random.Random(7)
    data = [(i, i % 2, at(i // 2), float(rng.randrange(40))) for i in range(160)]
    define = {n: t for n, t in drop_tests().items()}
    got = R.matched_rows(spark.createDataFrame(data, SCHEMA), ["k"], "ts", [("A", ""), ("B", "*"), ("C", "")], define, ties=["id"], block_rows=block_rows)
    one = R.one_row_per_match(got, ["k"], first=R.first_of("A", "id"), low=R.last_of("C", "v"), held=R.count_of("B"), total=R.sum_of(None, "v"))
    want = []
    for k in (0, 1):
        mine = [r for r in data if r[1] == k]
        for start, (_, held, _) in price_drops([r[3] for r in mine]):
            part = mine[start : start + held + 2]
            want.append((k, part[0][0], part[-1][3], held, sum(r[3] for r in part)))
    assert rows(one, *one.columns) == sorted(want, key=str)


def test_measures_of_variables_without_rows_and_all_rows(spark):
    df = spark.createDataFrame([(i, 1, at(i), v) for i, v in enumerate([0.0, 0.0, 1.0, 9.0])], SCHEMA)
    v = F.col("v")
    got = R.matched_rows(df, ["k"], "ts", [("A", "+"), ("B", ""), ("C", "*")], {"A": v == 0, "B": v == 1, "C": v == 2}, ties=["id"])
    one = R.one_row_per_match(got, ["k"], none=R.first_of("C", "id"), n=R.count_of("C"), all=R.count_of(None), last=R.last_of(None, "id")).first()
    assert (one.none, one.n, one["all"], one.last) == (None, 0, 3, 2)
    every = R.all_rows_per_match(got, ["k"], "ts").orderBy("id").collect()
    assert [(r.classifier, r.id, r.match_start) for r in every] == [("A", 0, T0), ("A", 1, T0), ("B", 2, T0)]
    assert R.matched_rows(df.limit(0), ["k"], "ts", [("A", "")], {}, ties=["id"]).collect() == []


def test_lookback_and_no_keys(spark):
    df = spark.createDataFrame([(i, 1, at(i), v) for i, v in enumerate([3.0, 4.0, 5.0, 1.0, 2.0, 2.0])], SCHEMA)
    got = R.matched_rows(df, [], "ts", [("A", ""), ("B", "+")], {"B": F.col("v") > F.col("prev")}, ties=["id"], lookback={"prev": lambda w: F.lag("v").over(w)}, block_rows=2)
    assert sorted((r.match_id, r.classifier, r.id) for r in got.collect()) == [(1, "A", 0), (1, "B", 1), (1, "B", 2), (4, "A", 3), (4, "B", 4)]


# -- on streams ---------------------------------------------------------------------
def test_stream_patterns_equal_the_batch_over_several_batches(spark, tmp_path):
    rng = random.Random(5)
    data = [(i, rng.choice([None, 1, 2]), at(rng.randint(0, 400)), None if rng.random() < 0.05 else float(rng.randrange(40))) for i in range(120)]
    end = [(900 + k, k, at(5000), 1000.0) for k in (1, 2)] + [(910, None, at(5000), 1000.0)]
    s = files(spark, tmp_path / "in", data[:40], data[40:80], data[80:], end, [(990, 1, at(90000), 0.0)], [(991, 1, at(99000), 0.0)])
    pattern = [("A", ""), ("B", "+")]
    tests = {"B": Test(("v",), (Ref(None, "v"),), lambda v, before: v > before)}
    measures = {"a": ("first", "A", "v"), "z": ("last", None, "v"), "t": ("first", None, "ts"), "n": ("count", None, ""), "s": ("sum", "B", "v"), "m": ("max", None, "id")}
    with run.settings(spark, **run.state_settings("rocksdb", 2)):
        got = run.append_to(in_order.stream_match(s, "k", "ts", "id", pattern, tests, measures, 1_000_000), str(tmp_path / "out"), timeout=300)
    twin = R.matched_rows(spark.createDataFrame(data + end, SCHEMA), ["k"], "ts", pattern, tests, ties=["id"])
    want = R.one_row_per_match(
        twin, ["k"], a=R.first_of("A", "v"), z=R.last_of(None, "v"), t=R.first_of(None, "ts"), n=F.count("*"), s=R.sum_of("B", "v"), m=F.max("id")
    ).where("m < 900")
    cols = ["k", "a", "z", "t", "n", "s", "m"]
    assert [r for r in rows(got.withColumn("t", F.col("t").cast("timestamp_ntz")), *cols) if r[-1] < 900] == rows(want, *cols)


def test_a_bucket_that_the_watermark_cuts_waits_with_its_rest(spark, tmp_path):
    data = [(i, 1, T0 + timedelta(milliseconds=300 * i), float(i)) for i in range(200)]  # one minute
    s = files(spark, tmp_path / "in", *[data[a : a + 25] for a in range(0, 200, 25)], [(999, 1, at(9000), 0.0)], [(1000, 1, at(9900), 0.0)])
    with run.settings(spark, **run.state_settings("rocksdb", 2)):
        lagged = in_order.stream_lag(s, "k", "ts", "id", 2_000).select("id", F.col("previous.id").alias("before"))
        got = run.append_to(lagged, str(tmp_path / "out"), timeout=300)
    assert [r for r in sorted(map(tuple, got.collect())) if r[0] < 900] == [(i, i - 1 if i else None) for i in range(200)]
