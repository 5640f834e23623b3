"""Row pattern matching (MATCH_RECOGNIZE) without gathering a key or a match.

Conditions on single rows are columns; conditions on rows matched before are
``Test``s (``B.price > A.price - 10``), evaluated by the automaton. Rows are
numbered per key, and every key is cut into blocks of ``BLOCK_ROWS`` rows that
are scanned side by side, each as a stream of Arrow batches:

1. Every block is scanned from the state in which nothing is open. For a key of
   one block, which is nearly every key, that is all.
2. A later block begins in the state its predecessor ends in. What a block does
   to a state depends on the state's shape, so a block is summed up by the effect
   it has on each shape that occurs, and effects are composed along the key
   (``_composed``). Shapes not yet tried are tried for all blocks at once; each
   round settles at least one block more, and patterns whose conditions look at
   single rows have few shapes.
3. Matches come out as spans: a key, a first position, and rows per element.
   Rows join their spans by position; measures are ordinary aggregates by match.

No task holds a key, a run of rows or a match, and any number of variables will
do (64).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators.automaton import RESET, Machine, Pattern, Rules, State, Test, ended
from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew
from tidemill.operators.sizes import settle
from tidemill.session import reliable_checkpoint

BLOCK_ROWS = 1 << 20
TRIED_AT_ONCE = 8  # shapes tried ahead of need in a round; the needed one always is
_SPAN_PIECE = 1 << 16
_MATCH, _EFFECT, _NEED, _TRUE = range(4)
_FOUND = "_kind int, _block long, _shape int, _from long, _counts array<long>, _payload binary"


def row_mask(rules: Rules, define: Mapping[str, Column | Test]) -> Column:
    """The variables a row may be, as bits; a variable without a condition on single rows may be any row."""
    total = F.lit(0).cast("long")
    for i, name in enumerate(rules.variables):
        rule = define.get(name)
        holds = rule if isinstance(rule, Column) else F.lit(True)
        total = total.bitwiseOR(F.when(holds, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return total


class _Scan:
    """Rows of a partition, sorted by key and position, block by block."""

    def __init__(self, rules: Rules, block_rows: int, marked: bool):
        self.rules, self.block_rows, self.marked = rules, block_rows, marked
        self.machines: dict[int, tuple] = {}  # number of a shape: (shape, machine)
        self.rows = self.block = 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if batch.num_rows:
                if tail is not None and self._begins(batch)[0]:
                    yield from self._batch(tail, [(0, *f) for f in self._finish()])
                yield from self._batch(batch, self._run(batch))
                tail = batch.slice(batch.num_rows - 1, 1)
        if tail is not None:
            yield from self._batch(tail, [(0, *f) for f in self._finish()])

    def _batch(self, batch: pa.RecordBatch, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found:
            at, kind, block, shape, first, counts, payload = zip(*found, strict=True)
            columns = [
                batch.column("_key").take(pa.array(at, pa.int64())),
                pa.array(kind, pa.int32()),
                pa.array(block, pa.int64()),
                pa.array(shape, pa.int32()),
                pa.array(first, pa.int64()),
                pa.array(counts, pa.list_(pa.int64())),
                pa.array(payload, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_kind", "_block", "_shape", "_from", "_counts", "_payload"])

    def _begins(self, batch: pa.RecordBatch) -> np.ndarray:
        """Where a block of a key begins: at its first marker if there are markers, else at its first row."""
        at = batch.column("_at").to_numpy(zero_copy_only=False)
        if not self.marked:
            return (at - 1) % self.block_rows == 0
        marker = batch.column("_shape").to_numpy(zero_copy_only=False) >= 0
        before = np.concatenate(([self.rows > 0 or not self.machines], ~marker[:-1]))
        return marker & before

    def _run(self, batch: pa.RecordBatch) -> list[tuple]:
        at = batch.column("_at").to_numpy(zero_copy_only=False)
        mask = batch.column("_mask").to_numpy(zero_copy_only=False)
        shape = batch.column("_shape").to_numpy(zero_copy_only=False)
        begins = self._begins(batch)
        wakes = np.flatnonzero(begins | (shape >= 0) | ((mask & self._first()) != 0))
        values = {f: batch.column(f).to_pylist() for f in self.rules.fields}
        out: list[tuple] = []
        i, n = 0, len(at)
        first = -1 if begins[0] else 0  # rows of the open block begin here in this batch
        while i < n:
            if begins[i]:
                if i:
                    self.rows += i - max(first, 0)
                    out += [(i - 1, *f) for f in self._finish()]
                first = i
                self._start(int(at[i]))
            if shape[i] >= 0:
                start = pickle.loads(batch.column("_payload")[i].as_py())
                self.machines[int(shape[i])] = (start, Machine(self.rules, start))
                first = i + 1
            else:
                row = {f: v[i] for f, v in values.items()}
                for number, (_, machine) in self.machines.items():
                    machine.step(int(at[i]), int(mask[i]), row)
                    if machine.found:
                        out += [(i, _MATCH, self.block, number, o, list(m.counts), None) for o, m in machine.take()]
            i += 1
            if i < n and not any(m.starts for _, m in self.machines.values()):  # nothing is open: on to a row that may begin a match
                k = int(np.searchsorted(wakes, i))
                i = int(wakes[k]) if k < len(wakes) else n
        self.rows += n - max(first, 0)
        return out

    def _first(self) -> np.int64:
        bits = self.rules.first_bits
        return np.int64(bits - (1 << 64) if bits >> 63 else bits)

    def _start(self, at: int) -> None:
        self.block = at // self.block_rows if self.marked else (at - 1) // self.block_rows
        self.rows = 0
        self.machines = {} if self.marked else {0: (RESET, Machine(self.rules))}

    def _finish(self) -> list[tuple]:
        out = []
        alone = self.block == 0 and self.rows < self.block_rows  # the key ends with its first block
        for number, (shape, machine) in self.machines.items():
            if alone:
                machine.end()
                out += [(_MATCH, 0, number, o, list(m.counts), None) for o, m in machine.take()]
            else:
                out.append((_EFFECT, self.block, number, None, None, pickle.dumps((shape, machine.effect()))))
        self.rows, self.machines = 0, {}
        return out


def _composed(frame: pd.DataFrame) -> pd.DataFrame:
    """One key: its blocks' effects in order. The shapes still to be tried or, once none is, the true ones and the matches across blocks."""
    effects, numbers = {}, {}
    for block, number, payload in zip(frame["_block"], frame["_shape"], frame["_payload"], strict=True):
        shape, effect = pickle.loads(payload)
        effects[block, shape], numbers[shape] = effect, number
    blocks = int(frame["_block"].max()) + 1
    state, shape, true, found = State(), RESET, [], []
    for block in range(blocks):
        if (block, shape) not in effects:
            break
        true.append((_TRUE, block, numbers[shape], None, None, None))
        effect = effects[block, shape]
        state, across = state.after(effect)
        found += across
        shape = effect.shape
    if len(true) < blocks:
        ends = list(dict.fromkeys([shape, *(e.shape for e in effects.values())]))[:TRIED_AT_ONCE]
        wanted = [(len(true), shape)] + [(b, s) for b in range(len(true) + 1, blocks) for s in ends if (b, s) not in effects]
        for _, s in wanted:
            numbers.setdefault(s, len(numbers))
        rows = [(_NEED, b, numbers[s], None, None, pickle.dumps(s)) for b, s in wanted]
    else:
        rows = true + [(_MATCH, 0, 0, at, list(counts), None) for at, counts in found + ended(shape, state)]
    out = pd.DataFrame(rows, columns=["_kind", "_block", "_shape", "_from", "_counts", "_payload"]).astype({"_from": "Int64"})
    out.insert(0, "_key", [frame["_key"].iat[0]] * len(out))
    return out


def _spans(line: DataFrame, rules: Rules, block_rows: int) -> DataFrame:
    """``_key, _from, _counts`` of every match in ``line`` (``_key, _at, _mask`` and the automaton's fields)."""
    key = line.schema["_key"].dataType.simpleString()
    schema = f"_key {key}, {_FOUND}"
    block = F.floor((F.col("_at") - 1) / block_rows).alias("_block")
    line = line.select("*", block, F.lit(-1).alias("_shape"), F.lit(None).cast("binary").alias("_payload"))

    def scan(rows: DataFrame, marked: bool) -> DataFrame:
        dealt = rows.repartition(F.col("_key"), F.col("_block")).sortWithinPartitions("_key", "_block", "_at")
        return dealt.mapInArrow(lambda batches: _Scan(rules, block_rows, marked)(batches), schema)

    found = reliable_checkpoint(scan(line, False))
    spans = ["_key", "_from", "_counts"]
    effects = found.where(F.col("_kind") == _EFFECT)
    own = found.where(F.col("_kind") == _MATCH)
    if effects.isEmpty():
        return own.select(*spans)
    while True:
        composed = reliable_checkpoint(effects.groupBy("_key").applyInPandas(_composed, schema))
        needs = composed.where(F.col("_kind") == _NEED)
        if needs.isEmpty():
            break
        blocks = needs.select("_key", "_block").distinct()
        markers = needs.select(
            "_key",
            (F.col("_block") * block_rows).alias("_at"),
            F.lit(0).cast("long").alias("_mask"),
            *[F.lit(None).cast(line.schema[f].dataType).alias(f) for f in rules.fields],
            "_block",
            "_shape",
            "_payload",
        )
        tried = reliable_checkpoint(scan(line.join(blocks, ["_key", "_block"], "left_semi").unionByName(markers), True))
        effects = effects.unionAll(tried.where(F.col("_kind") == _EFFECT))
        own = own.unionAll(tried.where(F.col("_kind") == _MATCH))
    true = composed.where(F.col("_kind") == _TRUE).select("_key", "_block", "_shape")
    later = own.where(F.col("_block") > 0).join(true, ["_key", "_block", "_shape"], "left_semi")
    across = composed.where(F.col("_kind") == _MATCH)
    return own.where((F.col("_block") == 0) & (F.col("_shape") == 0)).select(*spans).unionAll(later.select(*spans)).unionAll(across.select(*spans))


def matched_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    pattern: Pattern,
    define: Mapping[str, Column | Test],
    ties: Sequence[str] = (),
    lookback: Mapping[str, Callable[[WindowSpec], Column]] | None = None,
    skew: Skew = DEFAULT_SKEW,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every matched row with ``match_id`` (position of the match's first row in its key), ``position`` and ``classifier``.

    ``define`` gives a condition per variable: a column over the row and over the
    columns named in ``lookback`` (computed over the row before), or a ``Test``
    that refers to rows matched before. A variable without one may be any row.
    """
    source = df.columns
    rules = Rules(pattern, {n: t for n, t in define.items() if isinstance(t, Test)})
    if len(rules.variables) > 64:
        raise ValueError("at most 64 variables")
    if lookback:
        df = settle(Ordered(df, keys, order, ties, skew=skew).over_rows(lookback, before=1), skew.min_bytes)
    numbered = Ordered(df, keys, order, ties, skew=skew).ranks()
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    line = numbered.select(*source, key.alias("_key"), F.col("row_number").alias("_at"), row_mask(rules, define).alias("_mask"))
    line = settle(line, skew.min_bytes)  # read by every scan, and by the join
    spans = _spans(line.select("_key", "_at", "_mask", *rules.fields), rules, block_rows)
    n = F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    last = F.col("_from") + F.col("_n") - 1
    piece = F.sequence(F.floor(F.col("_from") / _SPAN_PIECE), F.floor(last / _SPAN_PIECE))  # a long match row by row, never as one array
    pieces = spans.withColumn("_n", n).withColumn("_p", F.explode(piece))
    at = F.sequence(F.greatest("_from", F.col("_p") * _SPAN_PIECE), F.least(last, (F.col("_p") + 1) * _SPAN_PIECE - 1))
    each = pieces.withColumn("_at", F.explode(at))
    place = F.col("_at") - F.col("_from")
    label = F.lit(None).cast("string")
    for i, name in reversed(list(enumerate(rules.names))):
        done = sum((F.get("_counts", F.lit(k)) for k in range(i + 1)), F.lit(0).cast("long"))
        label = F.when(place < done, F.lit(name)).otherwise(label)
    labels = each.select("_key", "_at", F.col("_from").alias("match_id"), label.alias("classifier"))
    return line.join(labels, ["_key", "_at"]).select(*source, "match_id", F.col("_at").alias("position"), "classifier")


# -- measures: aggregates over the rows of a match ------------------------------------
def _taken(variable: str | None, value: Column) -> Column:
    return F.when(F.col("classifier") == variable, value) if variable else value


def first_of(variable: str | None, field: str) -> Column:
    """FIRST(variable.field); null when the variable took no row."""
    return F.min_by(field, _taken(variable, F.col("position")))


def last_of(variable: str | None, field: str) -> Column:
    """LAST(variable.field); null when the variable took no row."""
    return F.max_by(field, _taken(variable, F.col("position")))


def count_of(variable: str | None) -> Column:
    return F.count(_taken(variable, F.lit(1))).cast("int")


def sum_of(variable: str | None, field: str) -> Column:
    return F.sum(_taken(variable, F.col(field)))


def one_row_per_match(rows: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    found = rows.groupBy(*keys, "match_id").agg(*[c.alias(name) for name, c in measures.items()])
    return found.select(*keys, *measures)


def all_rows_per_match(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every matched row with its variable (``classifier``) and the time its match began."""
    start = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("match_id").alias("_k_match")).agg(F.min_by(order, "position").alias("match_start"))
    same = rows["match_id"] == start["_k_match"]
    for k in keys:
        same = same & rows[k].eqNullSafe(start[f"_k_{k}"])
    return rows.join(start, same).drop("_k_match", *[f"_k_{k}" for k in keys])
