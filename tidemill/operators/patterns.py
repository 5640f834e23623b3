"""Row pattern matching (MATCH_RECOGNIZE) on built-in expressions.

A pattern is a sequence of variables with quantifiers, matched greedily against
consecutive rows of a key, skipping past the last row of each match. Every row
is written as one character that says which variables it satisfies; the pattern
becomes a regular expression over those characters.

Keys are not matched as a whole. Two neighbouring rows can lie in one match only
if some variable of the first may be followed by some variable of the second;
where that fails, the row sequence is cut, which cannot cut a match. What is
gathered for the regular expression is one such run of rows, not one key.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemill.operators.ordered import DEFAULT_SKEW, Ordered, Skew
from tidemill.operators.sizes import settle

_ALPHABET = string.digits + string.ascii_letters + "_~"
_QUANTIFIER = re.compile(r"[*+?]?|\{\d+(,\d*)?\}")

Pattern = Sequence[tuple[str, str]]  # (variable, quantifier)


def _bounds(quantifier: str) -> tuple[int, float]:
    if not _QUANTIFIER.fullmatch(quantifier):
        raise ValueError(f"not a quantifier: {quantifier!r}")
    fixed = {"": (1, 1), "*": (0, float("inf")), "+": (1, float("inf")), "?": (0, 1)}
    if quantifier in fixed:
        return fixed[quantifier]
    low, comma, high = quantifier[1:-1].partition(",")
    return int(low), float(high) if high else (float("inf") if comma else int(low))


def followers(pattern: Pattern) -> dict[str, set[str]]:
    """Which variables may stand on the row right after a row of each variable."""
    out: dict[str, set[str]] = {name: set() for name, _ in pattern}
    for i, (name, quantifier) in enumerate(pattern):
        if _bounds(quantifier)[1] > 1:
            out[name].add(name)
        for after, q in pattern[i + 1 :]:
            out[name].add(after)
            if _bounds(q)[0] > 0:
                break
    return out


def variable_bits(pattern: Pattern) -> dict[str, int]:
    names = list(dict.fromkeys(name for name, _ in pattern))
    if len(names) > 6:
        raise ValueError("at most six variables")
    return {name: 1 << i for i, name in enumerate(names)}


def row_mask(pattern: Pattern, define: Mapping[str, Column]) -> Column:
    """The variables a row satisfies, as bits; one without a definition is always satisfied."""
    total = F.lit(0)
    for name, bit in variable_bits(pattern).items():
        total = total + F.when(define.get(name, F.lit(True)), bit).otherwise(0)
    return total


def row_code(mask: int) -> str:
    """The character for a mask."""
    return _ALPHABET[mask]


def pattern_regex(pattern: Pattern) -> str:
    """One group per element; an element's class holds every mask with its variable."""
    bits = variable_bits(pattern)
    out = ""
    for name, quantifier in pattern:
        _bounds(quantifier)
        chars = "".join(row_code(m) for m in range(1, 1 << len(bits)) if m & bits[name])
        out += f"([{chars}]{quantifier})"
    return out


def find_matches(regex: str, text: str, times, within_us: int | None) -> list[list[int]]:
    """Matches as ``[start, rows of element 1, rows of element 2, …]``, none sharing a row.

    A start whose match would last longer than ``within_us`` is passed over for
    the row after it.
    """
    out, at, rule = [], 0, re.compile(regex)
    while (m := rule.search(text, at)) is not None:
        start, end = m.span()
        if start == end or (within_us is not None and times[end - 1] - times[start] > within_us):
            at = start + 1
        else:
            out.append([start, *[m.end(g) - m.start(g) for g in range(1, rule.groups + 1)]])
            at = end
    return out


def match_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    pattern: Pattern,
    define: Mapping[str, Column],
    ties: Sequence[str] = (),
    lookback: Mapping[str, Callable[[WindowSpec], Column]] | None = None,
    within: str | None = None,
    skew: Skew = DEFAULT_SKEW,
) -> DataFrame:
    """One row per match: the keys and ``match``, an array of ``(variable, row)`` in order.

    ``define`` gives a condition per variable (a variable without one matches
    any row). Conditions may use the columns named in ``lookback``, which are
    computed over the row before (for ``price > LAST(price)`` give
    ``{"prev": lambda w: F.lag("price").over(w)}``). With ``within``, rows
    further apart than that never belong together, and a start whose match would
    last longer is passed over for the row after it.
    """
    source, bit, regex = df.columns, variable_bits(pattern), pattern_regex(pattern)
    lags = {"_prev_at": lambda w: F.lag(order).over(w), "_prev_mask": lambda w: F.lag("_mask").over(w)}
    line = df
    if lookback:  # the mask depends on the row before, so it takes a pass of its own
        looked = Ordered(df, keys, order, ties, skew=skew)
        line = settle(looked.over_rows(lookback, before=1), skew.min_bytes)
    neighbours = Ordered(line.withColumn("_mask", row_mask(pattern, define)), keys, order, ties, skew=skew)
    paired = neighbours.over_rows(lags, before=1)

    joined = F.lit(False)
    for name, after in followers(pattern).items():
        if after:
            wanted = sum(bit[a] for a in after)
            joined = joined | (
                (F.col("_prev_mask").bitwiseAND(F.lit(bit[name])) != 0) & (F.col("_mask").bitwiseAND(F.lit(wanted)) != 0)
            )
    if within:
        joined = joined & (F.col(order) <= F.col("_prev_at") + F.expr(f"interval {within}"))
    marked = paired.withColumn("_cut", (~F.coalesce(joined, F.lit(False))).cast("int"))
    # Read again below, to find where the runs of a heavy key begin.
    runs = Ordered(settle(marked, skew.min_bytes), keys, order, ties, skew=skew).running({"_run": ("sum", F.col("_cut"))})

    code = F.substr(F.lit(_ALPHABET), F.col("_mask") + 1, F.lit(1))
    seq = F.struct(F.col(order).alias("o"), F.struct(*ties).alias("t")) if ties else F.struct(F.col(order).alias("o"))
    gathered = (
        runs.where(F.col("_mask") != 0)
        .groupBy(*keys, "_run")
        .agg(F.array_sort(F.collect_list(F.struct(seq.alias("s"), code.alias("c"), F.struct(*source).alias("row")))).alias("_rows"))
    )
    text = F.array_join(F.transform("_rows", lambda r: r["c"]), "")
    hits = _hits_within(gathered, text, regex, order, within) if within else _hits(gathered, text, regex, len(pattern))
    found = hits.withColumn("_n", F.aggregate("_spans", F.lit(0), lambda a, x: a + x)).where(F.col("_n") > 0)
    labels = F.flatten(
        F.array(*[F.array_repeat(F.lit(name), F.get("_spans", F.lit(i))) for i, (name, _) in enumerate(pattern)])
    )
    out = found.withColumn("_labels", labels).withColumn(
        "match",
        F.zip_with("_labels", F.slice("_rows", F.col("_from") + 1, F.col("_n")), lambda v, r: F.struct(v.alias("variable"), r["row"].alias("row"))),
    )
    return out.select(*keys, "match")


def _hits(gathered: DataFrame, text: Column, regex: str, elements: int) -> DataFrame:
    """One row per match with ``_from`` and ``_spans``, by a regular expression that marks the matches in the text."""
    marks = "<" + ",".join(f"${i + 1}" for i in range(elements)) + ">"
    pieces = F.split(F.regexp_replace(text, F.lit(regex), F.lit(marks)), "<")
    clean = lambda p: F.length(F.regexp_replace(p, "[,>]", ""))
    return (
        gathered.withColumn("_pieces", pieces)
        .withColumn("_lengths", F.transform("_pieces", clean))
        .select("*", F.posexplode("_pieces").alias("_i", "_piece"))
        .where(F.col("_i") > 0)
        .withColumn("_from", F.aggregate(F.slice("_lengths", 1, F.col("_i")), F.lit(0), lambda a, x: a + x))
        .withColumn("_spans", F.transform(F.split(F.substring_index("_piece", ">", 1), ","), F.length))
    )


def _hits_within(gathered: DataFrame, text: Column, regex: str, order: str, within: str) -> DataFrame:
    """The same where matches are bounded in time, which a regular expression cannot see."""
    times = F.transform("_rows", lambda r: F.unix_micros(r["row"][order].cast("timestamp")))
    limit = F.expr(f"timestampdiff(microsecond, timestamp'1970-01-01', timestamp'1970-01-01' + interval {within})")

    @F.pandas_udf("array<array<int>>")
    def find(texts: pd.Series, stamps: pd.Series, limits: pd.Series) -> pd.Series:
        return pd.Series([find_matches(regex, x, t, n) for x, t, n in zip(texts, stamps, limits)])

    hits = gathered.withColumn("_hit", F.explode(find(text, times, limit)))
    return hits.withColumn("_from", F.get("_hit", F.lit(0))).withColumn("_spans", F.slice("_hit", 2, F.size("_hit") - 1))


def _of(variable: str | None) -> Column:
    m = F.col("match")
    return F.filter(m, lambda x: x["variable"] == variable) if variable else m


def first_of(variable: str | None, field: str) -> Column:
    """FIRST(variable.field); null when the variable took no row."""
    return F.get(_of(variable), F.lit(0))["row"][field]


def last_of(variable: str | None, field: str) -> Column:
    """LAST(variable.field); null when the variable took no row."""
    rows = _of(variable)
    return F.get(rows, F.size(rows) - 1)["row"][field]


def count_of(variable: str | None) -> Column:
    return F.size(_of(variable))


def sum_of(variable: str | None, field: str) -> Column:
    return F.aggregate(_of(variable), F.lit(0.0), lambda a, x: a + x["row"][field].cast("double"))


def one_row_per_match(matches: DataFrame, keys: Sequence[str], **measures: Column) -> DataFrame:
    return matches.select(*keys, *[c.alias(name) for name, c in measures.items()])


def all_rows_per_match(matches: DataFrame, order: str) -> DataFrame:
    """Every matched row with its variable (``classifier``) and the time its match began."""
    start = F.get("match", F.lit(0))["row"][order].alias("match_start")
    return matches.select(start, F.explode("match").alias("_m")).select(
        "match_start", F.col("_m.variable").alias("classifier"), "_m.row.*"
    )
