"""Data-quality assertions.

Row checks are conditions. ``violations`` evaluates all of them in one pass over
the rows (batch or stream) and emits one row per broken condition;
``check_results`` counts them in one aggregate. Checks that need more than one
row (keys, shares, rates, ages) return the same result columns, so a test
summary is a union: ``test_name, assertion, checked, failures, observed, passed``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type names accepted by the accepted_types assertion.
TYPE_NAMES = {
    "string": "string",
    "str": "string",
    "text": "string",
    "number": "double",
    "numeric": "double",
    "double": "double",
    "float": "double",
    "int": "int",
    "integer": "int",
    "bigint": "bigint",
    "long": "bigint",
    "boolean": "boolean",
    "bool": "boolean",
    "timestamp": "timestamp_ntz",
    "datetime": "timestamp_ntz",
    "date": "date",
    "time": "time",
}


@dataclass(frozen=True)
class Check:
    """A condition that holds for a bad row, its label, and the value to report."""

    label: str
    broken: Column
    detail: Column


def not_null(*columns: str) -> list[Check]:
    return [Check(f"not_null:{c}", F.col(c).isNull(), F.col(c).cast("string")) for c in columns]


def accepted_values(column: str, values: Sequence, null_is_violation: bool = False) -> list[Check]:
    c = F.col(column)
    broken = ~c.isin(*values)
    if null_is_violation:
        broken = broken | c.isNull()
    return [Check(f"accepted_values:{column}", broken, c.cast("string"))]


def value_range(column: str, low: float | None = None, high: float | None = None) -> list[Check]:
    """Inclusive bounds; nulls and values that are no numbers pass."""
    number, detail = F.col(column).try_cast("double"), F.col(column).cast("string")
    out = []
    if low is not None:
        out.append(Check(f"range_min:{column}", number < F.lit(float(low)), detail))
    if high is not None:
        out.append(Check(f"range_max:{column}", number > F.lit(float(high)), detail))
    return out


def accepted_types(types: Mapping[str, str]) -> list[Check]:
    out = []
    for column, name in types.items():
        if name.lower() not in TYPE_NAMES:
            continue  # an unknown type name checks nothing
        c = F.col(column)
        broken = c.cast("string").try_cast(TYPE_NAMES[name.lower()]).isNull() & c.isNotNull()
        out.append(Check(f"accepted_types:{column}", broken, c.cast("string")))
    return out


def custom_sql(name: str, where: str, detail_column: str) -> list[Check]:
    """Rows for which ``where`` holds are violations."""
    return [Check(f"custom_sql:{name}", F.expr(where), F.col(detail_column).cast("string"))]


def expression(name: str, sql: str, detail_column: str, null_fails: bool = False) -> list[Check]:
    """Rows for which ``sql`` does not hold are violations."""
    return [
        Check(f"expression:{name}", ~F.coalesce(F.expr(sql), F.lit(not null_fails)), F.col(detail_column).cast("string"))
    ]


def positive(column: str, allow_zero: bool = False) -> list[Check]:
    c = F.col(column)
    return [Check(f"positive:{column}", c < 0 if allow_zero else c <= 0, c.cast("string"))]


def max_lag(column: str, max_seconds: int, as_of: Column) -> list[Check]:
    """Rows older than ``max_seconds`` at ``as_of`` (the clock of the reader)."""
    age = F.timestamp_diff("SECOND", F.col(column).cast("timestamp"), as_of.cast("timestamp"))
    return [Check(f"max_lag:{column}", age > max_seconds, age.cast("string"))]


def column_checks(tests: Mapping[str, Sequence]) -> list[Check]:
    """Checks declared on columns: ``{"status": ["not_null", {"accepted_values": [...]}]}``.

    ``unique`` needs more than one row; see ``unique_key_result``.
    """
    out: list[Check] = []
    for column, items in tests.items():
        for item in items:
            kind, arg = (item, None) if isinstance(item, str) else next(iter(item.items()))
            if kind == "not_null":
                out += not_null(column)
            elif kind == "accepted_values":
                out += accepted_values(column, arg)
            elif kind == "range":
                out += value_range(column, arg.get("min"), arg.get("max"))
            elif kind == "positive":
                out += positive(column)
            elif kind == "accepted_types":
                out += accepted_types({column: arg})
            elif kind != "unique":
                raise ValueError(f"unknown column test {kind}")
    return out


def _found(checks: Sequence[Check]) -> Column:
    """What each check has to say about a row: a struct, or null where it holds."""
    return F.array(
        *[
            F.when(c.broken, F.struct(F.lit(c.label).alias("violation_type"), c.detail.alias("violation_details")))
            for c in checks
        ]
    )


def _any_broken(checks: Sequence[Check]) -> Column:
    return reduce(lambda a, b: a | b, [c.broken for c in checks])


def violations(
    df: DataFrame,
    test_name: str,
    checks: Sequence[Check],
    detected_at: Column | None = None,
    record: Column | None = None,
) -> DataFrame:
    """One row per broken check and row, from a single scan; works on streams.

    Good rows are filtered first, in the scan where the checks allow it.
    """
    found = df.where(_any_broken(checks)).select(
        F.explode(_found(checks)).alias("_v"),
        (record if record is not None else F.lit("")).alias("record"),
    )
    return found.where(F.col("_v").isNotNull()).select(
        F.lit(test_name).alias("test_name"),
        "_v.violation_type",
        "_v.violation_details",
        "record",
        (detected_at if detected_at is not None else F.current_timestamp()).alias("detected_at"),
    )


def with_violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Adds ``violations``, the labels broken by each row (empty for a good row)."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(c.broken, c.label) for c in checks])))


def split_on_checks(
    df: DataFrame, checks: Sequence[Check], include_error: bool = True, metadata: Mapping[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good rows as they came, and failing rows with their reasons for a dead-letter sink."""
    marked = with_violations(df, checks)
    good = marked.where(F.size("violations") == 0).drop("violations")
    bad = marked.where(F.size("violations") > 0)
    bad = bad.withColumn("error", F.array_join("violations", ";")) if include_error else bad
    for name, value in (metadata or {}).items():
        bad = bad.withColumn(name, value)
    return good, bad.drop("violations")


def _result(df: DataFrame, test_name: str, assertion: Column | str) -> DataFrame:
    return df.select(
        F.lit(test_name).alias("test_name"),
        (F.lit(assertion) if isinstance(assertion, str) else assertion).alias("assertion"),
        F.col("checked").cast("long").alias("checked"),
        F.col("failures").cast("long").alias("failures"),
        F.col("observed").cast("double").alias("observed"),
        F.col("passed").cast("boolean").alias("passed"),
    )


def check_results(df: DataFrame, test_name: str, checks: Sequence[Check]) -> DataFrame:
    """Failures per check, counted together in one aggregate."""
    counted = df.agg(
        F.count("*").alias("checked"),
        F.array(*[F.struct(F.lit(c.label).alias("label"), F.count_if(c.broken).alias("n")) for c in checks]).alias("r"),
    )
    rows = counted.select("checked", F.explode("r").alias("r")).select(
        "checked", F.col("r.label").alias("label"), F.col("r.n").alias("failures")
    )
    rows = rows.withColumn("observed", F.col("failures") / F.nullif(F.col("checked"), F.lit(0)))
    return _result(rows.withColumn("passed", F.col("failures") == 0), test_name, F.col("label"))


def invalid_value_report(df: DataFrame, column: str, values: Sequence, examples: int = 5) -> DataFrame:
    """How many distinct unaccepted values there are (null among them), with a few of them."""
    c = F.col(column)
    bad = df.where(~F.coalesce(c.isin(*values), F.lit(False))).select(
        F.coalesce(c.cast("string"), F.lit("None")).alias("value")
    )
    distinct = bad.groupBy("value").agg(F.count("*").alias("rows"))
    some = distinct.orderBy("value").limit(examples).agg(F.array_sort(F.collect_list("value")).alias("v"))
    return distinct.agg(F.count("*").alias("invalid_values"), F.sum("rows").alias("invalid_rows")).select(
        F.lit(column).alias("column"),
        "invalid_values",
        F.coalesce("invalid_rows", F.lit(0)).alias("invalid_rows"),
        F.array_join(some.scalar(), ",").alias("examples"),
    )


def unique_key_result(
    df: DataFrame,
    test_name: str,
    key: Sequence[str],
    tolerance: float = 0.0,
    ts: str | None = None,
    window: str | None = None,
) -> DataFrame:
    """Keys seen more than once, as a share of the rows; per time window when one is given."""
    by: list = list(key) + ([F.window(ts, window).alias("_w")] if window else [])
    seen = df.groupBy(*by).agg(F.count("*").alias("n"))
    out = seen.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"), F.count_if(F.col("n") > 1).alias("failures")
    )
    out = out.withColumn("observed", F.coalesce(F.col("failures") / F.nullif("checked", F.lit(0)), F.lit(0.0)))
    return _result(out.withColumn("passed", F.col("observed") <= tolerance), test_name, f"unique_key:{','.join(key)}")


def foreign_key_result(
    df: DataFrame, test_name: str, column: str, ref: DataFrame, ref_key: str, match_rate: float = 1.0
) -> DataFrame:
    """Share of non-null values found in ``ref``.

    Values are counted first, so a value holding a third of the rows travels as
    one row, and the reference keys are made distinct.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("n"))
    known = ref.select(F.col(ref_key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    out = counted.join(known, F.col("_v") == F.col("_k"), "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("n"))), F.lit(0)).alias("failures"),
    )
    out = out.withColumn("observed", F.coalesce(1 - F.col("failures") / F.nullif("checked", F.lit(0)), F.lit(1.0)))
    return _result(out.withColumn("passed", F.col("observed") >= match_rate), test_name, f"foreign_key:{column}")


def foreign_key_window_result(
    df: DataFrame,
    test_name: str,
    column: str,
    ts: str,
    ref: DataFrame,
    ref_key: str,
    ref_ts: str,
    window: str,
    match_rate: float = 1.0,
) -> DataFrame:
    """As ``foreign_key_result``, with the reference row at most ``window`` before or after.

    Only the times of reference rows next to each value matter, so both sides
    are reduced to key and time bucket before they meet.
    """
    from tidemill.operators.joins import interval_join

    facts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v"), F.col(ts).alias("_at")).agg(
        F.count("*").alias("n")
    )
    refs = ref.select(F.col(ref_key).alias("_k"), F.col(ref_ts).alias("_rt")).distinct()
    met = interval_join(facts, refs, {"_v": "_k"}, "_at", "_rt", f"-{window}", window, "left")
    once = met.groupBy("_v", "_at").agg(F.max("n").alias("n"), F.max(F.col("_k").isNotNull()).alias("hit"))
    out = once.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(~F.col("hit"), F.col("n"))), F.lit(0)).alias("failures"),
    )
    out = out.withColumn("observed", F.coalesce(1 - F.col("failures") / F.nullif("checked", F.lit(0)), F.lit(1.0)))
    return _result(out.withColumn("passed", F.col("observed") >= match_rate), test_name, f"foreign_key:{column}")


def distribution_result(df: DataFrame, test_name: str, column: str, buckets: Sequence[Mapping]) -> DataFrame:
    """Share of values per bucket ``[min, max)`` against ``expected_ratio`` and ``tolerance`` or ``max_ratio``."""
    c = F.col(column)

    def inside(b: Mapping) -> Column:
        cond = c.isNotNull()
        cond = cond & (c >= b["min"]) if b.get("min") is not None else cond
        return cond & (c < b["max"]) if b.get("max") is not None else cond

    def verdict(b: Mapping, share: Column) -> Column:
        ok = F.lit(True)
        if b.get("expected_ratio") is not None:
            ok = ok & (F.abs(share - b["expected_ratio"]) <= b.get("tolerance", 0.0))
        if b.get("max_ratio") is not None:
            ok = ok & (share <= b["max_ratio"])
        return ok

    counted = df.agg(
        F.count(c).alias("checked"), *[F.count_if(inside(b)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    )
    entries = []
    for i, b in enumerate(buckets):
        share = F.col(f"_b{i}") / F.nullif(F.col("checked"), F.lit(0))
        label = f"distribution:{column}[{b.get('min', '')},{b.get('max', '')})"
        ok = F.coalesce(verdict(b, share), F.lit(True))
        entries.append(
            F.struct(
                F.lit(label).alias("label"),
                F.when(~ok, F.col(f"_b{i}")).otherwise(0).alias("failures"),
                share.alias("observed"),
                ok.alias("passed"),
            )
        )
    rows = counted.select("checked", F.explode(F.array(*entries)).alias("r")).select("checked", "r.*")
    return _result(rows, test_name, F.col("label"))


def stddev_result(df: DataFrame, test_name: str, column: str, max_stddev: float) -> DataFrame:
    out = df.agg(F.count(column).alias("checked"), F.stddev(column).alias("observed"))
    out = out.withColumn("passed", F.coalesce(F.col("observed") <= max_stddev, F.lit(True)))
    out = out.withColumn("failures", F.when(F.col("passed"), 0).otherwise(1))
    return _result(out, test_name, f"distribution:{column}:max_stddev")


def throughput_result(
    df: DataFrame,
    test_name: str,
    ts: str,
    window: str,
    min_per_window: float | None = None,
    max_per_window: float | None = None,
) -> DataFrame:
    """Rows per window between the first and the last one; windows without rows count as 0.

    Empty windows are derived by arithmetic (span over width, less the windows
    seen) instead of being generated.
    """
    counts = df.groupBy(F.window(ts, window).alias("_w")).agg(F.count("*").alias("n"))
    low = F.col("n") < min_per_window if min_per_window is not None else F.lit(False)
    high = F.col("n") > max_per_window if max_per_window is not None else F.lit(False)
    start = F.unix_micros(F.col("_w.start").cast("timestamp"))
    width = F.unix_micros(F.col("_w.end").cast("timestamp")) - start
    out = counts.agg(
        F.coalesce(F.floor((F.max(start) - F.min(start)) / F.max(width)) + 1, F.lit(0)).alias("checked"),
        F.count("*").alias("_seen"),
        F.count_if(low | high).alias("_bad"),
        F.sum("n").alias("_rows"),
    )
    empty_fails = F.col("checked") - F.col("_seen") if min_per_window else F.lit(0)
    out = out.withColumn("failures", F.col("_bad") + empty_fails)
    out = out.withColumn("observed", F.col("_rows") / F.nullif(F.col("checked"), F.lit(0)))
    return _result(out.withColumn("passed", F.col("failures") == 0), test_name, f"throughput:{window}")


def freshness(
    df: DataFrame,
    ts: str,
    as_of: Column,
    warn_after: int,
    error_after: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Age in seconds of the newest row (per key) and ``ok``, ``warn`` or ``error``."""
    newest = df.groupBy(*keys).agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("SECOND", F.col("newest").cast("timestamp"), as_of.cast("timestamp"))
    status = (
        F.when(F.col("newest").isNull() | (F.col("age_seconds") > error_after), "error")
        .when(F.col("age_seconds") > warn_after, "warn")
        .otherwise("ok")
    )
    return newest.withColumn("age_seconds", age).withColumn("status", status)


def scalar_result(query: DataFrame, test_name: str, expect=None, max_failures: int | None = None) -> DataFrame:
    """A query whose single value must equal ``expect``, or whose rows must not exceed ``max_failures``."""
    if max_failures is not None:
        out = query.agg(F.count("*").alias("failures")).withColumn("checked", F.col("failures"))
        out = out.withColumn("observed", F.col("failures")).withColumn("passed", F.col("failures") <= max_failures)
    else:
        value = F.col(query.columns[0])
        out = query.limit(1).agg(F.max(value).alias("observed"), F.count("*").alias("checked"))
        out = out.withColumn("passed", F.col("observed").eqNullSafe(F.lit(expect)))
        out = out.withColumn("failures", F.when(F.col("passed"), 0).otherwise(1))
    return _result(out, test_name, "custom_sql")


def unknown_assertion(df: DataFrame, test_name: str, kind: str) -> DataFrame:
    """An assertion nobody knows passes; its label says that it was skipped."""
    out = df.agg(F.count("*").alias("checked")).select(
        "checked", F.lit(0).alias("failures"), F.lit(None).alias("observed"), F.lit(True).alias("passed")
    )
    return _result(out, test_name, f"warning: unknown assertion {kind} skipped")


def summarize(*results: DataFrame, severity: Mapping[str, str] | None = None) -> DataFrame:
    """Pass or fail per test and severity over any number of result frames."""
    rows = results[0]
    for r in results[1:]:
        rows = rows.unionByName(r)
    level = F.lit("error")
    for label, name in (severity or {}).items():
        level = F.when(F.col("assertion").startswith(label), name).otherwise(level)
    return (
        rows.groupBy("test_name", level.alias("severity"))
        .agg(
            F.count("*").alias("assertions"),
            F.count_if(~F.col("passed")).alias("failed"),
            F.sum("failures").alias("failures"),
        )
        .withColumn("passed", F.col("failed") == 0)
    )


def schema_check(df: DataFrame, declared: T.StructType) -> DataFrame:
    """A frame against its declared contract: types from the schema, NOT NULL from the data.

    One row per column of either side: ``column, expected, actual, nulls, status``.
    """
    have = {f.name: f for f in df.schema}
    want = {f.name: f for f in declared}
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(n).isNull()).alias(n) for n in have]
    )
    entries = []
    for name in [*want, *[n for n in have if n not in want]]:
        w, h = want.get(name), have.get(name)
        nulls = F.col(f"`{name}`") if h else F.lit(None).cast("long")
        if w is None:
            status = F.lit("undeclared")
        elif h is None:
            status = F.lit("missing")
        elif w.dataType != h.dataType:
            status = F.lit("type_mismatch")
        else:
            status = F.when(nulls > 0, "null_violation").otherwise("ok") if not w.nullable else F.lit("ok")
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(w.dataType.simpleString() if w else None).cast("string").alias("expected"),
                F.lit(h.dataType.simpleString() if h else None).cast("string").alias("actual"),
                nulls.alias("nulls"),
                status.alias("status"),
            )
        )
    return counted.select(F.inline(F.array(*entries)))
