"""Column masks, role-scoped views, classification rules and schema evolution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.strings import to_base64

# The classification levels, least to most protected, and those a mask must cover.
LEVELS = ("public", "internal", "confidential", "sensitive", "highly_sensitive")
MUST_MASK = ("sensitive", "highly_sensitive")
REDACTED = "***"


def hash_mask(c: Column, algorithm: str = "sha256") -> Column:
    text = c.cast("string")
    return F.md5(text) if algorithm == "md5" else F.sha2(text, 256)


def redact(c: Column, text: str = REDACTED) -> Column:
    return F.when(c.isNotNull(), F.lit(text))


def partial(c: Column, keep: int = 4) -> Column:
    """Letters and digits become ``*`` except in the last ``keep`` characters; short values go whole."""
    text = c.cast("string")
    head = F.substr(text, F.lit(1), F.length(text) - keep)
    hidden = F.concat(F.regexp_replace(head, r"[\p{L}\p{N}]", "*"), F.right(text, F.lit(keep)))
    return F.when(F.length(text) > keep, hidden).otherwise(F.regexp_replace(text, r"[\p{L}\p{N}]", "*"))


def tokenize(c: Column, salt: str = "") -> Column:
    """The same value always gives the same token; ``token_vault`` leads back."""
    return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(salt), c.cast("string")), 256), 1, 32))


def token_vault(df: DataFrame, column: str, salt: str = "") -> DataFrame:
    """Every distinct value with its token, to be stored where few may read it."""
    c = F.col(column)
    return df.where(c.isNotNull()).select(tokenize(c, salt).alias("token"), c.alias("value")).distinct()


def detokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    known = vault.select(F.col("token").alias("_token"), F.col("value").alias("_value"))
    out = df.join(known, F.col(column) == F.col("_token"), "left")
    return out.withColumn(column, F.col("_value")).drop("_token", "_value")


def blank(c: Column, kind: T.DataType) -> Column:
    """The type's empty value, as written to a sink in place of a field that must stay."""
    empty = {
        T.StringType: "",
        T.BooleanType: False,
        T.ByteType: 0,
        T.ShortType: 0,
        T.IntegerType: 0,
        T.LongType: 0,
        T.FloatType: 0.0,
        T.DoubleType: 0.0,
        T.DecimalType: 0,
    }
    value = F.lit(empty.get(type(kind))).cast(kind)
    return F.when(c.isNotNull(), value)


def blank_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for name in columns:
        df = df.withColumn(name, blank(F.col(name), df.schema[name].dataType))
    return df


@dataclass(frozen=True)
class MaskPolicy:
    """A mask for one column, applied to readers in ``for_roles`` (to all when empty)."""

    column: str
    method: str
    for_roles: tuple[str, ...] = ()
    options: Mapping[str, object] = field(default_factory=dict)

    def applies(self, role: str | None) -> bool:
        return not self.for_roles or role in self.for_roles


def mask_column(df: DataFrame, policy: MaskPolicy) -> Column:
    c, options = F.col(policy.column), dict(policy.options)
    if policy.method == "hash":
        return hash_mask(c, **options)
    if policy.method == "redact":
        return redact(c, **options)
    if policy.method == "partial":
        return partial(c, **options)
    if policy.method == "null":
        return F.lit(None).cast(df.schema[policy.column].dataType)
    if policy.method == "tokenize":
        return tokenize(c, **options)
    raise ValueError(f"unknown mask {policy.method}")


def masked_view(df: DataFrame, policies: Sequence[MaskPolicy], role: str | None = None) -> DataFrame:
    """``df`` as a reader with ``role`` may see it; column order is kept."""
    masks = {p.column: mask_column(df, p) for p in policies if p.applies(role)}
    return df.select(*[masks[c].alias(c) if c in masks else F.col(c) for c in df.columns])


def classified_view(
    df: DataFrame, classes: Mapping[str, str], methods: Mapping[str, str], role: str | None = None, cleared: Sequence[str] = ()
) -> DataFrame:
    """Masks chosen by classification level; a role in ``cleared`` sees everything."""
    if role is not None and role in cleared:
        return df
    return masked_view(df, [MaskPolicy(c, methods[level]) for c, level in classes.items() if level in methods])


def uncovered_columns(df: DataFrame, classes: Mapping[str, str], policies: Sequence[MaskPolicy]) -> DataFrame:
    """Columns whose level asks for a mask and that have none, with the rows they expose."""
    covered = {p.column for p in policies}
    open_columns = [c for c, level in classes.items() if level in MUST_MASK and c not in covered]
    counted = df.agg(F.lit(0).alias("_"), *[F.count(c).alias(c) for c in open_columns])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(classes[c]).alias("level"), F.col(c).alias("exposed_rows"))
        for c in open_columns
    ]
    if not entries:
        return counted.where(F.lit(False)).selectExpr("'' AS column", "'' AS level", "0L AS exposed_rows")
    return counted.select(F.inline(F.array(*entries)))


def row_access(df: DataFrame, role: str, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """All rows for an allowed role, none for others; ``deny`` wins over ``allow``."""
    allowed = role not in deny and (not allow or role in allow)
    return df if allowed else df.where(F.lit(False))


def tenant_view(df: DataFrame, column: str, tenant) -> DataFrame:
    return df.where(F.col(column) == F.lit(tenant))


def encrypt(c: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce per value; base64 text. The key has 16, 24 or 32 bytes."""
    return to_base64(F.aes_encrypt(c.cast("string"), key, F.lit("GCM")))


def decrypt(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key, F.lit("GCM")).cast("string")


# -- schema evolution -------------------------------------------------------


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """A batch cast to a new schema: extra columns dropped, missing ones null, bad values null."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target
        ]
    )


def _losses(df: DataFrame, target: T.StructType) -> list[tuple[str, str, Column]]:
    want = {f.name: f for f in target}
    out: list[tuple[str, str, Column]] = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name not in want:
            out.append((f.name, "removed", F.count(c)))
        elif want[f.name].dataType != f.dataType:
            # Lost: no longer readable, or not the same value after the way there and back.
            there = c.try_cast(want[f.name].dataType)
            back = there.try_cast(f.dataType)
            out.append((f.name, "retyped", F.count_if(c.isNotNull() & ~back.eqNullSafe(c))))
        elif not want[f.name].nullable:
            out.append((f.name, "not_null", F.count_if(c.isNull())))
        else:
            out.append((f.name, "same", F.lit(0).cast("long")))
    for name, f in want.items():
        if name not in df.columns:
            out.append((name, "added", F.lit(0).cast("long") if f.nullable else F.count(F.lit(1))))
    return out


def evolution_check(df: DataFrame, target: T.StructType, mode: str = "BACKWARD") -> DataFrame:
    """Per column: what the change to ``target`` does to the rows of this batch.

    ``affected_rows`` counts rows that lose data or break a constraint.
    BACKWARD (new readers, old data) rejects retyping with loss and additions
    without a null; FORWARD (old readers, new data) rejects removals; FULL both.
    """
    losses = _losses(df, target)
    backward, forward = mode in ("BACKWARD", "FULL"), mode in ("FORWARD", "FULL")
    counted = df.agg(*[n.alias(f"_n{i}") for i, (_, _, n) in enumerate(losses)])
    entries = []
    for i, (name, change, _) in enumerate(losses):
        n = F.col(f"_n{i}").cast("long")
        judged = {
            "removed": forward,
            "retyped": True,
            "not_null": backward,
            "added": backward,
            "same": False,
        }[change]
        entries.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(change).alias("change"),
                n.alias("affected_rows"),
                (n == 0 if judged else F.lit(True)).alias("compatible"),
            )
        )
    return counted.select(F.inline(F.array(*entries)))
