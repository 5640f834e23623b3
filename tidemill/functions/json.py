"""JSON functions on text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_DROP = {"ignoreNullFields": "false"}


def _node(c: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(c), path, "variant")


def _is_scalar(node: Column) -> Column:
    kind = F.schema_of_variant(node)
    return ~(kind.startswith("OBJECT") | kind.startswith("ARRAY"))


def json_value(c: Column, path: str) -> Column:
    """The text of a scalar as written (``28.0`` stays so); NULL for objects, arrays, missing paths and bad JSON."""
    node = _node(c, path)
    return F.when(_is_scalar(node), F.get_json_object(c, path))


def json_query(c: Column, path: str) -> Column:
    """The JSON text of an object or array; NULL for scalars, missing paths and bad JSON."""
    node = _node(c, path)
    return F.when(~_is_scalar(node), F.get_json_object(c, path))


def json_exists(c: Column, path: str) -> Column:
    """A member holding JSON null exists; false for bad JSON."""
    return F.when(c.isNotNull(), _node(c, path).isNotNull())


def is_json(c: Column) -> Column:
    return F.when(c.isNotNull(), F.try_parse_json(c).isNotNull()).otherwise(False)


def json_object(**fields: Column) -> Column:
    """NULL members are kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), _NO_DROP)


def json_array(*values: Column) -> Column:
    return F.to_json(F.array(*values), _NO_DROP)


def json_string(c: Column) -> Column:
    """Any scalar as JSON text."""
    wrapped = F.to_json(F.array(c), _NO_DROP)
    return F.when(c.isNotNull(), F.substr(wrapped, F.lit(2), F.length(wrapped) - 2))


def json_quote(c: Column) -> Column:
    return json_string(c.cast("string"))


def json_unquote(c: Column) -> Column:
    """The text inside a JSON string; other text unchanged."""
    inner = F.try_variant_get(F.try_parse_json(c), "$", "string")
    return F.when(c.rlike(r'^".*"$'), F.coalesce(inner, c)).otherwise(c)


def json_arrayagg(c: Column) -> Column:
    """A sorted array of the non-null values of a group, as JSON text."""
    return F.to_json(F.array_sort(F.collect_list(c)))


def json_objectagg(key: Column, value: Column) -> Column:
    """An object per group, members in key order. Keys must be unique within the group."""
    entries = F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))
    return F.to_json(F.map_from_entries(entries), _NO_DROP)
