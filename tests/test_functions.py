"""Edges where the functions differ from Spark's own."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemill.functions import collections as K
from tidemill.functions import conditionals as C
from tidemill.functions import datetimes as D
from tidemill.functions import json as J
from tidemill.functions import maths as X
from tidemill.functions import strings as S

lit = F.lit


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


CASES = [
    (lambda: C.greatest(lit(1), lit(None).cast("int"), lit(3)), None),
    (lambda: C.greatest(lit(1), lit(3)), 3),
    (lambda: C.least(lit(1), lit(None).cast("int")), None),
    (lambda: C.if_(lit(None).cast("boolean"), lit(1), lit(2)), 2),
    (lambda: C.safe_ratio(lit(1.0), lit(0.0)), None),
    (lambda: C.simple_case(lit(None).cast("int"), {1: "a"}, "z"), "z"),
    (lambda: S.regexp_extract(lit("abc"), "x(.)", 1), None),
    (lambda: S.regexp_extract(lit("ac"), "a(b?)c", 1), ""),
    (lambda: S.regexp_full_match(lit("abc"), "b"), False),
    (lambda: S.split_index(lit("a.b.c"), ".", 1), "b"),
    (lambda: S.split_index(lit("a.b.c"), ".", 3), None),
    (lambda: S.split_index(lit("a.b.c"), ".", -1), None),
    (lambda: S.split_index(lit("a||b"), "|", 1), ""),
    (lambda: S.initcap(lit("hELLO-wORLD 2nd_é")), "Hello-World 2nd_É"),
    (lambda: S.initcap(lit("")), ""),
    (lambda: S.elt(lit(0), lit("a"), lit("b")), None),
    (lambda: S.elt(lit(2), lit("a"), lit("b")), "b"),
    (lambda: S.elt(lit(3), lit("a"), lit("b")), None),
    (lambda: S.str_to_map(lit("a=1,b=2")), {"a": "1", "b": "2"}),
    (lambda: S.parse_url(lit("not a url"), "HOST"), None),
    (lambda: S.parse_url(lit("http://h/p?k=v#r"), "QUERY", "k"), "v"),
    (lambda: S.concat(lit("a"), lit(None).cast("string")), None),
    (lambda: F.concat_ws("-", lit("a"), lit(None).cast("string"), lit("b")), "a-b"),
    (lambda: D.to_timestamp(lit("rubbish")), None),
    (lambda: D.to_timestamp(lit("2024-02-03 04:05:06")), datetime(2024, 2, 3, 4, 5, 6)),
    (lambda: D.to_timestamp_ltz(lit(1), 0).cast("timestamp_ntz"), datetime(1970, 1, 1, 0, 0, 1)),
    (lambda: D.to_timestamp_ltz(lit(1), 3).cast("timestamp_ntz"), datetime(1970, 1, 1, 0, 0, 0, 1000)),
    (lambda: D.to_date(lit("2024-13-01")), None),
    (lambda: D.to_date(lit("03/02/2024"), "dd/MM/yyyy"), date(2024, 2, 3)),
    (lambda: D.convert_tz(lit("2024-07-01 12:00:00"), "UTC", "America/New_York"), "2024-07-01 08:00:00"),
    (lambda: D.convert_tz(lit("bad"), "UTC", "America/New_York"), None),
    (lambda: D.extract("MILLISECOND", F.expr("timestamp_ntz'2024-01-01 00:00:07.123'")), 123),
    (lambda: D.extract("SECOND", F.expr("timestamp_ntz'2024-01-01 00:00:07.9'")), 7),
    (lambda: D.timestampdiff("HOUR", F.expr("timestamp'2024-01-01 01:30:00'"), F.expr("timestamp'2024-01-01 00:00:00'")), -1),
    (lambda: X.truncate(lit(42.987), 2), 42.98),
    (lambda: X.truncate(lit(-42.987), 2), -42.98),
    (lambda: X.truncate(lit(-0.5)), 0.0),
    (lambda: X.mod(lit(-7), lit(3)), -1),
    (lambda: X.log2(lit(8.0)), 3.0),
    (lambda: X.log10(lit(0)), float("-inf")),
    (lambda: F.isnan(X.log2(lit(-1.0))), True),
    (lambda: X.log2(lit(None).cast("double")), None),
    (lambda: S.to_base64(F.repeat(lit("abc"), 40)), "YWJj" * 40),
    (lambda: S.from_base64(lit("YWJj")), b"abc"),
    (lambda: S.from_base64(lit("/w==")), b"\xff"),
    (lambda: S.from_base64(lit("?")), None),
    (lambda: J.json_value(lit('{"a":{"b":1}}'), "$.a"), None),
    (lambda: J.json_value(lit('{"a":{"b":1}}'), "$.a.b"), "1"),
    (lambda: J.json_value(lit('{"a":null}'), "$.a"), None),
    (lambda: J.json_value(lit("{"), "$.a"), None),
    (lambda: J.json_value(lit('{"a":true}'), "$.a"), "true"),
    (lambda: J.json_query(lit('{"a":[1,2]}'), "$.a"), "[1,2]"),
    (lambda: J.json_query(lit('{"a":1}'), "$.a"), None),
    (lambda: J.json_exists(lit('{"a":null}'), "$.a"), True),
    (lambda: J.json_exists(lit('{"a":null}'), "$.b"), False),
    (lambda: J.json_exists(lit("{"), "$.a"), False),
    (lambda: J.is_json(lit(None).cast("string")), False),
    (lambda: J.is_json(lit("[1")), False),
    (lambda: J.is_json(lit("3")), True),
    (lambda: J.json_object(a=lit(1), b=lit(None).cast("int")), '{"a":1,"b":null}'),
    (lambda: J.json_array(lit("x"), lit(None).cast("string")), '["x",null]'),
    (lambda: J.json_string(lit(None).cast("int")), None),
    (lambda: J.json_quote(lit('a"b\n')), '"a\\"b\\n"'),
    (lambda: J.json_unquote(lit('"a\\"b"')), 'a"b'),
    (lambda: J.json_unquote(lit("plain")), "plain"),
    (lambda: K.element(F.array(lit(4))), 4),
    (lambda: K.element(F.array().cast("array<int>")), None),
    (lambda: K.array_slice(F.array(*[lit(i) for i in range(1, 6)]), 2, 4), [2, 3, 4]),
    (lambda: K.array_slice(F.array(lit(1)), 3, 2), []),
    (lambda: K.array_position(F.array(lit(1)), 9), 0),
    (lambda: K.at(F.array(lit(1)), 2), None),
    (lambda: K.at(F.create_map(lit("a"), lit(1)), "b"), None),
    (lambda: K.map_union(F.create_map(lit("a"), lit(1), lit("b"), lit(2)), F.create_map(lit("b"), lit(3)), F.create_map(lit("c"), lit(4))), {"a": 1, "b": 3, "c": 4}),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_edge(spark, n):
    make, want = CASES[n]
    assert one(spark, make()) == want


def test_element_of_two_is_an_error(spark):
    with pytest.raises(Exception, match="at most one"):
        one(spark, K.element(F.array(lit(1), lit(2))))


def test_precision_is_checked():
    with pytest.raises(ValueError):
        D.to_timestamp_ltz(None, 6)


def test_json_aggregates(spark):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, v int")
    row = df.agg(J.json_arrayagg(F.col("k")), J.json_objectagg(F.col("k"), F.col("v"))).first()
    assert tuple(row) == ('["a","b"]', '{"a":null,"b":2}')
