"""Scalar-function queries, grouped by kind; each runs over a whole table."""

from pyspark.sql import functions as F

from tidemill.functions import collections as K
from tidemill.functions import conditionals as C
from tidemill.functions import datetimes as D
from tidemill.functions import json as J
from tidemill.functions import maths as X
from tidemill.functions import strings as S
from tidemill.plans.catalog import query
from tidemill.tables import Tables


@query(
    """
    SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, trim('  ' || c_mktsegment || ' ') AS trimmed, substr(c_name, 10, 3) AS part,
           c_name || '/' || c_mktsegment AS joined, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name || 'x' END AS with_null,
           concat_ws('-', c_mktsegment, CASE WHEN c_nationkey = 3 THEN NULL ELSE 'n' END, 'z') AS ws,
           ltrim('xx' || c_mktsegment, 'x') AS lt, rtrim(c_mktsegment || 'yy', 'y') AS rt, trim('--' || c_mktsegment || '--', '-') AS bt,
           lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 5, '*') AS rp
    FROM customer"""
)
def string_basics(t: Tables):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    other = F.col("c_nationkey") != 3
    return t.customer.select(
        "c_custkey",
        F.upper(seg).alias("up"),
        F.lower(name).alias("low"),
        F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("trimmed"),
        F.substring(name, 10, 3).alias("part"),
        S.concat(name, F.lit("/"), seg).alias("joined"),
        S.concat(F.when(other, name), F.lit("x")).alias("with_null"),
        F.concat_ws("-", seg, F.when(other, "n"), F.lit("z")).alias("ws"),
        F.ltrim(F.concat(F.lit("xx"), seg), F.lit("x")).alias("lt"),
        F.rtrim(F.concat(seg, F.lit("yy")), F.lit("y")).alias("rt"),
        S.btrim(F.concat(F.lit("--"), seg, F.lit("--")), "-").alias("bt"),
        F.lpad(seg, 12, "*").alias("lp"),
        F.rpad(seg, 5, "*").alias("rp"),
    )


@query(
    """
    SELECT p_partkey, instr(p_name, 'i') AS ins, strpos(substr(p_name, 4), 'i') + CASE WHEN strpos(substr(p_name, 4), 'i') > 0 THEN 3 ELSE 0 END AS loc,
           left(p_name, 2) || 'ZZ' || substr(p_name, 5) AS over, translate(p_brand, '#Brd', '-xy') AS trans,
           CASE p_size % 4 WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_type END AS chosen,
           replace(p_name, 'ring', 'RING') AS rep, reverse(p_name) AS rev, length(p_type) AS len,
           array_to_string(list_transform(regexp_extract_all(lower(p_type || '-' || p_name), '[^a-z0-9]*[a-z0-9]+'),
             lambda w: regexp_extract(w, '^[^a-z0-9]*') || upper(substr(regexp_extract(w, '[a-z0-9]+$'), 1, 1)) || substr(regexp_extract(w, '[a-z0-9]+$'), 2)), '') AS caps
    FROM part"""
)
def string_positions(t: Tables):
    name, size = F.col("p_name"), F.col("p_size")
    return t.part.select(
        "p_partkey",
        F.instr(name, "i").cast("long").alias("ins"),
        F.locate("i", name, 4).cast("long").alias("loc"),
        F.overlay(name, F.lit("ZZ"), F.lit(3)).alias("over"),
        F.translate("p_brand", "#Brd", "-xy").alias("trans"),
        S.elt(size % 4, name, F.col("p_brand"), F.col("p_type")).alias("chosen"),
        F.replace(name, F.lit("ring"), F.lit("RING")).alias("rep"),
        F.reverse(name).alias("rev"),
        F.length("p_type").cast("long").alias("len"),
        S.initcap(F.concat(F.col("p_type"), F.lit("-"), name)).alias("caps"),
    )


@query(
    r"""
    SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS no_digits, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') AS number,
           CASE WHEN regexp_matches(url, 'page=([0-9]*)') THEN regexp_extract(url, 'page=([0-9]*)', 1) END AS page,
           regexp_matches(url, '^https') AS secure, string_split(url, '/')[5] AS fifth, string_split(url, '/')[40] AS none, string_split(url, '.')[2] AS dotted
    FROM pages"""
)
def string_patterns(t: Tables):
    """Regular expressions and SPLIT_INDEX (0-based, literal delimiter, NULL out of range)."""
    url = F.col("url")
    return t.pages.select(
        "page_id",
        F.regexp_replace(url, "[0-9]+", "#").alias("no_digits"),
        S.regexp_extract(url, "/([a-z]{2})/([0-9]+)", 2).alias("number"),
        S.regexp_extract(url, "page=([0-9]*)", 1).alias("page"),
        url.rlike("^https").alias("secure"),
        S.split_index(url, "/", 4).alias("fifth"),
        S.split_index(url, "/", 39).alias("none"),
        S.split_index(url, ".", 1).alias("dotted"),
    )


@query(
    r"""
    SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path,
           nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref,
           nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, NULL::VARCHAR AS bad,
           url_encode(url) AS encoded, url AS decoded, base64(encode(url)) AS b64, url AS unb64, md5(url) AS digest
    FROM pages"""
)
def url_and_encoding(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        S.parse_url(url, "PROTOCOL").alias("protocol"),
        S.parse_url(url, "HOST").alias("host"),
        S.parse_url(url, "PATH").alias("path"),
        S.parse_url(url, "QUERY").alias("query"),
        S.parse_url(url, "REF").alias("ref"),
        S.parse_url(url, "QUERY", "page").alias("page"),
        S.parse_url(F.concat(F.lit("no url: "), url), "HOST").alias("bad"),
        F.url_encode(url).alias("encoded"),
        F.try_url_decode(F.url_encode(url)).alias("decoded"),
        S.to_base64(url).alias("b64"),
        S.from_base64(S.to_base64(url)).cast("string").alias("unb64"),
        F.md5(url).alias("digest"),
    )


@query(
    """
    SELECT event_id, user_id::VARCHAR AS user_text, event_type AS kind, NULL::VARCHAR AS missing, 2 AS pairs FROM events"""
)
def string_to_map(t: Tables):
    """STR_TO_MAP with its defaults (',' and '='), and map access by key."""
    text = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(",kind="), F.col("event_type"))
    m = t.events.select("event_id", S.str_to_map(text).alias("m"))
    return m.select(
        "event_id",
        K.at(F.col("m"), "user").alias("user_text"),
        K.at(F.col("m"), "kind").alias("kind"),
        K.at(F.col("m"), "nothing").alias("missing"),
        F.size("m").alias("pairs"),
    )


@query("SELECT count(*) AS n, count(*) AS distinct_ids, true AS well_formed FROM events")
def uuid_per_row(t: Tables):
    """UUID() gives every row its own well-formed identifier."""
    ids = t.events.select(F.uuid().alias("id"))
    return ids.agg(
        F.count("*").alias("n"),
        F.count_distinct("id").alias("distinct_ids"),
        F.bool_and(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("well_formed"),
    )


@query(
    """
    SELECT event_id, date_trunc('second', ts) AS parsed, strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y') AS parsed_fmt, NULL::TIMESTAMP AS unparsed,
           epoch(date_trunc('second', ts))::BIGINT AS unix, date_trunc('second', ts) AS from_seconds, date_trunc('millisecond', ts) AS from_millis,
           strftime(ts, '%Y-%m-%d %H:%M:%S') AS text, strftime(ts, '%Y/%m') AS month, CAST(ts AS DATE) AS day, NULL::DATE AS no_day
    FROM events"""
)
def time_parsing(t: Tables):
    """TO_TIMESTAMP, TO_TIMESTAMP_LTZ, UNIX_TIMESTAMP, FROM_UNIXTIME, DATE_FORMAT, TO_DATE."""
    ts = F.col("ts")
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    seconds, millis = F.unix_timestamp(text), F.unix_millis(ts.cast("timestamp"))
    return t.events.select(
        "event_id",
        D.to_timestamp(text).alias("parsed"),
        D.to_timestamp(F.date_format(ts, "dd/MM/yyyy"), "dd/MM/yyyy").alias("parsed_fmt"),
        D.to_timestamp(F.col("event_type")).alias("unparsed"),
        seconds.alias("unix"),
        D.to_timestamp_ltz(seconds, 0).cast("timestamp_ntz").alias("from_seconds"),
        D.to_timestamp_ltz(millis, 3).cast("timestamp_ntz").alias("from_millis"),
        F.from_unixtime(seconds).alias("text"),
        F.date_format(ts, "yyyy/MM").alias("month"),
        D.to_date(F.substring(text, 1, 10)).alias("day"),
        D.to_date(F.col("event_type")).alias("no_day"),
    )


@query(
    """
    SELECT event_id, ts + INTERVAL 90 MINUTE AS later, ts - INTERVAL 1 DAY AS earlier, ts + INTERVAL 3 DAY AS plus_days,
           datesub('hour', TIMESTAMP '2024-01-01', ts) AS hours, datesub('day', ts, TIMESTAMP '2024-01-15') AS days_until,
           datesub('minute', TIMESTAMP '2024-01-01', ts) AS minutes
    FROM events"""
)
def time_arithmetic(t: Tables):
    """INTERVAL arithmetic, TIMESTAMPADD, TIMESTAMPDIFF in whole units."""
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        (ts + F.expr("interval 90 minutes")).alias("later"),
        (ts - F.expr("interval 1 day")).alias("earlier"),
        D.timestampadd("DAY", F.lit(3), ts.cast("timestamp")).cast("timestamp_ntz").alias("plus_days"),
        D.timestampdiff("HOUR", F.expr("timestamp'2024-01-01'"), ts.cast("timestamp")).alias("hours"),
        D.timestampdiff("DAY", ts.cast("timestamp"), F.expr("timestamp'2024-01-15'")).alias("days_until"),
        D.timestampdiff("MINUTE", F.expr("timestamp'2024-01-01'"), ts.cast("timestamp")).alias("minutes"),
    )


@query(
    """
    SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, millisecond(ts) % 1000 AS ms,
           dayofweek(ts) + 1 AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS week, quarter(ts) AS q,
           strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS new_york
    FROM events"""
)
def time_fields(t: Tables):
    """EXTRACT and the calendar functions; CONVERT_TZ as text."""
    ts = F.col("ts")
    fields = {"y": "YEAR", "mo": "MONTH", "d": "DAY", "h": "HOUR", "mi": "MINUTE", "s": "SECOND", "ms": "MILLISECOND"}
    return t.events.select(
        "event_id",
        *[D.extract(unit, ts).alias(name) for name, unit in fields.items()],
        F.dayofweek(ts).cast("long").alias("dow"),
        F.dayofyear(ts).cast("long").alias("doy"),
        F.weekofyear(ts).cast("long").alias("week"),
        F.quarter(ts).cast("long").alias("q"),
        D.convert_tz(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "UTC", "America/New_York").alias("new_york"),
    )


@query(
    """
    SELECT event_id, round(log2(value), 9) AS lg2, round(log10(value), 9) AS lg10, round(sinh(value / 100), 9) AS sh, round(cosh(value / 100), 9) AS ch, round(tanh(value / 100), 9) AS th,
           round(cot(value), 6) AS ct, round(degrees(value), 6) AS deg, round(radians(value), 9) AS rad, round(value, 1) AS r1, user_id % 7 AS m, -user_id % 7 AS neg_m,
           abs(value - 50) AS a, round(sqrt(value), 9) AS sq, round(pow(value, 2), 4) AS p2,
           trunc(value::DECIMAL(18, 6) * 10) / 10 AS t1, (-trunc(value::DECIMAL(18, 6)))::DOUBLE AS t0, round(sqrt(pow(value - 1, 2) + pow(user_id, 2)) * 111 / greatest(value, 1) * 60, 6) AS eta
    FROM events"""
)
def math_functions(t: Tables):
    v, u = F.col("value"), F.col("user_id")

    def r(c, n=9):
        return F.round(c, n)

    return t.events.select(
        "event_id",
        r(X.log2(v)).alias("lg2"),
        r(X.log10(v)).alias("lg10"),
        r(F.sinh(v / 100)).alias("sh"),
        r(F.cosh(v / 100)).alias("ch"),
        r(F.tanh(v / 100)).alias("th"),
        r(F.cot(v), 6).alias("ct"),
        r(F.degrees(v), 6).alias("deg"),
        r(F.radians(v)).alias("rad"),
        F.round(v, 1).alias("r1"),
        X.mod(u, F.lit(7)).alias("m"),
        X.mod(-u, F.lit(7)).alias("neg_m"),
        F.abs(v - 50).alias("a"),
        r(F.sqrt(v)).alias("sq"),
        r(F.pow(v, F.lit(2)), 4).alias("p2"),
        X.truncate(v, 1).alias("t1"),
        X.truncate(-v, 0).alias("t0"),
        r(F.sqrt(F.pow(v - 1, F.lit(2)) + F.pow(u, F.lit(2))) * 111 / C.greatest(v, F.lit(1.0)) * 60, 6).alias("eta"),
    )


@query("SELECT count(*) AS n, true AS in_unit, true AS in_range, 10::BIGINT AS faces FROM events")
def random_functions(t: Tables):
    """RAND and RAND_INTEGER stay in their ranges and reach every value."""
    r = t.events.select(F.rand(7).alias("u"), X.rand_integer(10, 11).alias("d"))
    return r.agg(
        F.count("*").alias("n"),
        F.bool_and((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_unit"),
        F.bool_and(F.col("d").between(0, 9)).alias("in_range"),
        F.count_distinct("d").alias("faces"),
    )


DOC = """'{"user":{"id":' || user_id || ',"tags":["' || event_type || '","x"]},"nothing":null,"v":' || value || ',"s":"a b"}'"""


def _documents(t: Tables):
    u, k, v = (F.col(c).cast("string") for c in ("user_id", "event_type", "value"))
    text = F.concat(
        F.lit('{"user":{"id":'), u, F.lit(',"tags":["'), k, F.lit('","x"]},"nothing":null,"v":'), v, F.lit(',"s":"a b"}')
    )
    return t.events.select("event_id", "user_id", "event_type", "value", "props", text.alias("j"))


@query(
    f"""
    SELECT event_id, user_id::VARCHAR AS id, event_type AS tag, 'a b' AS s, value::VARCHAR AS v, NULL::VARCHAR AS object_value, NULL::VARCHAR AS array_value, NULL::VARCHAR AS missing, NULL::VARCHAR AS broken
    FROM events"""
)
def json_value(t: Tables):
    """JSON_VALUE gives scalars only; objects, arrays, missing paths and bad JSON give NULL."""
    j = F.col("j")
    return _documents(t).select(
        "event_id",
        J.json_value(j, "$.user.id").alias("id"),
        J.json_value(j, "$.user.tags[0]").alias("tag"),
        J.json_value(j, "$.s").alias("s"),
        J.json_value(j, "$.v").alias("v"),
        J.json_value(j, "$.user").alias("object_value"),
        J.json_value(j, "$.user.tags").alias("array_value"),
        J.json_value(j, "$.user.nope").alias("missing"),
        J.json_value(F.concat(F.lit("{"), j), "$.s").alias("broken"),
    )


@query(
    f"""
    SELECT event_id, json_extract(j, '$.user')::VARCHAR AS user_object, json_extract(j, '$.user.tags')::VARCHAR AS tags, NULL::VARCHAR AS scalar,
           true AS has_id, true AS has_nothing, false AS has_nope, json_valid(j) AS valid, json_valid(event_type) AS word_valid, json_valid(user_id::VARCHAR) AS number_valid
    FROM (SELECT *, {DOC} AS j FROM events)"""
)
def json_query_and_tests(t: Tables):
    """JSON_QUERY, JSON_EXISTS (a JSON null exists) and IS JSON."""
    j = F.col("j")
    return _documents(t).select(
        "event_id",
        J.json_query(j, "$.user").alias("user_object"),
        J.json_query(j, "$.user.tags").alias("tags"),
        J.json_query(j, "$.s").alias("scalar"),
        J.json_exists(j, "$.user.id").alias("has_id"),
        J.json_exists(j, "$.nothing").alias("has_nothing"),
        J.json_exists(j, "$.nope").alias("has_nope"),
        J.is_json(j).alias("valid"),
        J.is_json(F.col("event_type")).alias("word_valid"),
        J.is_json(F.col("user_id").cast("string")).alias("number_valid"),
    )


@query(
    """
    SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","none":null}' AS object, '[' || event_id || ',' || user_id || ']' AS array_,
           event_id::VARCHAR AS number_text, '"' || event_type || '"' AS quoted, event_type AS unquoted, event_type AS left_alone
    FROM events"""
)
def json_construction(t: Tables):
    """JSON_OBJECT (nulls kept), JSON_ARRAY, JSON_STRING, JSON_QUOTE, JSON_UNQUOTE."""
    kind = F.col("event_type")
    return t.events.select(
        "event_id",
        J.json_object(id=F.col("event_id"), kind=kind, none=F.lit(None).cast("string")).alias("object"),
        J.json_array(F.col("event_id"), F.col("user_id")).alias("array_"),
        J.json_string(F.col("event_id")).alias("number_text"),
        J.json_quote(kind).alias("quoted"),
        J.json_unquote(J.json_quote(kind)).alias("unquoted"),
        J.json_unquote(kind).alias("left_alone"),
    )


@query(
    """
    WITH a AS (SELECT page_id, string_split(url, '/') AS a FROM pages)
    SELECT page_id, len(a) AS cardinality, list_contains(a, 'www') AS has_www, len(list_distinct(a)) AS distinct_parts, list_filter(a, lambda x: x <> '') AS without_empty,
           len(list_distinct(a || ['x', 'http:'])) AS union_size, a || ['x'] AS appended, coalesce(list_position(a, ''), 0)::INTEGER AS empty_at, list_reverse(a) AS reversed_,
           a[2:3] AS sliced, a[1] AS first_part, a[99] AS beyond, a[1] AS only_one
    FROM a"""
)
def array_functions(t: Tables):
    a = F.col("a")
    return t.pages.select("page_id", F.split("url", "/").alias("a")).select(
        "page_id",
        F.cardinality(a).cast("long").alias("cardinality"),
        F.array_contains(a, "www").alias("has_www"),
        F.size(F.array_distinct(a)).cast("long").alias("distinct_parts"),
        F.array_remove(a, "").alias("without_empty"),
        F.size(F.array_union(a, F.array(F.lit("x"), F.lit("http:")))).cast("long").alias("union_size"),
        F.concat(a, F.array(F.lit("x"))).alias("appended"),
        K.array_position(a, "").alias("empty_at"),
        F.reverse(a).alias("reversed_"),
        K.array_slice(a, 2, 3).alias("sliced"),
        K.at(a, 1).alias("first_part"),
        K.at(a, 99).alias("beyond"),
        K.element(K.array_slice(a, 1, 1)).alias("only_one"),
    )


@query(
    """
    SELECT event_id, ['k', 'kind', 'user'] AS keys, list_sort([event_type, user_id::VARCHAR, props->>'$.k']) AS vals, 3::BIGINT AS entries,
           event_type AS kind, 'override' AS user_after_union, 4::BIGINT AS union_size, NULL::VARCHAR AS missing
    FROM events"""
)
def map_functions(t: Tables):
    """MAP_FROM_ARRAYS, MAP_KEYS, MAP_VALUES, MAP_ENTRIES, MAP_UNION (last wins), access by key."""
    keys = F.array(F.lit("user"), F.lit("kind"), F.lit("k"))
    values = F.array(F.col("user_id").cast("string"), F.col("event_type"), J.json_value(F.col("props"), "$.k"))
    other = F.create_map(F.lit("user"), F.lit("override"), F.lit("more"), F.lit("1"))
    m = t.events.select("event_id", F.map_from_arrays(keys, values).alias("m")).withColumn("u", K.map_union(F.col("m"), other))
    return m.select(
        "event_id",
        F.array_sort(F.map_keys("m")).alias("keys"),
        F.array_sort(F.map_values("m")).alias("vals"),
        F.size(F.map_entries("m")).cast("long").alias("entries"),
        K.at(F.col("m"), "kind").alias("kind"),
        K.at(F.col("u"), "user").alias("user_after_union"),
        F.size("u").cast("long").alias("union_size"),
        K.at(F.col("m"), "nope").alias("missing"),
    )
