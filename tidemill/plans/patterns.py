"""Row pattern matching over ``events``."""

from pyspark.sql import functions as F

from tidemill.operators import patterns as P
from tidemill.operators import row_patterns as R
from tidemill.operators.automaton import Ref, Test
from tidemill.plans.catalog import query
from tidemill.tables import Tables

KIND = "event_type"


def _events(t: Tables):
    return t.events.select("event_id", "user_id", "ts", "event_type", "value")


# Each user's events as one string of letters in time order; a match is a run of
# letters, located by the lengths of the pieces before it.
LETTERS = """
    WITH l AS (SELECT user_id, string_agg({letter}, '' ORDER BY ts, event_id) AS s, list(event_id ORDER BY ts, event_id) AS ids,
                      list(ts ORDER BY ts, event_id) AS times, list(value ORDER BY ts, event_id) AS vals FROM events GROUP BY 1),
         p AS (SELECT *, string_split(regexp_replace(s, '({regex})', '<\\1>', 'g'), '<') AS pieces FROM l),
         q AS (SELECT *, unnest(range(2, len(pieces) + 1)) AS i FROM p),
         m AS (SELECT user_id, ids, times, vals, split_part(pieces[i], '>', 1) AS hit,
                      list_sum(list_transform(pieces[1:i - 1], lambda x: length(replace(x, '>', ''))))::BIGINT + 1 AS start FROM q)"""


@query(
    LETTERS.format(
        letter="CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'P' ELSE '.' END", regex="V+C+P"
    )
    + """SELECT user_id, times[start]::TIMESTAMP AS session_start, times[start + length(hit) - 1]::TIMESTAMP AS purchase_time, vals[start + length(hit) - 1] AS purchase_amount,
                (length(hit) - length(replace(hit, 'V', '')))::INTEGER AS views, (length(hit) - length(replace(hit, 'C', '')))::INTEGER AS clicks FROM m"""
)
def match_browse_to_purchase(t: Tables):
    """Views, then clicks, then a purchase: PATTERN (A+ B+ C), one row per match."""
    kind = F.col(KIND)
    found = R.matched_rows(
        _events(t),
        ["user_id"],
        "ts",
        [("A", "+"), ("B", "+"), ("C", "")],
        {"A": kind == "view", "B": kind == "click", "C": kind == "purchase"},
        ties=["event_id"],
    )
    return R.one_row_per_match(
        found,
        ["user_id"],
        session_start=R.first_of("A", "ts"),
        purchase_time=R.first_of("C", "ts"),
        purchase_amount=R.first_of("C", "value"),
        views=R.count_of("A"),
        clicks=R.count_of("B"),
    )


@query(
    """
    WITH o AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
         r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM o)
    SELECT user_id, arg_min(value, (ts, event_id)) AS start_value, arg_max(value, (ts, event_id)) AS end_value, min(ts) AS start_time, max(ts) AS end_time, (count(*) - 1)::INTEGER AS rises
    FROM r GROUP BY user_id, run HAVING count(*) > 1"""
)
def match_rising_values(t: Tables):
    """PATTERN (A B+) with B AS B.value > LAST(value): a row may satisfy both variables."""
    found = R.matched_rows(
        _events(t),
        ["user_id"],
        "ts",
        [("A", ""), ("B", "+")],
        {"B": F.col("value") > F.col("prev")},
        ties=["event_id"],
        lookback={"prev": lambda w: F.lag("value").over(w)},
    )
    return R.one_row_per_match(
        found,
        ["user_id"],
        start_value=R.first_of("A", "value"),
        end_value=R.last_of("B", "value"),
        start_time=R.first_of("A", "ts"),
        end_time=R.last_of("B", "ts"),
        rises=R.count_of("B"),
    )


@query(
    LETTERS.format(letter="CASE event_type WHEN 'error' THEN 'E' WHEN 'signup' THEN 'S' WHEN 'view' THEN 'V' ELSE '.' END", regex="E{2,3}V?S")
    + """, x AS (SELECT user_id, hit, start, ids, times, unnest(range(1, length(hit) + 1)) AS k FROM m)
      SELECT user_id, ids[start + k - 1] AS event_id, times[start]::TIMESTAMP AS match_start, CASE substr(hit, k, 1) WHEN 'E' THEN 'ERR' WHEN 'S' THEN 'SIGN' ELSE 'LOOK' END AS classifier FROM x"""
)
def match_all_rows(t: Tables):
    """Two or three errors, maybe a view, then a signup: ALL ROWS PER MATCH with CLASSIFIER."""
    kind = F.col(KIND)
    found = R.matched_rows(
        _events(t),
        ["user_id"],
        "ts",
        [("ERR", "{2,3}"), ("LOOK", "?"), ("SIGN", "")],
        {"ERR": kind == "error", "LOOK": kind == "view", "SIGN": kind == "signup"},
        ties=["event_id"],
    )
    return R.all_rows_per_match(found, ["user_id"], "ts").select("user_id", "event_id", "match_start", "classifier")


@query(
    """
    SELECT user_id, event_id AS signup_id, next_id AS purchase_id, next_ts - ts <= INTERVAL 1 HOUR AS within_hour
    FROM (SELECT *, lead(event_type) OVER w AS next_kind, lead(event_id) OVER w AS next_id, lead(ts) OVER w AS next_ts, lead(event_type, 2) OVER w AS third FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type = 'signup' AND next_kind = 'purchase' AND next_ts <= ts + INTERVAL 1 HOUR"""
)
def match_within_time(t: Tables):
    """A signup and the purchase right after it, WITHIN INTERVAL '1' HOUR."""
    kind = F.col(KIND)
    found = P.match_rows(
        _events(t),
        ["user_id"],
        "ts",
        [("A", ""), ("B", "")],
        {"A": kind == "signup", "B": kind == "purchase"},
        ties=["event_id"],
        within="1 hour",
    )
    return P.one_row_per_match(
        found,
        ["user_id"],
        signup_id=P.first_of("A", "event_id"),
        purchase_id=P.first_of("B", "event_id"),
        within_hour=P.last_of("B", "ts") <= P.first_of("A", "ts") + F.expr("interval 1 hour"),
    )


PRICE_DROP = """
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL),
         c AS (SELECT a.user_id, a.p, a.ts, a.value, min(b.p) AS q FROM e a JOIN e b ON b.user_id = a.user_id AND b.p > a.p AND b.value <= a.value - 10 GROUP BY ALL),
         m AS (SELECT c.*, b.value AS low, b.ts AS drop_time FROM c JOIN e b ON b.user_id = c.user_id AND b.p = c.q AND b.value < c.value - 10),
         w AS (SELECT user_id, min(p) AS p FROM m GROUP BY 1
               UNION ALL SELECT w.user_id, min(n.p) FROM w JOIN m ON m.user_id = w.user_id AND m.p = w.p JOIN m n ON n.user_id = w.user_id AND n.p > m.q GROUP BY w.user_id)
    SELECT user_id, m.ts AS start_time, drop_time, value - low AS drop_diff, (q - p - 1)::INTEGER AS held FROM m SEMI JOIN w USING (user_id, p)"""


@query(PRICE_DROP)
def match_price_drop(t: Tables):
    """PATTERN (A B* C) with B AS B.value > A.value - 10, C AS C.value < A.value - 10: conditions on an earlier variable's row."""
    a = Ref("A", "value")
    found = R.matched_rows(
        _events(t).where("value IS NOT NULL"),
        ["user_id"],
        "ts",
        [("A", ""), ("B", "*"), ("C", "")],
        {"B": Test(("value",), (a,), lambda value, a: value > a - 10), "C": Test(("value",), (a,), lambda value, a: value < a - 10)},
        ties=["event_id"],
    )
    return R.one_row_per_match(
        found,
        ["user_id"],
        start_time=R.first_of("A", "ts"),
        drop_time=R.first_of("C", "ts"),
        drop_diff=R.first_of("A", "value") - R.first_of("C", "value"),
        held=R.count_of("B"),
    )
