"""The canonical frames in DuckDB SQL, as common table expressions for the oracle queries."""

from __future__ import annotations

BARS = """bars AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(l_quantity) AS volume
  FROM (SELECT p_brand, l_shipdate, l_quantity, l_extendedprice / l_quantity AS px,
          {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': l_quantity} AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2)"""

HOLIDAYS = """years AS (SELECT unnest(range(1990, 2031))::INT AS y),
easter0 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
easter1 AS (SELECT *, b // 4 AS d, b % 4 AS e, (8 * b + 13) // 25 AS g, c // 4 AS i, c % 4 AS k FROM easter0),
easter2 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h FROM easter1),
easter3 AS (SELECT *, (a + 11 * h) // 319 AS m FROM easter2),
easter4 AS (SELECT *, (2 * e + 2 * i - k - h + m + 32) % 7 AS r FROM easter3),
easter5 AS (SELECT *, (h - m + r + 90) // 25 AS mon FROM easter4),
easter AS (SELECT y, make_date(y, mon, (h - m + r + mon + 19) % 32) AS easter FROM easter5),
fixed AS (
  SELECT y, n, CASE isodow(d) WHEN 6 THEN d - 1 WHEN 7 THEN d + 1 ELSE d END AS d FROM (
    SELECT y, 'independence' AS n, make_date(y, 7, 4) AS d FROM years UNION ALL SELECT y, 'christmas', make_date(y, 12, 25) FROM years
    UNION ALL SELECT y, 'juneteenth', make_date(y, 6, 19) FROM years WHERE y >= 2022
    UNION ALL SELECT y, 'new_year', make_date(y, 1, 1) FROM years WHERE isodow(make_date(y, 1, 1)) <> 6)),
floating AS (
  SELECT y, n, f + ((dow - isodow(f) + 7) % 7 + 7 * (nth - 1))::INT AS d FROM (
    SELECT y, 'mlk' AS n, make_date(y, 1, 1) AS f, 1 AS dow, 3 AS nth FROM years UNION ALL SELECT y, 'washington', make_date(y, 2, 1), 1, 3 FROM years
    UNION ALL SELECT y, 'labor', make_date(y, 9, 1), 1, 1 FROM years UNION ALL SELECT y, 'thanksgiving', make_date(y, 11, 1), 4, 4 FROM years)
  UNION ALL SELECT y, 'memorial', make_date(y, 5, 31) - (isodow(make_date(y, 5, 31)) - 1)::INT FROM years
  UNION ALL SELECT y, 'good_friday', easter - 2 FROM easter),
holidays AS (
  SELECT d AS date, n AS holiday FROM (SELECT * FROM fixed UNION ALL SELECT * FROM floating) WHERE year(d) = y
  UNION ALL SELECT unnest(['2001-09-11','2001-09-12','2001-09-13','2001-09-14','2004-06-11','2007-01-02','2012-10-29','2012-10-30','2018-12-05','2025-01-09'])::DATE, 'ad_hoc')"""

SESSIONS = """sessions AS (
  SELECT date, row_number() OVER (ORDER BY date)::INT AS session_no FROM (
    SELECT unnest(generate_series((SELECT min(date) FROM bars)::TIMESTAMP, (SELECT max(date) FROM bars)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date)
  WHERE isodow(date) < 6 AND date NOT IN (SELECT date FROM holidays))"""

PANEL = """panel AS (
  SELECT s.session_no, s.date, t.ticker, b.open, b.high, b.low, b.close, b.volume
  FROM sessions s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = s.date)"""

RETURNS = """returns AS (SELECT session_no, date, ticker, close, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS r
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"""

ACTIONS = """months AS (SELECT ticker, date_trunc('month', date)::DATE AS month, min(date) AS date FROM bars GROUP BY 1, 2),
actions AS (
  SELECT ticker, date, 'dividend' AS kind, (day(date) / 10.0::DOUBLE)::DOUBLE AS value FROM months WHERE month(month) % 3 = 0
  UNION ALL SELECT ticker, date, 'split', 2.0::DOUBLE FROM months WHERE month(month) = 3 AND year(month) % 4 = 0)"""

ACTED = """acted AS (
  SELECT b.*, coalesce(a.split, 1.0::DOUBLE) AS split, coalesce(a.dividend, 0.0::DOUBLE) AS dividend, a.split IS NOT NULL OR a.dividend IS NOT NULL AS has_action
  FROM bars b LEFT JOIN (SELECT ticker, date, max(value) FILTER (WHERE kind = 'split') AS split, sum(value) FILTER (WHERE kind = 'dividend') AS dividend FROM actions GROUP BY 1, 2) a
    ON a.ticker = b.ticker AND a.date = b.date)"""

SECOND = """second_source AS (SELECT * REPLACE (CASE WHEN dayofyear(date) % 13 = 0 THEN close * 1.002::DOUBLE ELSE close END AS close) FROM bars WHERE dayofyear(date) % 17 <> 0)"""

VINTAGES = """vint0 AS (
  SELECT c_mktsegment AS series, CAST(o_orderdate AS DATE) AS realtime_start, max(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
vintages AS (
  SELECT series, date_trunc('month', realtime_start)::DATE AS date, realtime_start,
    coalesce(lead(realtime_start) OVER (PARTITION BY series, date_trunc('month', realtime_start) ORDER BY realtime_start) - 1, DATE '9999-12-31') AS realtime_end, value FROM vint0)"""

FACTS = """fact0 AS (
  SELECT o_custkey AS instrument_id, o_orderkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS effective_date,
    (CAST(o_orderdate AS DATE) + (o_orderkey % 5)::INT)::TIMESTAMP + INTERVAL 12 HOUR AS observed_at FROM orders),
facts AS (
  SELECT instrument_id, 'status' AS field, o_orderstatus AS value, effective_date, observed_at, o_orderkey FROM fact0
  UNION ALL SELECT instrument_id, 'priority', o_orderpriority, effective_date, observed_at, o_orderkey FROM fact0)"""

EQUITY = """flow AS (
  SELECT c_mktsegment AS account, CAST(o_orderdate AS DATE) AS session,
    sum(CAST(round(round(o_totalprice, 2) * (CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * 10) AS BIGINT))::BIGINT AS tenths
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
equity AS (SELECT account, session, 50000000.0::DOUBLE + (sum(tenths) OVER (PARTITION BY account ORDER BY session))::DOUBLE / 10.0::DOUBLE AS equity FROM flow)"""

_NEEDS = {
    "bars": ([], BARS),
    "holidays": ([], HOLIDAYS),
    "sessions": (["bars", "holidays"], SESSIONS),
    "panel": (["sessions"], PANEL),
    "returns": (["panel"], RETURNS),
    "actions": (["bars"], ACTIONS),
    "acted": (["actions"], ACTED),
    "second_source": (["bars"], SECOND),
    "vintages": ([], VINTAGES),
    "facts": ([], FACTS),
    "equity": ([], EQUITY),
}


def with_frames(frames: str, body: str) -> str:
    """body after the frames it names and those they need; ``body`` may go on with ", x AS (...)" before its SELECT."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in frames.split():
        need(name)
    head = ",\n".join(_NEEDS[n][1].replace("AS (", "AS MATERIALIZED (", 1) if n in ("bars", "panel") else _NEEDS[n][1] for n in order)
    body = body.strip()
    return "WITH " + head + (body if body.startswith(",") else "\n" + body)
