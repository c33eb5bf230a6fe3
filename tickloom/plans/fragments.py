"""SQL of the adapters, shared by the queries' SQL."""

from __future__ import annotations

TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, event_id AS trade_id, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS qty, event_type IN ('error', 'view') AS buyer_maker
  FROM events WHERE value > 0)"""


def bars(every: str, name: str = "bars", ticks: str = "ticks") -> str:
    return f"""{name} AS (
  SELECT symbol, time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') AS opened_at,
         time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{every}' AS closed_at,
         arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close,
         sum(qty) AS volume, count(*) AS trades
  FROM {ticks} GROUP BY ALL)"""


BARS = f"{TICKS},\n{bars('1 hour')}"
NUMBERED = f"{BARS},\nr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY opened_at) AS rn FROM bars)"
W = "PARTITION BY symbol ORDER BY opened_at"

DENSE = f"""{TICKS}, alls AS (SELECT 'ALL' AS symbol, ts, trade_id, price, qty FROM ticks),
{bars("15 minutes", "b15", "alls")},
spine AS (SELECT symbol, unnest(generate_series(min(opened_at), max(opened_at), INTERVAL '15 minutes')) AS opened_at FROM b15 GROUP BY symbol),
j AS (SELECT s.symbol, s.opened_at, b.open, b.high, b.low, b.close, b.volume FROM spine s LEFT JOIN b15 b USING (symbol, opened_at)),
k AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY opened_at) AS carried FROM j),
dense AS (SELECT symbol, opened_at, coalesce(open, carried) AS open, coalesce(high, carried) AS high, coalesce(low, carried) AS low,
                 coalesce(close, carried) AS close, coalesce(volume, 0.0) AS volume FROM k)"""

FUNDING = """funding AS (
  SELECT symbol, min(ts) AS funding_at, (arg_min(price, (ts, trade_id)) - 50) / 10000 AS rate
  FROM ticks GROUP BY symbol, time_bucket(INTERVAL '8 hours', ts, TIMESTAMP '1970-01-01'))"""

METRICS = """metrics AS (
  SELECT symbol, time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01') + INTERVAL '5 minutes' AS metric_at,
         sum(qty) AS open_interest, avg(price) AS ratio
  FROM ticks GROUP BY ALL)"""

LEDGER = """ledger AS (
  SELECT l_suppkey % 10 AS candidate_id, l_orderkey * 10 + l_linenumber AS trade_id, l_orderkey AS order_id, o_orderdate AS entry_ts,
         l_shipdate AS exit_ts, l_extendedprice AS notional, l_extendedprice * 0.0004 AS fee,
         (l_discount - 0.05) * l_extendedprice AS pnl, l_discount - 0.05 AS ret, l_discount * 10 AS confidence, l_quantity AS qty,
         o_orderstatus AS status, l_linestatus AS side, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

VECTORS = """vectors AS (
  SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def ema(column: str, alpha: float | str, least: int, name: str, source: str = "r") -> str:
    """A recursive mean over the row numbers of ``source``, as a CTE (symbol, rn, value)."""
    return f"""{name} AS (
  SELECT symbol, rn, {column} AS v FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.rn, e.v + ({alpha}) * (s.{column} - e.v) FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"""
