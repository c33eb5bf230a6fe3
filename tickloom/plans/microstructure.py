"""Queries of the rules on flow, positioning, premium and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import microstructure as m
from ..operators.asof import asof_join
from ..operators.windows import shift
from ..sources import adapters as a
from . import fragments as f
from .registry import query
from .signals import OUT, D, _lag, _prior


def features_sql(every: str) -> str:
    return f"""{f.TICKS}, {f.FUNDING}, g AS (SELECT symbol, time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') AS opened_at, time_bucket(INTERVAL '{every}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{every}' AS closed_at,
  arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close, sum(qty) AS volume, avg(price) AS mean_price, count(*) AS trade_intensity,
  coalesce(sum(qty) FILTER (trade_id % 2 = 0), 0) AS bought, coalesce(sum(qty) FILTER (trade_id % 2 = 1), 0) AS sold, count(*) FILTER (trade_id % 2 = 0) AS buys, count(*) FILTER (trade_id % 2 = 1) AS sells,
  max(qty) FILTER (trade_id % 2 = 0) AS top_buy, max(qty) FILTER (trade_id % 2 = 1) AS top_sell FROM ticks GROUP BY ALL),
h AS (SELECT *, bought - sold AS cvd_delta, (bought - sold) / nullif(volume, 0) AS taker_imbalance, bought / nullif(sold, 0) AS taker_ratio, buys / nullif(sells, 0) AS global_ratio, top_buy / nullif(top_sell, 0) AS top_ratio, close / nullif(mean_price, 0) - 1 AS premium, close / nullif(open, 0) - 1 AS basis,
  CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END AS lower, CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END AS upper FROM g),
k AS (SELECT *, global_ratio - {_lag("global_ratio", 1)} AS global_change, volume / nullif({_lag("volume", 1)}, 0) - 1 AS interest_change, close / {_lag("close", 5)} - 1 AS move5, {_prior("max(high)", 20)} AS ph, {_prior("min(low)", 20)} AS pl FROM h),
fx AS (SELECT k.*, CASE WHEN closed_at - funding_at <= INTERVAL '8 hours' THEN rate END AS rate FROM k ASOF LEFT JOIN funding u ON k.symbol = u.symbol AND k.closed_at >= u.funding_at)"""


def features(spark, sf, every: str = "1 hour"):
    ticks = a.ticks(spark, sf).withColumn("buy", F.col("trade_id") % 2 == 0)
    rows = m.flow_features(ticks, every)
    return asof_join(rows, a.funding(spark, sf), ["symbol"], "closed_at", "funding_at", 8 * 3600).drop("funding_at")


def _sql(long: str, short: str, confidence: str, ctes: str = "", source: str = "fx", every: str = "1 hour") -> str:
    return f"""WITH {features_sql(every)}{ctes}, y AS (SELECT *, CASE WHEN coalesce({long}, false) THEN 'long' WHEN coalesce({short}, false) THEN 'short' ELSE 'wait' END AS direction FROM {source}) ---
SELECT symbol, opened_at, direction, CASE WHEN direction = 'wait' THEN 0.0::DOUBLE ELSE {confidence} END AS confidence FROM y"""


_UP, _DOWN = "taker_imbalance >= 0.15 AND cvd_delta >= 0", "taker_imbalance <= -0.15 AND cvd_delta <= 0"
RULES = {
    "t17_flow_confirmed_breakout": (
        lambda rows: m.flow_confirmed_breakout(rows, intensity=3),
        "close > ph AND taker_imbalance >= 0.2 AND cvd_delta >= 0 AND trade_intensity >= 3", "close < pl AND taker_imbalance <= -0.2 AND cvd_delta <= 0 AND trade_intensity >= 3", "0.7",
    ),
    "t18_flow_exhaustion_reversal": (m.flow_exhaustion_reversal, f"low < pl AND close > open AND lower >= 0.35 AND {_UP}", f"high > ph AND close < open AND upper >= 0.35 AND {_DOWN}", "0.68"),
    "t19_open_interest_impulse": (m.interest_impulse, "move5 >= 0.002 AND interest_change >= 0.002 AND taker_ratio >= 1.1", "move5 <= -0.002 AND interest_change >= 0.002 AND taker_ratio <= 0.9", "0.72"),
    "t20_positioning_crowding": (
        lambda rows: m.positioning_crowding(rows.withColumn("top_ratio", shift("top_ratio", 1)).withColumn("global_ratio", shift("global_ratio", 1))),  # positions before the bar
        "top_ratio <= 0.85 AND global_ratio <= 0.85 AND taker_ratio >= 1.1 AND close > open AND lower >= 0.35", "top_ratio >= 1.25 AND global_ratio >= 1.25 AND taker_ratio <= 0.9 AND close < open AND upper >= 0.35", "0.72",
        f", x AS (SELECT * REPLACE ({_lag('top_ratio', 1)} AS top_ratio, {_lag('global_ratio', 1)} AS global_ratio) FROM fx)", "x",
    ),
    "t21_open_interest_divergence": (m.interest_divergence, "move5 <= -0.002 AND interest_change <= -0.002 AND taker_ratio >= 1.1", "move5 >= 0.002 AND interest_change <= -0.002 AND taker_ratio <= 0.9", "0.7"),
    "t22_global_ratio_shock": (m.global_ratio_shock, "global_change <= -0.05", "global_change >= 0.05", "0.74"),
    "t23_premium_funding": (
        m.premium_funding,
        f"far < 0 AND close > open AND lower >= 0.25 AND {_UP}", f"far > 0 AND close < open AND upper >= 0.25 AND {_DOWN}", "0.7 + CASE WHEN coalesce(abs(rate) >= 0.0001 AND rate * far > 0, false) THEN 0.05 ELSE 0 END",
        ", x AS (SELECT *, CASE WHEN abs(premium) >= 0.0008 THEN premium WHEN abs(basis) >= 0.0008 THEN basis END AS far FROM fx)", "x",
    ),
}


#: Rules that need more trades a bar than an hour has here.
EVERY = {"t20_positioning_crowding": "4 hours", "t23_premium_funding": "4 hours"}


def _register(name: str, rule, *sql: str) -> None:
    every = EVERY.get(name, "1 hour")
    query(name, _sql(*sql, every=every), D)(lambda spark, sf: rule(features(spark, sf, every)).select(*OUT))


for _name, (_rule, *_parts) in RULES.items():
    _register(_name, _rule, *_parts)

_OPENING = """, s0 AS (SELECT *, extract(hour FROM opened_at) * 60 + extract(minute FROM opened_at) AS mi FROM fx),
s1 AS (SELECT *, date_trunc('day', opened_at) + INTERVAL '1 minute' * CASE WHEN mi >= 810 THEN 810 WHEN mi >= 420 THEN 420 ELSE 0 END AS session_at FROM s0),
op AS (SELECT symbol, session_at, max(high) AS rh, min(low) AS rl FROM s1 WHERE opened_at < session_at + INTERVAL '30 minutes' GROUP BY ALL HAVING count(*) = 2),
cl AS (SELECT symbol, time_bucket(INTERVAL '30 minutes', opened_at, TIMESTAMP '1970-01-01') + INTERVAL '30 minutes' AS ended, arg_max(close, opened_at) AS c1 FROM s1 GROUP BY ALL HAVING count(*) = 2),
x AS (SELECT s1.*, op.rh, op.rl, s1.close / c1 - 1 AS move FROM s1 LEFT JOIN op ON op.symbol = s1.symbol AND op.session_at = s1.session_at LEFT JOIN cl ON cl.symbol = s1.symbol AND cl.ended = time_bucket(INTERVAL '30 minutes', s1.opened_at, TIMESTAMP '1970-01-01'))"""
_LATER = "opened_at >= session_at + INTERVAL '30 minutes'"


@query(
    "t24_session_opening_range",
    _sql(f"{_LATER} AND close > rh AND move >= 0.0005 AND {_UP} AND trade_intensity >= 1", f"{_LATER} AND close < rl AND move <= -0.0005 AND {_DOWN} AND trade_intensity >= 1", "0.69", _OPENING, "x", "15 minutes"),
    D,
)
def _(spark, sf):
    return m.session_opening_range(features(spark, sf, "15 minutes"), 30, 15, 30, intensity=1).select(*OUT)
