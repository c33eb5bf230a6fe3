"""Queries of the trend rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import htf, indicators
from ..operators import trend as t
from ..sources import adapters as a
from . import fragments as f
from .market import _STEPS
from .registry import query
from .signals import OUT, D, _full, _lag, _prior, _sql


def _warm(bars: int) -> str:
    return f"{_lag('opened_at', bars - 1)} IS NOT NULL AS warm"


@query(
    "t30_pullback_resume",
    _sql(
        f"close / {_lag('close', 48)} - 1 AS gain, close / {_lag('close', 3)} - 1 AS move, {_prior('max(high)', 24)} AS ph, {_prior('min(low)', 24)} AS pl, {_warm(50)}",
        "warm AND gain >= 0.018 AND (ph - close) / close >= 0.004 AND move >= 0.0008", "warm AND gain <= -0.018 AND (close - pl) / close >= 0.004 AND move <= -0.0008", "0.88",
    ),
    D,
)
def _(spark, sf):
    return t.pullback_resume(a.bars_1h(spark, sf), 48, 24, 3).select(*OUT)


@query(
    "t29_timed_acceleration",
    _sql(
        f"close / {_lag('close', 24)} - 1 AS gain, close / {_lag('close', 4)} - 1 AS move, {_warm(26)}",
        "warm AND extract(hour FROM opened_at) = 6 AND gain >= 0.01 AND move >= 0.002", "warm AND extract(hour FROM opened_at) = 6 AND gain <= -0.01 AND move <= -0.002", "0.99",
    ),
    D,
)
def _(spark, sf):
    return t.timed_acceleration(a.bars_1h(spark, sf), 24, 4, hour=6).select(*OUT)


_RANGE = f"{_prior('max(high)', 24)} AS ph, {_prior('min(low)', 24)} AS pl"


@query("t31_breakout_momentum", _sql(f"{_RANGE}, close / {_lag('close', 4)} - 1 AS move", "close > ph * 1.001 AND move >= 0.001", "close < pl * 0.999 AND move <= -0.001", "0.8"), D)
def _(spark, sf):
    return t.breakout_momentum(a.bars_1h(spark, sf), 24, 0.001, 4, 0.001).select(*OUT)


@query(
    "t31_selective_breakout",
    _sql(f"{_RANGE}, close / {_lag('close', 48)} - 1 AS gain, coalesce(opened_at > {_lag('opened_at', 12)}, true) AS cool", "cool AND gain >= 0.01 AND close > ph * 1.002", "cool AND gain <= -0.01 AND close < pl * 0.998", "1.0"),
    D,
)
def _(spark, sf):
    return t.selective_breakout(a.bars_1h(spark, sf), 24, 0.002, 48, 0.01, 12).select(*OUT)


@query(
    "t31_swing_retest",
    _sql(
        f"{_RANGE}, close / {_lag('close', 48)} - 1 AS gain, {_lag('close', 1)} AS c1, {_warm(50)}",
        "warm AND gain >= 0.03 AND ph > 0 AND (ph - c1) / ph >= 0.01 AND close >= c1 * 1.003", "warm AND gain <= -0.03 AND c1 > 0 AND (c1 - pl) / c1 >= 0.01 AND close <= c1 * 0.997", "1.0",
    ),
    D,
)
def _(spark, sf):
    return t.swing_retest(a.bars_1h(spark, sf), 48, 24).select(*OUT)


@query(
    "t31_exhaustion_reversal",
    _sql(
        f"close / {_lag('close', 24)} - 1 AS gain, close / {_lag('close', 3)} - 1 AS back, {_full('max(high)', 48)} AS rh, {_full('min(low)', 48)} AS rl, {_warm(49)}",
        "warm AND gain <= -0.02 AND back >= 0.002 AND (close - rl) / nullif(rh - rl, 0) <= 0.35", "warm AND gain >= 0.02 AND back <= -0.002 AND (close - rl) / nullif(rh - rl, 0) >= 0.65", "1.0",
    ),
    D,
)
def _(spark, sf):
    return t.exhaustion_reversal(a.bars_1h(spark, sf), 24, 0.02, 3, 0.002, 48).select(*OUT)


def _since(n: int) -> str:
    return f"close / {_lag('close', n)} - 1"


def _gate(hours: int, longest: int) -> str:
    return f"(extract(hour FROM opened_at) % {hours} = 0 AND {_lag('opened_at', longest + 1)} IS NOT NULL) AS warm"


def _span(n: int, name: str) -> str:
    return f"{_prior('max(high)', n)} AS {name}_high, {_prior('min(low)', n)} AS {name}_low"


@query(
    "t29_htf_donchian",
    _sql(
        f"{_since(72)} AS gain, {_since(12)} AS confirm, {_span(24, 'r')}, {_gate(2, 72)}",
        "warm AND gain >= 0.02 AND confirm >= 0.005 AND close > r_high * 1.001", "warm AND gain <= -0.02 AND confirm <= -0.005 AND close < r_low * 0.999", "1.0",
    ),
    D,
)
def _(spark, sf):
    return htf.donchian(a.bars_1h(spark, sf), 72, 12, 24, 0.02, 0.005, 0.001, 120).select(*OUT)


@query(
    "t29_htf_pullback",
    _sql(
        f"{_since(72)} AS gain, {_since(24)} AS confirm, {_span(36, 'r')}, {_span(5, 's')}, {_lag('close', 1)} AS c1, {_gate(2, 72)}",
        "warm AND gain >= 0.02 AND confirm >= 0.005 AND (r_high - c1) / r_high >= 0.012 AND close > s_high * 1.001", "warm AND gain <= -0.02 AND confirm <= -0.005 AND (c1 - r_low) / c1 >= 0.012 AND close < s_low * 0.999", "1.0",
    ),
    D,
)
def _(spark, sf):
    return htf.pullback(a.bars_1h(spark, sf), 72, 24, 36, 5, 0.02, 0.005, 0.012, 0.001, 120).select(*OUT)


@query(
    "t29_htf_acceleration",
    _sql(
        f"{_since(96)} AS gain, {_since(12)} AS fast, {_since(36)} AS slow, {_span(36, 'r')}, {_gate(2, 96)}",
        "warm AND gain >= 0.02 AND fast >= 0.005 AND slow >= 0.01 AND (close - r_low) / r_low <= 5", "warm AND gain <= -0.02 AND fast <= -0.005 AND slow <= -0.01 AND (r_high - close) / r_high <= 5", "1.0",
    ),
    D,
)
def _(spark, sf):
    return htf.acceleration(a.bars_1h(spark, sf), 96, 12, 36, 0.02, 0.005, 0.01, 5, 120).select(*OUT)


def _least(name: str, n: int, column: str) -> str:
    return f"CASE WHEN r.rn >= {n} THEN {name}.v END AS {column}"


REGIME = (
    f"WITH RECURSIVE {_STEPS}, "
    + ", ".join(f.ema(c, al, 1, n) for n, c, al in (("ef", "close", "2.0/13"), ("es", "close", "2.0/27"), ("g", "gain", "1.0/14"), ("l", "loss", "1.0/14"), ("t", "tr", "1.0/14"), ("p", "pdm", "1.0/14"), ("m", "mdm", "1.0/14")))
    + f""", d AS (SELECT r.*, {_least("ef", 12, "ema_fast")}, {_least("es", 26, "ema_slow")}, {_least("t", 14, "atr")}, CASE WHEN r.rn >= 14 AND l.v > 0 THEN 100 - 100 / (1 + g.v / l.v) ELSE 0 END AS rsi,
  CASE WHEN r.rn >= 14 THEN p.v * 100 / nullif(t.v, 0) END AS pdi, CASE WHEN r.rn >= 14 THEN m.v * 100 / nullif(t.v, 0) END AS mdi
  FROM r JOIN ef USING (symbol, rn) JOIN es USING (symbol, rn) JOIN g USING (symbol, rn) JOIN l USING (symbol, rn) JOIN t USING (symbol, rn) JOIN p USING (symbol, rn) JOIN m USING (symbol, rn)),
dx AS (SELECT *, abs(pdi - mdi) * 100 / nullif(pdi + mdi, 0) AS dx FROM d),
y AS (SELECT symbol, dx, opened_at, row_number() OVER (PARTITION BY symbol ORDER BY opened_at) AS rn FROM dx WHERE dx IS NOT NULL), {f.ema("dx", "1.0/14", 14, "z", "y")},
ax AS (SELECT y.symbol, y.opened_at, CASE WHEN y.rn >= 14 THEN z.v END AS v FROM y JOIN z USING (symbol, rn)),
bb AS (SELECT dx.*, coalesce(ax.v, 0) AS adx, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS dev
  FROM dx LEFT JOIN ax USING (symbol, opened_at) WINDOW w AS (PARTITION BY symbol ORDER BY opened_at ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ri AS (SELECT *, mid + 2 * dev AS upper, mid - 2 * dev AS lower, atr / nullif(close, 0) AS ratio FROM bb)"""
)


@query(
    "t32_regime_entry",
    f"""{REGIME}, e AS (SELECT *, ema_slow IS NOT NULL AND mid IS NOT NULL AND close > 0 AND volume > 0 AND ratio > 0.004 AS wide FROM ri),
sg AS (SELECT *, CASE WHEN coalesce(wide AND ema_fast < ema_slow AND adx > 5 AND close > upper AND rsi > 52, false) THEN 'short' WHEN coalesce(wide AND ema_fast > ema_slow AND adx > 5 AND close < lower AND rsi < 48, false) THEN 'long' ELSE 'wait' END AS direction FROM e) ---
SELECT symbol, opened_at, direction, CASE WHEN direction = 'wait' THEN 0.0::DOUBLE ELSE least(0.55 + 0.25 * least(greatest((adx - 20) / 20, 0), 1) + 0.2 * least(greatest((ratio - 0.004) / 0.008, 0), 1), 0.98) END AS confidence FROM sg""",
    D,
)
def _(spark, sf):
    return t.regime_entry(indicators.together(a.bars_1h(spark, sf)), {"short_adx": 5.0, "long_adx": 5.0, "short_rsi": 52.0, "long_rsi": 48.0}).select(*OUT)


@query(
    "t32_regime_exit",
    f"""{REGIME}, e AS (SELECT *, ema_slow IS NOT NULL AND close IS NOT NULL AS known FROM ri),
sg AS (SELECT *, CASE WHEN known AND (close < ema_slow OR rsi < 45) THEN 'long' WHEN known AND (close > ema_slow OR rsi > 55) THEN 'short' ELSE 'keep' END AS leave FROM e) ---
SELECT symbol, opened_at, leave, CASE WHEN NOT known THEN 'missing_required_fields' WHEN leave = 'long' THEN 'exit_long_signal' WHEN leave = 'short' THEN 'exit_short_signal' ELSE 'keep_position' END AS reason, CASE WHEN leave = 'keep' THEN 0.0::DOUBLE ELSE 0.7 END AS confidence FROM sg""",
    D,
)
def _(spark, sf):
    rows = indicators.together(a.bars_1h(spark, sf)).withColumn("c_close", F.col("close"))
    return t.regime_exit(rows).select("symbol", "opened_at", "leave", "reason", "confidence")
