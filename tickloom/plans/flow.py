"""Queries over bars with flow, positioning and funding."""

from __future__ import annotations

from ..operators import bars as b
from ..operators import flow_signals as s
from ..sources import adapters as a
from . import fragments as f
from .registry import query
from .signals import BURST, D, OUT, POSITION, _clamp, _full, _lag, _leg, _prior

FX = f"""{f.BARS}, {f.METRICS}, {f.FUNDING},
fl AS (SELECT symbol, date_trunc('hour', ts) AS opened_at, sum(CASE WHEN buyer_maker THEN -qty ELSE qty END) AS flow_delta FROM ticks GROUP BY symbol, date_trunc('hour', ts)),
x1 AS (SELECT b.*, flow_delta FROM bars b LEFT JOIN fl USING (symbol, opened_at)),
x2 AS (SELECT x1.*, CASE WHEN closed_at - metric_at <= INTERVAL '1 hour' THEN open_interest END AS open_interest, CASE WHEN closed_at - metric_at <= INTERVAL '1 hour' THEN ratio END AS ratio
  FROM x1 ASOF LEFT JOIN metrics m ON x1.symbol = m.symbol AND x1.closed_at >= m.metric_at),
fx AS (SELECT x2.*, CASE WHEN closed_at - funding_at <= INTERVAL '8 hours' THEN rate END AS rate FROM x2 ASOF LEFT JOIN funding u ON x2.symbol = u.symbol AND x2.closed_at >= u.funding_at)"""


def _fx(columns: str, long: str, short: str, confidence: str) -> str:
    return f"""WITH {FX}, x AS (SELECT *, {columns} FROM fx), y AS (SELECT *, CASE WHEN coalesce({long}, false) THEN 'long' WHEN coalesce({short}, false) THEN 'short' ELSE 'wait' END AS direction FROM x) ---
SELECT symbol, opened_at, direction, CASE WHEN direction = 'wait' THEN 0.0::DOUBLE ELSE coalesce({confidence}, 0) END AS confidence FROM y"""


def featured(spark, sf):
    return s.with_features(a.bars_1h(spark, sf), b.trade_flow(a.ticks(spark, sf), "1 hour"), a.metrics(spark, sf), a.funding(spark, sf))


def _full_of(fn: str, w: int, c: str) -> str:
    frame = f"({f.W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {frame} = {w} THEN {fn}({c}) OVER {frame} END"


_F = "(flow_delta / nullif(volume, 0))"
RULES = {
    "t17_flow_breakout": (s.flow_breakout, f"{_prior('max(high)', 24)} AS ph, {_prior('min(low)', 24)} AS pl", f"close > ph AND {_F} >= 0.1", f"close < pl AND {_F} <= -0.1", _clamp(f"abs({_F})")),
    "t18_flow_exhaustion": (s.flow_exhaustion, "1 AS one", f"{_F} <= -0.5 AND close > open", f"{_F} >= 0.5 AND close < open", _clamp(f"abs({_F})")),
    "t19_interest_impulse": (s.interest_impulse, f"open_interest / nullif({_lag('open_interest', 3)}, 0) - 1 AS oi, close / {_lag('close', 3)} - 1 AS move", "oi >= 0.2 AND move >= 0.2", "oi >= 0.2 AND move <= -0.2", _clamp("oi")),
    "t20_crowding": (s.crowding, f"(ratio - {_full_of('avg', 48, 'ratio')}) / nullif({_full_of('stddev_pop', 48, 'ratio')}, 0) AS z", "z <= -1.5", "z >= 1.5", _clamp("abs(z) / 4")),
    "t21_interest_divergence": (s.interest_divergence, f"open_interest - {_lag('open_interest', 6)} AS oi, close / {_lag('close', 6)} - 1 AS move", "oi < 0 AND move < -0.1", "oi < 0 AND move > 0.1", _clamp("abs(move)")),
    "t22_ratio_shock": (s.ratio_shock, f"(ratio - {_lag('ratio', 1)}) / nullif({_lag('ratio', 1)}, 0) AS jump", "jump <= -0.5", "jump >= 0.5", _clamp("abs(jump)")),
    "t23_funding_reversion": (s.funding_reversion, "1 AS one", "rate <= -0.002 AND close > open", "rate >= 0.002 AND close < open", _clamp("abs(rate) * 100")),
    "t16_two_scales": (s.trend_on_two_scales, f"{_full('avg(close)', 48)} AS slow, {_full('avg(close)', 6)} AS fast, {_lag('close', 1)} AS c1, lag(avg(close) OVER ({f.W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) OVER ({f.W}) AS f1", "", "", "0.6"),
    "t29_donchian_htf": (s.donchian_breakout, f"{_prior('max(high)', 55)} AS ph, {_prior('min(low)', 55)} AS pl", "extract(hour FROM opened_at) % 4 = 0 AND close > ph", "extract(hour FROM opened_at) % 4 = 0 AND close < pl", "0.6"),
    "t3_mean_distance": (s.mean_distance, f"(close - {_prior('avg(close)', 24)}) / nullif({_prior('stddev_pop(close)', 24)}, 0) AS d", "d <= -1.5", "d >= 1.5", _clamp("abs(d) / 4")),
    "t4_snapback": (s.snapback, f"{_lag('close', 1)} / {_lag('close', 5)} - 1 AS move, {_lag('open', 1)} AS o1", "move <= -0.3 AND close > o1", "move >= 0.3 AND close < o1", _clamp("abs(move)")),
    "t10_impulse_pullback": (
        s.impulse_pullback,
        f"{_lag('close', 2)} - {_lag('open', 2)} AS b2, {_lag('close', 1)} - {_lag('open', 1)} AS b1, {_lag('high', 1)} AS h1, {_lag('low', 1)} AS l1",
        "abs(b2) >= 2 * abs(b1) AND b2 > 0 AND b1 < 0 AND close > h1",
        "abs(b2) >= 2 * abs(b1) AND b2 < 0 AND b1 > 0 AND close < l1",
        "0.6",
    ),
    "t24_opening_range": (
        s.opening_range,
        "max(CASE WHEN extract(hour FROM opened_at) < 1 THEN high END) OVER (PARTITION BY symbol, CAST(opened_at AS DATE)) AS rh, min(CASE WHEN extract(hour FROM opened_at) < 1 THEN low END) OVER (PARTITION BY symbol, CAST(opened_at AS DATE)) AS rl",
        "extract(hour FROM opened_at) >= 1 AND close > rh",
        "extract(hour FROM opened_at) >= 1 AND close < rl",
        "0.55",
    ),
}


def _register(name: str, rule, sql: str) -> None:
    query(name, sql, D)(lambda spark, sf: rule(featured(spark, sf)).select(*OUT))


for _name, (_rule, _columns, _long, _short, _confidence) in RULES.items():
    if _name != "t16_two_scales":
        _register(_name, _rule, _fx(_columns, _long, _short, _confidence))

# The previous bar's fast mean needs a second pass in SQL.
_register(
    "t16_two_scales",
    s.trend_on_two_scales,
    f"""WITH {FX}, w0 AS (SELECT *, {_full("avg(close)", 48)} AS slow, {_full("avg(close)", 6)} AS fast FROM fx), x AS (SELECT *, {_lag("close", 1)} AS c1, {_lag("fast", 1)} AS f1 FROM w0),
y AS (SELECT *, CASE WHEN coalesce(close > slow AND c1 < f1 AND close > fast, false) THEN 'long' WHEN coalesce(close < slow AND c1 > f1 AND close < fast, false) THEN 'short' ELSE 'wait' END AS direction FROM x) ---
SELECT symbol, opened_at, direction, CASE WHEN direction = 'wait' THEN 0.0::DOUBLE ELSE 0.6 END AS confidence FROM y""",
)

RANGE24 = (
    f"{_prior('max(high)', 24)} AS ph, {_prior('min(low)', 24)} AS pl",
    f"{POSITION} <= 0.08 AND close > open",
    f"{POSITION} >= 0.92 AND close < open",
    _clamp(f"0.5 + greatest(0.08 - {POSITION}, {POSITION} - 0.92)"),
)


@query(
    "t25_micro_router",
    f"""WITH {f.BARS}, {_leg("br_", BURST)}, {_leg("ed_", RANGE24)}, l AS (SELECT symbol, opened_at, {_full("stddev_pop(close)", 6)} > {_full("stddev_pop(close)", 24)} AS loud FROM bars) ---
SELECT l.symbol, l.opened_at, CASE WHEN loud THEN b.d WHEN NOT loud THEN e.d ELSE 'wait' END AS direction, CASE WHEN loud AND b.d <> 'wait' THEN b.c WHEN NOT loud AND e.d <> 'wait' THEN e.c ELSE 0 END AS confidence
FROM l JOIN br_ b USING (symbol, opened_at) JOIN ed_ e USING (symbol, opened_at)""",
    D,
)
def _(spark, sf):
    return s.micro_router(a.bars_1h(spark, sf))


@query("features_joined", f"WITH {FX} --- SELECT symbol, closed_at, close, flow_delta, open_interest, ratio, rate FROM fx", ["close", "flow_delta", "open_interest", "ratio", "rate"])
def _(spark, sf):
    return featured(spark, sf).select("symbol", "closed_at", "close", "flow_delta", "open_interest", "ratio", "rate")
