"""Signal queries over hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as s
from ..sources import adapters as a
from . import fragments as f
from .registry import query


def _sql(columns: str, long: str, short: str, confidence: str, out: str = "") -> str:
    """columns: window expressions; the conditions use them."""
    return f"""WITH {f.BARS}, x AS (SELECT *, {columns} FROM bars), y AS (SELECT *, CASE WHEN coalesce({long}, false) THEN 'long' WHEN coalesce({short}, false) THEN 'short' ELSE 'wait' END AS direction FROM x) ---
SELECT symbol, opened_at, {out}direction, CASE WHEN direction = 'wait' THEN 0.0::DOUBLE ELSE coalesce({confidence}, 0) END AS confidence FROM y"""


def _prior(fn: str, w: int, skip: int = 0) -> str:
    frame = f"({f.W} ROWS BETWEEN {w + skip} PRECEDING AND {1 + skip} PRECEDING)"
    return f"CASE WHEN count(*) OVER {frame} = {w} THEN {fn} OVER {frame} END"


def _full(fn: str, w: int) -> str:
    frame = f"({f.W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {frame} = {w} THEN {fn} OVER {frame} END"


def _lag(c: str, n: int) -> str:
    return f"lag({c}, {n}) OVER ({f.W})"


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0.1), 1)"


OUT = ["symbol", "opened_at", "direction", "confidence"]
D = ["confidence"]
RANGE48 = f"{_prior('max(high)', 48)} AS ph, {_prior('min(low)', 48)} AS pl"
RANGE24 = f"{_prior('max(high)', 24)} AS ph, {_prior('min(low)', 24)} AS pl"
POSITION = "((close - pl) / nullif(ph - pl, 0))"

MA_SQL = _sql(f"{_full('avg(close)', 20)} AS sma", "close / sma - 1 > 0", "close / sma - 1 < 0", _clamp("abs(close / sma - 1)"), "close, sma, ")
EDGE = (RANGE48, f"{POSITION} <= 0.08 AND close > open", f"{POSITION} >= 0.92 AND close < open", _clamp(f"0.5 + greatest(0.08 - {POSITION}, {POSITION} - 0.92)"))
PULL = (
    f"close / {_lag('close', 24)} - 1 AS trend, {_lag('close', 1)} / {_lag('close', 4)} - 1 AS pull, {_lag('close', 1)} AS c1",
    "trend > 0 AND pull < 0 AND close > c1",
    "trend < 0 AND pull > 0 AND close < c1",
    _clamp("abs(trend)"),
)
BURST = (f"close / {_lag('close', 3)} - 1 AS burst, {_prior('avg(volume)', 20)} AS v", "volume > v AND burst >= 0.2", "volume > v AND burst <= -0.2", _clamp("abs(burst)"))


@query("t1_ma_signal", MA_SQL, ["close", "sma", "confidence"])
def _(spark, sf):
    return s.ma_signal(a.bars_1h(spark, sf)).select("symbol", "opened_at", "close", "sma", "direction", "confidence")


@query("t2_range_edge", _sql(*EDGE), D)
def _(spark, sf):
    return s.range_edge(a.bars_1h(spark, sf)).select(*OUT)


@query(
    "t5_compression_breakout",
    _sql(
        f"{_prior('max(high)', 6)} AS h1, {_prior('min(low)', 6)} AS l1, {_prior('max(high)', 48)} AS h2, {_prior('min(low)', 48)} AS l2, {_prior('avg(volume)', 6)} AS v",
        "h1 - l1 <= 0.7 * (h2 - l2) AND volume >= 1.2 * v AND close > h1",
        "h1 - l1 <= 0.7 * (h2 - l2) AND volume >= 1.2 * v AND close < l1",
        _clamp("greatest(close - h1, l1 - close) / close * 10"),
    ),
    D,
)
def _(spark, sf):
    return s.compression_breakout(a.bars_1h(spark, sf)).select(*OUT)


@query("t7_trend_pullback", _sql(*PULL), D)
def _(spark, sf):
    return s.trend_pullback(a.bars_1h(spark, sf)).select(*OUT)


@query("t8_momentum_burst", _sql(*BURST), D)
def _(spark, sf):
    return s.momentum_burst(a.bars_1h(spark, sf)).select(*OUT)


@query("t26_inverted_burst", _sql(BURST[0], BURST[2], BURST[1], BURST[3]), D)
def _(spark, sf):
    return s.momentum_burst(a.bars_1h(spark, sf), fade=True).select(*OUT)


@query(
    "t11_breakout_retest",
    _sql(
        f"{_prior('max(high)', 24, 3)} AS eh, {_prior('min(low)', 24, 3)} AS el, {_prior('max(close)', 3)} AS mx, {_prior('min(close)', 3)} AS mn",
        "mx > eh AND low <= eh AND close > eh",
        "mn < el AND high >= el AND close < el",
        "0.6",
    ),
    D,
)
def _(spark, sf):
    return s.breakout_retest(a.bars_1h(spark, sf)).select(*OUT)


@query(
    "t12_volatility_expansion",
    _sql(
        f"high - low AS span, {_prior('avg(high - low)', 20)} AS typical",
        "span >= 1.8 * typical AND (close - low) / nullif(span, 0) >= 0.7",
        "span >= 1.8 * typical AND (close - low) / nullif(span, 0) <= 0.3",
        _clamp("span / nullif(typical, 0) / 4"),
    ),
    D,
)
def _(spark, sf):
    return s.volatility_expansion(a.bars_1h(spark, sf)).select(*OUT)


@query("t13_liquidity_sweep", _sql(RANGE24, "low < pl AND close > pl", "high > ph AND close < ph", "0.55"), D)
def _(spark, sf):
    return s.liquidity_sweep(a.bars_1h(spark, sf)).select(*OUT)


@query(
    "t14_dry_up_breakout",
    _sql(
        f"{_prior('max(high)', 20)} AS ph, {_prior('min(low)', 20)} AS pl, {_prior('avg(volume)', 3)} AS calm, {_prior('avg(volume)', 20, 3)} AS usual",
        "calm <= 0.7 * usual AND close > ph",
        "calm <= 0.7 * usual AND close < pl",
        "0.6",
    ),
    D,
)
def _(spark, sf):
    return s.dry_up_breakout(a.bars_1h(spark, sf)).select(*OUT)


@query(
    "t31_exhaustion",
    _sql(f"(close - {_full('avg(close)', 12)}) / nullif({_full('stddev_pop(close)', 12)}, 0) AS z", "z <= -1.3 AND close > open", "z >= 1.3 AND close < open", _clamp("abs(z) / 4")),
    D,
)
def _(spark, sf):
    return s.exhaustion(a.bars_1h(spark, sf)).select(*OUT)


_BODY = f"abs(close - open) AS b0, lag(abs(close - open)) OVER ({f.W}) AS b1, lag(abs(close - open), 2) OVER ({f.W}) AS b2"
_TIRED = "b0 < b1 AND b1 < b2"


@query(
    "t15_three_push",
    _sql(f"{_BODY}, {_lag('high', 1)} AS h1, {_lag('high', 2)} AS h2, {_lag('low', 1)} AS l1, {_lag('low', 2)} AS l2", f"low < l1 AND l1 < l2 AND {_TIRED}", f"high > h1 AND h1 > h2 AND {_TIRED}", "0.5"),
    D,
)
def _(spark, sf):
    return s.three_push(a.bars_1h(spark, sf)).select(*OUT)


def _leg(name: str, parts: tuple) -> str:
    columns, long, short, confidence = parts
    return f"""{name}0 AS (SELECT *, {columns} FROM bars), {name} AS (SELECT symbol, opened_at, CASE WHEN coalesce({long}, false) THEN 'long' WHEN coalesce({short}, false) THEN 'short' ELSE 'wait' END AS d,
  coalesce({confidence}, 0) AS c FROM {name}0)"""


LEGS = ", ".join(_leg(n, x) for n, x in (("pl_", PULL), ("br_", BURST), ("ed_", EDGE)))


@query(
    "t6_router",
    f"""WITH {f.BARS}, {LEGS}, st AS (SELECT symbol, opened_at, abs(close / {_lag("close", 24)} - 1) AS strength FROM bars) ---
SELECT st.symbol, st.opened_at, CASE WHEN p.d <> 'wait' THEN p.d WHEN b.d <> 'wait' THEN b.d WHEN coalesce(strength <= 0.3, false) THEN e.d ELSE 'wait' END AS direction,
  CASE WHEN p.d <> 'wait' THEN p.c WHEN b.d <> 'wait' THEN b.c WHEN coalesce(strength <= 0.3, false) AND e.d <> 'wait' THEN e.c ELSE 0 END AS confidence
FROM st JOIN pl_ p USING (symbol, opened_at) JOIN br_ b USING (symbol, opened_at) JOIN ed_ e USING (symbol, opened_at)""",
    D,
)
def _(spark, sf):
    return s.router(a.bars_1h(spark, sf)).select(*OUT)


@query(
    "t33_vote",
    f"""WITH {f.BARS}, {LEGS}, u AS (SELECT * FROM pl_ UNION ALL SELECT * FROM br_ UNION ALL SELECT * FROM ed_),
g AS (SELECT symbol, opened_at, sum(CASE WHEN d = 'long' THEN c ELSE 0 END) AS long_sum, sum(CASE WHEN d = 'short' THEN c ELSE 0 END) AS short_sum, avg(CASE WHEN d = 'long' THEN c END) AS lm, avg(CASE WHEN d = 'short' THEN c END) AS sm FROM u GROUP BY symbol, opened_at) ---
SELECT symbol, opened_at, long_sum, short_sum, CASE WHEN round(long_sum - short_sum, 9) > 0 THEN 'long' WHEN round(long_sum - short_sum, 9) < 0 THEN 'short' ELSE 'wait' END AS direction,
  CASE WHEN round(long_sum - short_sum, 9) > 0 THEN lm WHEN round(long_sum - short_sum, 9) < 0 THEN sm ELSE 0 END AS confidence FROM g""",
    ["long_sum", "short_sum", "confidence"],
)
def _(spark, sf):
    bars = a.bars_1h(spark, sf)
    parts = [rows.select(*OUT) for rows in (s.trend_pullback(bars), s.momentum_burst(bars), s.range_edge(bars))]
    return s.vote(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["symbol", "opened_at"])


@query(
    "b2_first_touch",
    f"""WITH {f.NUMBERED}, {_leg("br_", BURST)}, e AS (SELECT r.symbol, r.opened_at, b.d AS direction, r.close AS entry, r.rn AS rn0 FROM r JOIN br_ b USING (symbol, opened_at) WHERE b.d <> 'wait'),
t AS (SELECT *, CASE direction WHEN 'long' THEN entry * (1 - 0.1::DOUBLE) ELSE entry * (1 + 0.1::DOUBLE) END AS sl, CASE direction WHEN 'long' THEN entry * (1 + 0.2::DOUBLE) ELSE entry * (1 - 0.2::DOUBLE) END AS tp FROM e),
j AS (SELECT t.*, r.rn, r.close, CASE direction WHEN 'long' THEN low <= sl ELSE high >= sl END AS stopped, CASE direction WHEN 'long' THEN high >= tp ELSE low <= tp END AS reached FROM t JOIN r ON r.symbol = t.symbol AND r.rn BETWEEN t.rn0 + 1 AND t.rn0 + 12),
k AS (SELECT *, CASE WHEN stopped THEN sl WHEN reached THEN tp ELSE close END AS price, CASE WHEN stopped THEN 'stop' WHEN reached THEN 'target' ELSE 'end' END AS reason FROM j),
q AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY symbol, opened_at ORDER BY reason = 'end', CASE WHEN reason = 'end' THEN -rn ELSE rn END) = 1) ---
SELECT symbol, opened_at, direction, reason, rn - rn0 AS held, CASE direction WHEN 'long' THEN 1 ELSE -1 END * (price / entry - 1) AS ret FROM q""",
    ["ret"],
)
def _(spark, sf):
    bars = a.bars_1h(spark, sf)
    entries = s.momentum_burst(bars).where("direction <> 'wait'").select("symbol", "opened_at", "direction", "close")
    return s.first_touch(bars, entries, 0.1, 0.2, 12)


RULES = [("burst_up", "ret3", ">=", 0.2), ("burst_down", "ret3", "<=", -0.2), ("rich", "position", ">=", 0.9), ("cheap", "position", "<=", 0.1)]


@query(
    "a18_rule_screen",
    f"""WITH {f.BARS}, x AS (SELECT *, close / {_lag("close", 3)} - 1 AS ret3, {RANGE48} FROM bars), y AS (SELECT *, (close - pl) / nullif(ph - pl, 0) AS position FROM x),
z AS (SELECT y.*, h.h, CASE WHEN strftime(n.opened_at, '%Y-%m') = strftime(y.opened_at, '%Y-%m') THEN n.close / y.close - 1 - 0.0008 END AS fwd FROM y CROSS JOIN (VALUES (1), (4)) h(h) LEFT JOIN bars n ON n.symbol = y.symbol AND n.opened_at = y.opened_at + h.h * INTERVAL '1 hour'),
q AS (SELECT 'burst_up' AS rule, * FROM z WHERE ret3 >= 0.2 UNION ALL SELECT 'burst_down', * FROM z WHERE ret3 <= -0.2 UNION ALL SELECT 'rich', * FROM z WHERE position >= 0.9 UNION ALL SELECT 'cheap', * FROM z WHERE position <= 0.1) ---
SELECT rule, CAST(h AS INTEGER) AS horizon, strftime(opened_at, '%Y-%m') AS month, count(*) AS signals, avg(CAST(fwd > 0 AS INTEGER)) AS win_rate, avg(fwd) AS average, sum(fwd) AS total FROM q WHERE fwd IS NOT NULL GROUP BY rule, h, strftime(opened_at, '%Y-%m')""",
    ["win_rate", "average", "total"],
)
def _(spark, sf):
    from ..operators import asof
    from ..operators.windows import shift

    bars = a.bars_1h(spark, sf)
    rows = s.range_position(bars, 48).withColumn("ret3", F.col("close") / shift("close", 3) - 1)
    price = bars.select("symbol", "opened_at", "close")
    rows = rows.select("symbol", "opened_at", "close", "ret3", "position")
    for h in (1, 4):
        rows = asof.at_offset(rows, price, ["symbol"], "opened_at", h * 3600, {"close": f"c{h}"}, same_month=True)
    rows = rows.select("*", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), (F.col(f"c{h}") / F.col("close") - 1 - 0.0008).alias("fwd")) for h in (1, 4)))).alias("x"))
    passed = F.array_compact(F.array(*(F.when(F.expr(f"{c} {op} {v}"), name) for name, c, op, v in RULES)))
    rows = rows.where("x.fwd is not null").select("opened_at", "x.*", F.explode(passed).alias("rule"))
    return rows.groupBy("rule", "horizon", F.date_format("opened_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("signals"), F.avg((F.col("fwd") > 0).cast("double")).alias("win_rate"), F.avg("fwd").alias("average"), F.sum("fwd").alias("total"))
