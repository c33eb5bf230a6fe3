"""Bars, indicators and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, bars, indicators, windows
from ..sources import adapters as a
from . import fragments as f
from .registry import query

OHLC = ["open", "high", "low", "close"]


@query("a1_bars_1h", f"WITH {f.BARS} --- SELECT * FROM bars", [*OHLC, "volume"])
def _(spark, sf):
    return a.bars_1h(spark, sf)


@query(
    "a2_closed_bars_4h",
    f"""WITH {f.BARS}, c AS (
  SELECT symbol, time_bucket(INTERVAL '4 hours', opened_at, TIMESTAMP '1970-01-01') AS opened_at,
         arg_min(open, opened_at) AS open, max(high) AS high, min(low) AS low, arg_max(close, opened_at) AS close, sum(volume) AS volume, count(*) AS bars
  FROM bars GROUP BY symbol, time_bucket(INTERVAL '4 hours', opened_at, TIMESTAMP '1970-01-01')) ---
SELECT symbol, opened_at, opened_at + INTERVAL '4 hours' AS closed_at, open, high, low, close, volume, bars
FROM c WHERE bars = 4 AND opened_at + INTERVAL '4 hours' <= TIMESTAMP '2024-01-29 10:00:00'
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY opened_at DESC) <= 100""",
    [*OHLC, "volume"],
)
def _(spark, sf):
    return bars.coarser(a.bars_1h(spark, sf), "4 hours", need=4, as_of="2024-01-29 10:00:00", last=100)


@query(
    "a1_incomplete_buckets",
    f"""WITH {f.BARS} --- SELECT symbol, time_bucket(INTERVAL '4 hours', opened_at, TIMESTAMP '1970-01-01') AS opened_at, count(*) AS bars
FROM bars GROUP BY ALL HAVING count(*) <> 4""".replace("GROUP BY ALL HAVING", "GROUP BY symbol, time_bucket(INTERVAL '4 hours', opened_at, TIMESTAMP '1970-01-01') HAVING"),
)
def _(spark, sf):
    return bars.incomplete(a.bars_1h(spark, sf), "4 hours", 4)


@query("a1_dense_15m", f"WITH {f.DENSE} --- SELECT symbol, opened_at, opened_at + INTERVAL '15 minutes' AS closed_at, open, high, low, close, volume FROM dense", [*OHLC, "volume"])
def _(spark, sf):
    return a.bars_15m(spark, sf)


@query(
    "a3_trade_flow_1h",
    f"""WITH {f.TICKS}, g AS (
  SELECT symbol, date_trunc('hour', ts) AS opened_at,
         sum(CASE WHEN NOT buyer_maker THEN qty ELSE 0 END) AS buy_base, sum(CASE WHEN buyer_maker THEN qty ELSE 0 END) AS sell_base,
         sum(CASE WHEN NOT buyer_maker THEN price * qty ELSE 0 END) AS buy_quote, sum(CASE WHEN buyer_maker THEN price * qty ELSE 0 END) AS sell_quote,
         count(*) AS trades, max(trade_id) - min(trade_id) + 1 AS id_span
  FROM ticks GROUP BY ALL) ---
SELECT *, buy_base - sell_base AS flow_delta, (buy_quote + sell_quote) / (buy_base + sell_base) AS vwap FROM g""",
    ["buy_base", "sell_base", "buy_quote", "sell_quote", "flow_delta", "vwap"],
)
def _(spark, sf):
    return bars.trade_flow(a.ticks(spark, sf), "1 hour")


@query(
    "s14_contiguity",
    f"""WITH {f.BARS}, l AS (SELECT symbol, epoch(opened_at) - epoch(lag(opened_at) OVER ({f.W})) AS step FROM bars) ---
SELECT symbol, count(*) AS bars, count(*) FILTER (step > 3600) AS gaps, count(*) FILTER (step = 0) AS repeats,
       CAST(coalesce(sum(CASE WHEN step > 3600 THEN step / 3600 - 1 END), 0) AS BIGINT) AS missing
FROM l GROUP BY symbol""",
)
def _(spark, sf):
    return bars.gaps(a.bars_1h(spark, sf), 3600)


@query(
    "s6_kline_enrich",
    f"""WITH {f.TICKS}, g AS (
  SELECT symbol, date_trunc('hour', ts) + INTERVAL '1 hour' AS bucket_end, sum(qty) AS volume, sum(CASE WHEN NOT buyer_maker THEN qty ELSE 0 END) AS taker_buy
  FROM ticks GROUP BY symbol, date_trunc('hour', ts)) ---
SELECT symbol, bucket_end, volume, taker_buy, volume - taker_buy AS taker_sell,
       CASE WHEN volume <> 0 THEN (taker_buy - (volume - taker_buy)) / volume ELSE 0 END AS taker_imbalance
FROM g WHERE taker_buy <= volume""",
    ["volume", "taker_buy", "taker_sell", "taker_imbalance"],
)
def _(spark, sf):
    flow = bars.trade_flow(a.ticks(spark, sf), "1 hour")
    rows = flow.select("symbol", (F.col("opened_at") + F.expr("interval 1 hour")).alias("bucket_end"), (F.col("buy_base") + F.col("sell_base")).alias("volume"), F.col("buy_base").alias("taker_buy"))
    rows = rows.where("taker_buy <= volume").withColumn("taker_sell", F.col("volume") - F.col("taker_buy"))
    return rows.withColumn("taker_imbalance", F.when(F.col("volume") != 0, (F.col("taker_buy") - F.col("taker_sell")) / F.col("volume")).otherwise(0.0))


@query(
    "w1_sma_bollinger",
    f"""WITH {f.BARS}, m AS (SELECT symbol, opened_at, close,
  CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, CASE WHEN count(*) OVER w = 20 THEN stddev_pop(close) OVER w END AS dev
  FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) ---
SELECT symbol, opened_at, close, mid, mid + 2 * dev AS upper, mid - 2 * dev AS lower, (4 * dev) / mid AS width FROM m""",
    ["close", "mid", "upper", "lower", "width"],
)
def _(spark, sf):
    return indicators.bollinger(a.bars_1h(spark, sf)).select("symbol", "opened_at", "close", "mid", "upper", "lower", "width")


@query(
    "w2_donchian_stoch",
    f"""WITH {f.BARS}, m AS (SELECT symbol, opened_at, close,
  CASE WHEN count(*) OVER v = 20 THEN max(high) OVER v END AS top, CASE WHEN count(*) OVER v = 20 THEN min(low) OVER v END AS bottom,
  CASE WHEN count(*) OVER w = 14 THEN max(high) OVER w END AS hi, CASE WHEN count(*) OVER w = 14 THEN min(low) OVER w END AS lo
  FROM bars WINDOW v AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS ({f.W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
q AS (SELECT *, CASE WHEN hi <> lo THEN (close - lo) * 100 / (hi - lo) END AS rk FROM m) ---
SELECT symbol, opened_at, top, bottom, coalesce(rk, 0) AS k, coalesce(CASE WHEN count(rk) OVER x = 3 THEN avg(rk) OVER x END, 0) AS d
FROM q WINDOW x AS ({f.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    ["top", "bottom", "k", "d"],
)
def _(spark, sf):
    return indicators.stochastic(indicators.donchian(a.bars_1h(spark, sf))).select("symbol", "opened_at", "top", "bottom", "k", "d")


@query(
    "w3_prior_range",
    f"""WITH {f.BARS} --- SELECT symbol, opened_at, coalesce(max(high) OVER p, high) AS prior_high, coalesce(min(low) OVER p, low) AS prior_low,
  coalesce(avg(volume) OVER p, volume) AS prior_volume FROM bars WINDOW p AS ({f.W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    ["prior_high", "prior_low", "prior_volume"],
)
def _(spark, sf):
    p = lambda fn, c: windows.prior(fn, 20, F.col(c))
    return a.bars_1h(spark, sf).select("symbol", "opened_at", p(F.max("high"), "high").alias("prior_high"), p(F.min("low"), "low").alias("prior_low"), p(F.avg("volume"), "volume").alias("prior_volume"))


@query(
    "w4_change_5m",
    f"""WITH {f.TICKS}, {f.METRICS}, l AS (SELECT *, lag(metric_at) OVER w AS at0, lag(open_interest) OVER w AS oi0, lag(ratio) OVER w AS r0
  FROM metrics WINDOW w AS (PARTITION BY symbol ORDER BY metric_at)) ---
SELECT symbol, metric_at, open_interest, ratio, CASE WHEN metric_at - at0 = INTERVAL '5 minutes' THEN (open_interest - oi0) / nullif(oi0, 0) END AS oi_change,
       CASE WHEN metric_at - at0 = INTERVAL '5 minutes' THEN ratio - r0 END AS ratio_change FROM l""",
    ["open_interest", "ratio", "oi_change", "ratio_change"],
)
def _(spark, sf):
    rows = a.metrics(spark, sf)
    rows = rows.withColumn("oi_change", windows.change_if_step("open_interest", "metric_at", 300, relative=True))
    return rows.withColumn("ratio_change", windows.change_if_step("ratio", "metric_at", 300))


def _ema_sql(parts: list[tuple[str, str, str]], body: str, source: str = f.NUMBERED) -> str:
    return f"WITH RECURSIVE {source}, " + ", ".join(f.ema(c, al, 1, n) for n, c, al in parts) + f" --- {body}"


def _v(name: str, least: int) -> str:
    return f"CASE WHEN r.rn >= {least} THEN {name}.v END"


@query(
    "i2_ema",
    _ema_sql(
        [("ef", "close", "2.0/13"), ("es", "close", "2.0/27")],
        f"SELECT symbol, opened_at, ema_fast, ema_slow, ema_fast - ema_slow AS gap, (ema_fast - ema_slow) / close AS gap_ratio FROM (SELECT r.*, {_v('ef', 12)} AS ema_fast, {_v('es', 26)} AS ema_slow FROM r JOIN ef USING (symbol, rn) JOIN es USING (symbol, rn))",
    ),
    ["ema_fast", "ema_slow", "gap", "gap_ratio"],
)
def _(spark, sf):
    return indicators.ema(a.bars_1h(spark, sf)).select("symbol", "opened_at", "ema_fast", "ema_slow", "gap", "gap_ratio")


@query(
    "i4_macd",
    _ema_sql(
        [("ef", "close", "2.0/13"), ("es", "close", "2.0/27"), ("eg", "close", "2.0/10")],
        f"SELECT symbol, opened_at, f - s AS macd, signal, f - s - signal AS hist FROM (SELECT r.*, {_v('ef', 12)} AS f, {_v('es', 26)} AS s, {_v('eg', 9)} AS signal FROM r JOIN ef USING (symbol, rn) JOIN es USING (symbol, rn) JOIN eg USING (symbol, rn))",
    ),
    ["macd", "signal", "hist"],
)
def _(spark, sf):
    return indicators.macd(a.bars_1h(spark, sf)).select("symbol", "opened_at", "macd", "signal", "hist")


_STEPS = f"""{f.BARS}, s AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS c0, lag(high) OVER w AS h0, lag(low) OVER w AS l0 FROM bars WINDOW w AS ({f.W})),
r AS (SELECT *, greatest(coalesce(close - c0, 0), 0) AS gain, greatest(-coalesce(close - c0, 0), 0) AS loss,
  CASE WHEN c0 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr,
  CASE WHEN high - h0 > l0 - low AND high - h0 > 0 THEN high - h0 ELSE 0 END AS pdm,
  CASE WHEN l0 - low > high - h0 AND l0 - low > 0 THEN l0 - low ELSE 0 END AS mdm FROM s)"""


@query(
    "i3_rsi",
    _ema_sql([("g", "gain", "1.0/14"), ("l", "loss", "1.0/14")], "SELECT r.symbol, r.opened_at, CASE WHEN r.rn >= 14 AND l.v > 0 THEN 100 - 100 / (1 + g.v / l.v) ELSE 0 END AS rsi FROM r JOIN g USING (symbol, rn) JOIN l USING (symbol, rn)", _STEPS),
    ["rsi"],
)
def _(spark, sf):
    return indicators.rsi(a.bars_1h(spark, sf)).select("symbol", "opened_at", "rsi")


@query("i6_atr", _ema_sql([("t", "tr", "1.0/14")], f"SELECT r.symbol, r.opened_at, r.tr, {_v('t', 14)} AS atr FROM r JOIN t USING (symbol, rn)", _STEPS), ["tr", "atr"])
def _(spark, sf):
    return indicators.atr(a.bars_1h(spark, sf)).select("symbol", "opened_at", "tr", "atr")


@query(
    "i15_keltner",
    _ema_sql([("t", "tr", "1.0/14"), ("e", "close", "2.0/21")], f"SELECT symbol, opened_at, mid, mid + 2 * atr AS upper, mid - 2 * atr AS lower FROM (SELECT r.*, {_v('t', 14)} AS atr, {_v('e', 20)} AS mid FROM r JOIN t USING (symbol, rn) JOIN e USING (symbol, rn))", _STEPS),
    ["mid", "upper", "lower"],
)
def _(spark, sf):
    return indicators.keltner(a.bars_1h(spark, sf)).select("symbol", "opened_at", "mid", "upper", "lower")


@query(
    "i7_dmi_adx",
    f"WITH RECURSIVE {_STEPS}, "
    + ", ".join(f.ema(c, "1.0/14", 14, n) for n, c in (("t", "tr"), ("p", "pdm"), ("m", "mdm")))
    + f""", d AS (SELECT r.symbol, r.opened_at, r.rn, CASE WHEN r.rn >= 14 THEN p.v * 100 / nullif(t.v, 0) END AS pdi, CASE WHEN r.rn >= 14 THEN m.v * 100 / nullif(t.v, 0) END AS mdi
  FROM r JOIN t USING (symbol, rn) JOIN p USING (symbol, rn) JOIN m USING (symbol, rn)),
x AS (SELECT *, abs(pdi - mdi) * 100 / nullif(pdi + mdi, 0) AS dx FROM d),
y AS (SELECT symbol, dx, opened_at, row_number() OVER (PARTITION BY symbol ORDER BY opened_at) AS rn FROM x WHERE dx IS NOT NULL), {f.ema("dx", "1.0/14", 14, "z", "y")} ---
SELECT x.symbol, x.opened_at, coalesce(pdi, 0) AS plus_di, coalesce(mdi, 0) AS minus_di,
       coalesce((SELECT CASE WHEN y.rn >= 14 THEN z.v END FROM y JOIN z USING (symbol, rn) WHERE y.symbol = x.symbol AND y.opened_at = x.opened_at), 0) AS adx FROM x""",
    ["plus_di", "minus_di", "adx"],
)
def _(spark, sf):
    return indicators.dmi(a.bars_1h(spark, sf)).select("symbol", "opened_at", "plus_di", "minus_di", "adx")


@query(
    "i9_cci",
    f"""WITH {f.BARS}, m AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS sma FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
n AS (SELECT *, abs(tp - sma) AS dev FROM m), o AS (SELECT *, CASE WHEN count(dev) OVER w = 20 THEN avg(dev) OVER w END AS mad FROM n WINDOW w AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) ---
SELECT symbol, opened_at, coalesce((tp - sma) / nullif(mad * 0.015, 0), 0) AS cci FROM o""",
    ["cci"],
)
def _(spark, sf):
    return indicators.cci(a.bars_1h(spark, sf)).select("symbol", "opened_at", "cci")


@query("i10_roc_momentum", f"WITH {f.BARS} --- SELECT symbol, opened_at, (close - lag(close, 10) OVER w) * 100 / lag(close, 10) OVER w AS roc, close - lag(close, 10) OVER w AS momentum FROM bars WINDOW w AS ({f.W})", ["roc", "momentum"])
def _(spark, sf):
    return indicators.roc_momentum(a.bars_1h(spark, sf)).select("symbol", "opened_at", "roc", "momentum")


@query("i11_obv", f"WITH {f.BARS}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER ({f.W})), 0) * close * volume AS q FROM bars) --- SELECT symbol, opened_at, sum(q) OVER ({f.W}) AS obv FROM s", ["obv"])
def _(spark, sf):
    return indicators.obv(a.bars_1h(spark, sf)).select("symbol", "opened_at", "obv")


@query(
    "i12_mfi",
    f"""WITH {f.BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), u AS (SELECT *, lag(tp) OVER ({f.W}) AS tp0, tp * close * volume AS flow FROM t),
v AS (SELECT *, CASE WHEN count(*) OVER w = 14 THEN sum(CASE WHEN tp > tp0 THEN flow ELSE 0 END) OVER w END AS p, CASE WHEN count(*) OVER w = 14 THEN sum(CASE WHEN tp < tp0 THEN flow ELSE 0 END) OVER w END AS n
  FROM u WINDOW w AS ({f.W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) --- SELECT symbol, opened_at, coalesce(CASE WHEN n > 0 THEN 100 - 100 / (1 + p / n) END, 50) AS mfi FROM v""",
    ["mfi"],
)
def _(spark, sf):
    return indicators.mfi(a.bars_1h(spark, sf)).select("symbol", "opened_at", "mfi")


@query("i13_vwap", f"WITH {f.BARS} --- SELECT symbol, opened_at, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap FROM bars WINDOW w AS ({f.W})", ["vwap"])
def _(spark, sf):
    return indicators.vwap(a.bars_1h(spark, sf)).select("symbol", "opened_at", "vwap")


@query(
    "i16_slope",
    f"""WITH {f.BARS}, h AS (SELECT symbol, opened_at, list(high) OVER w AS hs, list(low) OVER w AS ls FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
s AS (SELECT symbol, opened_at, {", ".join(f"CASE WHEN len({v}) = 50 THEN round(list_sum(list_transform({v}, lambda y, i: y * (i - 25.5::DOUBLE))) / 10412.5::DOUBLE, 9) END AS slope_{c}" for c, v in (("high", "hs"), ("low", "ls")))} FROM h) ---
SELECT *, CASE WHEN slope_high > 0 AND slope_low > 0 THEN 1 WHEN slope_high < 0 AND slope_low < 0 THEN -1 ELSE 0 END AS direction FROM s""",
    ["slope_high", "slope_low"],
)
def _(spark, sf):
    return indicators.slope(a.bars_1h(spark, sf)).select("symbol", "opened_at", "slope_high", "slope_low", "direction")


@query("j1_exact_left", f"WITH {f.BARS}, {f.METRICS} --- SELECT b.symbol, b.closed_at, b.close, m.open_interest, m.metric_at IS NULL AS unavailable FROM bars b LEFT JOIN metrics m ON m.symbol = b.symbol AND m.metric_at = b.closed_at", ["close", "open_interest"])
def _(spark, sf):
    right = a.metrics(spark, sf).select("symbol", F.col("metric_at").alias("closed_at"), "open_interest")
    rows = a.bars_1h(spark, sf).select("symbol", "closed_at", "close").join(right, ["symbol", "closed_at"], "left")
    return rows.withColumn("unavailable", F.col("open_interest").isNull())


@query(
    "j2_asof_funding",
    f"""WITH {f.BARS}, {f.FUNDING} --- SELECT b.symbol, b.closed_at, b.close, CASE WHEN b.closed_at - funding_at <= INTERVAL '8 hours' THEN funding_at END AS funding_at,
  CASE WHEN b.closed_at - funding_at <= INTERVAL '8 hours' THEN rate END AS rate
FROM bars b ASOF LEFT JOIN funding x ON b.symbol = x.symbol AND b.closed_at >= x.funding_at""",
    ["close", "rate"],
)
def _(spark, sf):
    left = a.bars_1h(spark, sf).select("symbol", "closed_at", "close")
    return asof.asof_join(left, a.funding(spark, sf), ["symbol"], "closed_at", "funding_at", 8 * 3600)


@query(
    "j3_asof_metrics",
    f"""WITH {f.BARS}, {f.METRICS}, m AS (SELECT *, CASE WHEN metric_at - lag(metric_at) OVER w = INTERVAL '5 minutes' THEN ratio - lag(ratio) OVER w END AS change FROM metrics WINDOW w AS (PARTITION BY symbol ORDER BY metric_at)) ---
SELECT b.symbol, b.closed_at, CASE WHEN b.closed_at - metric_at <= INTERVAL '5 minutes' THEN ratio END AS ratio, CASE WHEN b.closed_at = metric_at THEN change END AS change_5m
FROM bars b ASOF LEFT JOIN m ON b.symbol = m.symbol AND b.closed_at >= m.metric_at""",
    ["ratio", "change_5m"],
)
def _(spark, sf):
    right = a.metrics(spark, sf).select("symbol", "metric_at", "ratio", windows.change_if_step("ratio", "metric_at", 300).alias("change"))
    rows = asof.asof_join(a.bars_1h(spark, sf).select("symbol", "closed_at"), right, ["symbol"], "closed_at", "metric_at", 300)
    return rows.select("symbol", "closed_at", "ratio", F.when(F.col("closed_at") == F.col("metric_at"), F.col("change")).alias("change_5m"))


@query(
    "j4_staleness",
    f"""WITH {f.BARS}, {f.FUNDING}, {f.METRICS}, j AS (SELECT b.symbol, b.closed_at, rate, funding_at FROM bars b ASOF LEFT JOIN funding x ON b.symbol = x.symbol AND b.closed_at >= x.funding_at),
k AS (SELECT j.*, ratio, metric_at FROM j ASOF LEFT JOIN metrics m ON j.symbol = m.symbol AND j.closed_at >= m.metric_at) ---
SELECT symbol, closed_at, CASE WHEN closed_at - funding_at <= INTERVAL '4 hours' THEN rate END AS rate, CASE WHEN closed_at - metric_at <= INTERVAL '30 minutes' THEN ratio END AS ratio,
  array_to_string(list_filter([CASE WHEN coalesce(closed_at - funding_at <= INTERVAL '4 hours', false) THEN NULL ELSE 'funding' END, CASE WHEN coalesce(closed_at - metric_at <= INTERVAL '30 minutes', false) THEN NULL ELSE 'metrics' END], lambda x: x IS NOT NULL), ',') AS stale_sources
FROM k""",
    ["rate", "ratio"],
)
def _(spark, sf):
    left = a.bars_1h(spark, sf).select("symbol", "closed_at")
    rows = asof.asof_join(left, a.funding(spark, sf), ["symbol"], "closed_at", "funding_at", 4 * 3600)
    rows = asof.asof_join(rows, a.metrics(spark, sf).drop("open_interest"), ["symbol"], "closed_at", "metric_at", 1800)
    stale = F.array_compact(F.array(F.when(F.col("funding_at").isNull(), "funding"), F.when(F.col("metric_at").isNull(), "metrics")))
    return rows.select("symbol", "closed_at", "rate", "ratio", F.array_join(stale, ",").alias("stale_sources"))


@query(
    "j6_forward_return",
    f"WITH {f.BARS} --- SELECT b.symbol, b.opened_at, CASE WHEN strftime(n.opened_at, '%Y-%m') = strftime(b.opened_at, '%Y-%m') THEN n.close / b.close - 1 - 0.0008 END AS net_return FROM bars b LEFT JOIN bars n ON n.symbol = b.symbol AND n.opened_at = b.opened_at + INTERVAL '4 hours'",
    ["net_return"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).select("symbol", "opened_at", "close")
    rows = asof.at_offset(rows, rows, ["symbol"], "opened_at", 4 * 3600, {"close": "later"}, same_month=True)
    return rows.select("symbol", "opened_at", (F.col("later") / F.col("close") - 1 - 0.0008).alias("net_return"))


@query("j7_past_return", f"WITH {f.BARS} --- SELECT b.symbol, b.opened_at, b.close / n.close - 1 AS past_return FROM bars b LEFT JOIN bars n ON n.symbol = b.symbol AND n.opened_at = b.opened_at - INTERVAL '3 hours'", ["past_return"])
def _(spark, sf):
    rows = a.bars_1h(spark, sf).select("symbol", "opened_at", "close")
    rows = asof.at_offset(rows, rows, ["symbol"], "opened_at", -3 * 3600, {"close": "earlier"})
    return rows.select("symbol", "opened_at", (F.col("close") / F.col("earlier") - 1).alias("past_return"))


#: Session openings in minutes of the UTC day.
SESSIONS = {"asia": 0, "europe": 480, "us": 810}


@query(
    "j9_session_range",
    f"""WITH {f.TICKS}, s AS (SELECT *, CASE WHEN extract(hour FROM ts) * 60 + extract(minute FROM ts) >= 810 THEN 'us' WHEN extract(hour FROM ts) * 60 + extract(minute FROM ts) >= 480 THEN 'europe' ELSE 'asia' END AS session FROM ticks),
o AS (SELECT *, date_trunc('day', ts) + CASE session WHEN 'us' THEN INTERVAL '810 minutes' WHEN 'europe' THEN INTERVAL '480 minutes' ELSE INTERVAL '0 minutes' END AS session_open FROM s) ---
SELECT symbol, session, session_open, max(price) AS high, min(price) AS low, count(*) AS trades FROM o WHERE ts < session_open + INTERVAL '60 minutes' GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY symbol, session, session_open"),
    ["high", "low"],
)
def _(spark, sf):
    name, start = asof.session_of("ts", SESSIONS)
    rows = a.ticks(spark, sf).withColumn("session", name).withColumn("session_open", start)
    rows = rows.where(F.col("ts") < F.col("session_open") + F.expr("interval 60 minutes"))
    return rows.groupBy("symbol", "session", "session_open").agg(F.max("price").alias("high"), F.min("price").alias("low"), F.count(F.lit(1)).alias("trades"))
