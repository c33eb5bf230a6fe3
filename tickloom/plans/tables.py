"""Filters, set operations, gates, ranks and lookups over bars and the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import performance as p
from ..operators import signals
from ..operators.windows import by_time, full, prior_full, shift
from ..sources import adapters as a
from ..sources.sinks import merged_shards
from . import fragments as f
from .flow import FX, featured
from .performance import MONTHS, SCORES
from .registry import query

START, END = "2024-01-10", "2024-01-20"


@query("p1_half_open", f"WITH {f.BARS} --- SELECT symbol, opened_at, close FROM bars WHERE opened_at >= TIMESTAMP '{START}' AND opened_at < TIMESTAMP '{END}'", ["close"])
def _(spark, sf):
    rows = a.ticks(spark, sf).where((F.col("ts") >= F.lit(START).cast("timestamp")) & (F.col("ts") < F.lit(END).cast("timestamp")))  # reaches the scan
    from ..operators.bars import bars_of

    return bars_of(rows, "1 hour").select("symbol", "opened_at", "close")


@query("p2_rule_match", f"WITH {FX} --- SELECT symbol, closed_at, coalesce(ratio >= 50, false) AND coalesce(rate <= 0.001, false) AND coalesce(flow_delta >= 0, false) AS matched FROM fx")
def _(spark, sf):
    ok = lambda c: F.coalesce(c, F.lit(False))
    return featured(spark, sf).select("symbol", "closed_at", (ok(F.col("ratio") >= 50) & ok(F.col("rate") <= 0.001) & ok(F.col("flow_delta") >= 0)).alias("matched"))


@query("p5_entry_filter", f"WITH {f.BARS} --- SELECT symbol, opened_at FROM bars WHERE (high - low) / close >= 0.5 AND volume >= 100 AND trades >= 2")
def _(spark, sf):
    return a.bars_1h(spark, sf).where("(high - low) / close >= 0.5 and volume >= 100 and trades >= 2").select("symbol", "opened_at")


@query(
    "p6_missing_features",
    f"WITH {FX} --- SELECT symbol, closed_at, array_to_string(list_filter([CASE WHEN open_interest IS NULL THEN 'open_interest' END, CASE WHEN ratio IS NULL THEN 'ratio' END, CASE WHEN rate IS NULL THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS missing FROM fx",
)
def _(spark, sf):
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("open_interest", "ratio", "rate"))))
    return featured(spark, sf).select("symbol", "closed_at", F.array_join(missing, ",").alias("missing"))


@query(
    "p7_availability",
    f"""WITH {FX}, d AS (SELECT symbol, CAST(opened_at AS DATE) AS day, closed_at, open_interest IS NOT NULL AND rate IS NOT NULL AS one, ratio IS NOT NULL AND flow_delta IS NOT NULL AS two FROM fx) ---
SELECT symbol, day, min(CASE WHEN NOT (one OR two) THEN closed_at END) AS first_failing, bool_and(one OR two) AS available FROM d GROUP BY symbol, day""",
)
def _(spark, sf):
    has = lambda *cs: F.greatest(*(F.col(c).isNull() for c in cs)) == False  # noqa: E712, E731
    rows = featured(spark, sf).withColumn("ok", has("open_interest", "rate") | has("ratio", "flow_delta"))
    return rows.groupBy("symbol", F.to_date("opened_at").alias("day")).agg(F.min(F.when(~F.col("ok"), F.col("closed_at"))).alias("first_failing"), F.bool_and("ok").alias("available"))


@query(
    "j8_fold_members",
    f"""WITH {f.LEDGER} --- SELECT candidate_id, strftime(exit_ts, '%Y-%m') AS test_month, count(*) AS trades, sum(pnl) AS net FROM ledger WHERE entry_ts >= date_trunc('month', exit_ts) GROUP BY candidate_id, strftime(exit_ts, '%Y-%m')""",
    ["net"],
)
def _(spark, sf):
    rows = a.ledger(spark, sf).where(F.col("entry_ts") >= F.date_trunc("month", "exit_ts"))
    return rows.groupBy("candidate_id", F.date_format("exit_ts", "yyyy-MM").alias("test_month")).agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net"))


@query(
    "j15_shard_merge",
    f"""WITH {f.METRICS.replace("metrics AS", "m0 AS")}, one AS (SELECT symbol, metric_at, ratio FROM m0 WHERE extract(minute FROM metric_at) < 40), two AS (SELECT symbol, metric_at, CASE WHEN extract(minute FROM metric_at) = 30 THEN ratio + 1 ELSE ratio END AS ratio FROM m0 WHERE extract(minute FROM metric_at) >= 20) ---
SELECT symbol, metric_at, coalesce(one.ratio, two.ratio) AS ratio, coalesce(one.ratio <> two.ratio, false) AS conflict FROM one FULL JOIN two USING (symbol, metric_at)""".replace("WITH m0", f"WITH {f.TICKS}, m0"),
    ["ratio"],
)
def _(spark, sf):
    rows = a.metrics(spark, sf).select("symbol", "metric_at", "ratio")
    one = rows.where(F.minute("metric_at") < 40)
    two = rows.where(F.minute("metric_at") >= 20).withColumn("ratio", F.when(F.minute("metric_at") == 30, F.col("ratio") + 1).otherwise(F.col("ratio")))
    return merged_shards(one, two, ["symbol", "metric_at"], "ratio")


@query(
    "a31_drift",
    """WITH c AS (SELECT o_orderpriority AS label, count(*) FILTER (year(o_orderdate) = 1996) AS n1, count(*) FILTER (year(o_orderdate) = 1999) AS n2 FROM orders GROUP BY 1) ---
SELECT label, n1 / sum(n1) OVER () AS share_before, n2 / sum(n2) OVER () AS share_after, abs(n1 / sum(n1) OVER () - n2 / sum(n2) OVER ()) AS drift FROM c""",
    ["share_before", "share_after", "drift"],
)
def _(spark, sf):
    rows = a.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label"))
    rows = rows.agg(F.count(F.when(F.year("o_orderdate") == 1996, 1)).alias("n1"), F.count(F.when(F.year("o_orderdate") == 1999, 1)).alias("n2"))
    whole = Window.partitionBy()  # one row a label
    rows = rows.select("label", (F.col("n1") / F.sum("n1").over(whole)).alias("share_before"), (F.col("n2") / F.sum("n2").over(whole)).alias("share_after"))
    return rows.withColumn("drift", F.abs(F.col("share_before") - F.col("share_after")))


@query(
    "a41_overfit_gap",
    f"""WITH {f.LEDGER}, g AS (SELECT candidate_id, avg(CASE WHEN year(exit_ts) < 1999 THEN ret END) AS train, avg(CASE WHEN year(exit_ts) >= 1999 THEN ret END) AS validation FROM ledger GROUP BY candidate_id) --- SELECT *, train - validation AS gap, train > 0 AND validation <= 0 AS warning FROM g""",
    ["train", "validation", "gap"],
)
def _(spark, sf):
    early = F.year("exit_ts") < 1999
    rows = a.ledger(spark, sf).groupBy("candidate_id").agg(F.avg(F.when(early, F.col("ret"))).alias("train"), F.avg(F.when(~early, F.col("ret"))).alias("validation"))
    return rows.withColumn("gap", F.col("train") - F.col("validation")).withColumn("warning", (F.col("train") > 0) & (F.col("validation") <= 0))


@query(
    "a42_gross_metrics",
    f"WITH {f.LEDGER} --- SELECT candidate_id, avg(CAST(pnl + fee > 0 AS INTEGER)) AS gross_win_rate, avg(CASE WHEN notional > 0 THEN (pnl + fee) / notional END) AS mean_gross FROM ledger GROUP BY candidate_id",
    ["gross_win_rate", "mean_gross"],
)
def _(spark, sf):
    gross = F.col("pnl") + F.col("fee")
    return a.ledger(spark, sf).groupBy("candidate_id").agg(F.avg((gross > 0).cast("double")).alias("gross_win_rate"), F.avg(F.when(F.col("notional") > 0, gross / F.col("notional"))).alias("mean_gross"))


@query(
    "a43_cluster_support",
    "--- SELECT o_orderpriority AS label, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months, count(DISTINCT date_trunc('week', o_orderdate)) AS weeks, count(*) AS n FROM orders GROUP BY o_orderpriority",
)
def _(spark, sf):
    rows = a.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label"))
    return rows.agg(F.count_distinct(F.date_format("o_orderdate", "yyyy-MM")).alias("months"), F.count_distinct(F.date_trunc("week", "o_orderdate")).alias("weeks"), F.count(F.lit(1)).alias("n"))


@query(
    "w16_new_extremes",
    f"""WITH {f.NUMBERED}, p AS (SELECT r.symbol, r.opened_at, r.rn, q.rn AS k, q.high, max(q.high) OVER (PARTITION BY r.symbol, r.rn ORDER BY q.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r JOIN r q ON q.symbol = r.symbol AND q.rn BETWEEN r.rn - 11 AND r.rn) ---
SELECT symbol, opened_at, count(*) FILTER (high > before) AS new_highs FROM p GROUP BY symbol, opened_at""",
)
def _(spark, sf):
    recent = F.collect_list("high").over(by_time().rowsBetween(-11, 0))
    count = F.aggregate("h", F.struct(F.lit(None).cast("double").alias("m"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(F.greatest(s["m"], x).alias("m"), (s["n"] + F.coalesce((x > s["m"]).cast("long"), F.lit(0))).alias("n")), lambda s: s["n"])
    return a.bars_1h(spark, sf).withColumn("h", recent).select("symbol", "opened_at", count.alias("new_highs"))


@query(
    "w17_pullback_depth",
    f"""WITH {f.NUMBERED}, p AS (SELECT r.symbol, r.opened_at, q.close, max(q.close) OVER (PARTITION BY r.symbol, r.rn ORDER BY q.rn) AS top FROM r JOIN r q ON q.symbol = r.symbol AND q.rn BETWEEN r.rn - 11 AND r.rn) ---
SELECT symbol, opened_at, max(top - close) AS depth FROM p GROUP BY symbol, opened_at""",
    ["depth"],
)
def _(spark, sf):
    recent = F.collect_list("close").over(by_time().rowsBetween(-11, 0))
    depth = F.aggregate("c", F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("d")), lambda s, x: F.struct(F.greatest(s["m"], x).alias("m"), F.greatest(s["d"], F.greatest(s["m"], x) - x).alias("d")), lambda s: s["d"])
    return a.bars_1h(spark, sf).withColumn("c", recent).select("symbol", "opened_at", depth.alias("depth"))


@query(
    "w20_baseline_w21_recent_cross",
    f"""WITH {f.BARS}, m AS (SELECT *, CASE WHEN count(*) OVER w = 8 THEN avg(close) OVER w END AS sma FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
c AS (SELECT *, coalesce((close > sma) <> (lag(close) OVER ({f.W}) > lag(sma) OVER ({f.W})), false) AS crossed FROM m) ---
SELECT symbol, opened_at, avg(high - low) OVER ({f.W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS baseline, bool_or(crossed) OVER ({f.W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_cross FROM c""",
    ["baseline"],
)
def _(spark, sf):
    from ..operators.windows import recent_any

    rows = a.bars_1h(spark, sf).withColumn("sma", full(F.avg("close"), 8))
    rows = rows.withColumn("crossed", F.coalesce((F.col("close") > F.col("sma")) != (shift("close", 1) > shift("sma", 1)), F.lit(False)))
    base = F.avg(F.col("high") - F.col("low")).over(by_time().rowsBetween(-10, -1))
    return rows.select("symbol", "opened_at", base.alias("baseline"), recent_any(F.col("crossed"), 3).alias("recent_cross"))


@query(
    "w18_sliding_range",
    f"WITH {f.BARS} --- SELECT symbol, opened_at, CASE WHEN count(*) OVER w = 48 THEN max(high) OVER w - min(low) OVER w END AS span FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)",
    ["span"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("h", prior_full(F.max("high"), 48)).withColumn("l", prior_full(F.min("low"), 48))
    return rows.select("symbol", "opened_at", (F.col("h") - F.col("l")).alias("span"))


@query(
    "w23_htf_sample",
    f"WITH {f.BARS}, x AS (SELECT *, close / lag(close, 12) OVER w - 1 AS ret_12, close / lag(close, 48) OVER w - 1 AS ret_48 FROM bars WINDOW w AS ({f.W})) --- SELECT symbol, opened_at, ret_12, ret_48 FROM x WHERE extract(hour FROM opened_at) % 4 = 0",
    ["ret_12", "ret_48"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("ret_12", F.col("close") / shift("close", 12) - 1).withColumn("ret_48", F.col("close") / shift("close", 48) - 1)
    return rows.where(F.hour("opened_at") % 4 == 0).select("symbol", "opened_at", "ret_12", "ret_48")


@query(
    "w22_adverse_excursion",
    f"""WITH {f.NUMBERED}, e AS (SELECT symbol, opened_at, rn, close FROM r) ---
SELECT e.symbol, e.opened_at, greatest(0, (e.close - min(q.low)) / e.close) AS adverse_long, greatest(0, (max(q.high) - e.close) / e.close) AS adverse_short FROM e JOIN r q ON q.symbol = e.symbol AND q.rn BETWEEN e.rn + 1 AND e.rn + 12 GROUP BY e.symbol, e.opened_at, e.close""",
    ["adverse_long", "adverse_short"],
)
def _(spark, sf):
    ahead = by_time().rowsBetween(1, 12)
    rows = a.bars_1h(spark, sf).withColumn("rn", F.row_number().over(by_time())).withColumn("lo", F.min("low").over(ahead)).withColumn("hi", F.max("high").over(ahead))
    rows = rows.where("lo is not null")
    zero = F.lit(0.0)
    return rows.select("symbol", "opened_at", F.greatest(zero, (F.col("close") - F.col("lo")) / F.col("close")).alias("adverse_long"), F.greatest(zero, (F.col("hi") - F.col("close")) / F.col("close")).alias("adverse_short"))


@query("i17_snapshot", f"WITH {f.BARS}, x AS (SELECT symbol, opened_at, close, avg(close) OVER w AS sma, row_number() OVER (PARTITION BY symbol ORDER BY opened_at DESC) AS age FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) --- SELECT * FROM x WHERE age <= 5", ["close", "sma"])
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("sma", F.avg("close").over(by_time().rowsBetween(-19, 0)))
    rows = rows.withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("opened_at"))))
    return rows.where("age <= 5").select("symbol", "opened_at", "close", "sma", "age")


@query(
    "i18_keyed_averages",
    f"WITH {f.BARS}, x AS (SELECT symbol, opened_at, unnest([5, 20, 50]) AS period, unnest([CASE WHEN count(*) OVER a = 5 THEN avg(close) OVER a END, CASE WHEN count(*) OVER b = 20 THEN avg(close) OVER b END, CASE WHEN count(*) OVER c = 50 THEN avg(close) OVER c END]) AS value FROM bars WINDOW a AS ({f.W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS ({f.W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) --- SELECT symbol, opened_at, 'moving_average.period_' || period AS key, value FROM x WHERE value IS NOT NULL",
    ["value"],
)
def _(spark, sf):
    pairs = F.array(*(F.struct(F.lit(f"moving_average.period_{w}").alias("key"), full(F.avg("close"), w).alias("value")) for w in (5, 20, 50)))
    rows = a.bars_1h(spark, sf).withColumn("pairs", pairs).select("symbol", "opened_at", F.explode("pairs").alias("p")).select("symbol", "opened_at", "p.*")
    return rows.where("value is not null")


#: Allowed sides and size multiplier of each regime.
POLICY = {"trend_up": ("long", 1.0), "trend_down": ("short", 1.0), "range": ("both", 0.6), "transition": ("none", 0.0)}


@query(
    "i19_i20_regime_policy",
    f"""WITH {f.BARS}, m AS (SELECT *, {"CASE WHEN count(*) OVER a = 12 THEN avg(close) OVER a END"} AS fast, CASE WHEN count(*) OVER b = 48 THEN avg(close) OVER b END AS slow, CASE WHEN count(*) OVER b = 48 THEN stddev_pop(close) OVER b / avg(close) OVER b END AS width FROM bars WINDOW a AS ({f.W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), b AS ({f.W} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
q AS (SELECT symbol, quantile_cont(width, 0.3) AS q30 FROM m GROUP BY symbol), g AS (SELECT m.symbol, m.opened_at, CASE WHEN slow IS NULL OR fast IS NULL THEN 'unknown' WHEN abs(fast / slow - 1) < 0.01 THEN 'transition' WHEN width <= q30 THEN 'range' WHEN fast > slow THEN 'trend_up' ELSE 'trend_down' END AS regime FROM m JOIN q USING (symbol)) ---
SELECT g.*, coalesce(s.side, 'none') AS side, coalesce(s.size, 0) AS size FROM g LEFT JOIN (VALUES ('trend_up', 'long', 1.0::DOUBLE), ('trend_down', 'short', 1.0), ('range', 'both', 0.6), ('transition', 'none', 0.0)) s(regime, side, size) ON s.regime = g.regime""",
    ["size"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("fast", full(F.avg("close"), 12)).withColumn("slow", full(F.avg("close"), 48)).withColumn("width", full(F.stddev_pop("close"), 48) / F.col("slow"))
    q = rows.groupBy("symbol").agg(F.percentile("width", 0.3).alias("q30"))
    rows = rows.join(q, "symbol")
    regime = F.when(F.col("slow").isNull() | F.col("fast").isNull(), "unknown").when(F.abs(F.col("fast") / F.col("slow") - 1) < 0.01, "transition").when(F.col("width") <= F.col("q30"), "range").when(F.col("fast") > F.col("slow"), "trend_up").otherwise("trend_down")
    side = F.create_map(*(F.lit(x) for k, (s, _) in POLICY.items() for x in (k, s)))
    size = F.create_map(*(F.lit(x) for k, (_, z) in POLICY.items() for x in (k, z)))
    rows = rows.select("symbol", "opened_at", regime.alias("regime"))
    return rows.select("*", F.coalesce(side[F.col("regime")], F.lit("none")).alias("side"), F.coalesce(size[F.col("regime")], F.lit(0.0)).alias("size"))


@query(
    "b8_levels",
    f"""WITH {f.NUMBERED}, x AS (SELECT *, min(low) OVER w AS swing_low, max(high) OVER w AS swing_high FROM r WINDOW w AS ({f.W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) ---
SELECT symbol, opened_at, close * (1 - 0.1::DOUBLE) AS stop_fixed, close * (1 + 0.2::DOUBLE) AS target_fixed, swing_low AS stop_swing, close + 2 * (close - swing_low) AS target_swing FROM x""",
    ["stop_fixed", "target_fixed", "stop_swing", "target_swing"],
)
def _(spark, sf):
    low = F.min("low").over(by_time().rowsBetween(-9, 0))
    rows = a.bars_1h(spark, sf).withColumn("stop_swing", low)
    c = F.col("close")
    return rows.select("symbol", "opened_at", (c * 0.9).alias("stop_fixed"), (c * 1.2).alias("target_fixed"), "stop_swing", (c + 2 * (c - F.col("stop_swing"))).alias("target_swing"))


@query(
    "b12_promotion",
    f"WITH {SCORES} --- SELECT candidate_id, trades >= 100 AND positive >= 0.4 AND worst_drawdown <= 0.2 AND months >= 12 AS promoted FROM s1",
)
def _(spark, sf):
    rows = p.train_score(p.monthly(a.ledger(spark, sf)))
    return rows.select("candidate_id", ((F.col("trades") >= 100) & (F.col("positive") >= 0.4) & (F.col("worst_drawdown") <= 0.2) & (F.col("months") >= 12)).alias("promoted"))


@query(
    "c13_daily_selection",
    f"""WITH {SCORES}, b AS (SELECT * FROM s1 QUALIFY row_number() OVER (ORDER BY round(score, 9) DESC, candidate_id) = 1), d AS (SELECT symbol, CAST(ts AS DATE) AS day, avg(price) AS level, count(*) AS n FROM {"(SELECT event_type AS symbol, ts, value AS price FROM events WHERE value > 0)"} GROUP BY symbol, CAST(ts AS DATE)) ---
SELECT symbol, day, CASE WHEN n < 5 THEN 'cash:thin' WHEN abs(level - 50) < 1 THEN 'cash:low_confidence' WHEN (SELECT score FROM b) <= -1 THEN 'cash:no_candidate' ELSE 'candidate:' || (SELECT candidate_id FROM b) END AS decision FROM d""",
)
def _(spark, sf):
    best = p.train_score(p.monthly(a.ledger(spark, sf))).agg(F.max_by(F.struct("candidate_id", "score"), F.struct(F.round("score", 9), -F.col("candidate_id"))).alias("b"))
    days = a.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("price").alias("level"), F.count(F.lit(1)).alias("n"))
    rows = days.crossJoin(F.broadcast(best))  # one row
    decision = F.when(F.col("n") < 5, "cash:thin").when(F.abs(F.col("level") - 50) < 1, "cash:low_confidence").when(F.col("b.score") <= -1, "cash:no_candidate").otherwise(F.concat(F.lit("candidate:"), F.col("b.candidate_id").cast("string")))
    return rows.select("symbol", "day", decision.alias("decision"))


@query(
    "c15_train_selected",
    f"""WITH {MONTHS}, n AS (SELECT candidate_id, month, return_ratio, trades, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS m FROM months),
b AS (SELECT *, avg(return_ratio) OVER w AS train_mean, sum(trades) OVER w AS train_trades, count(return_ratio) OVER w AS train_n FROM n WINDOW w AS (PARTITION BY candidate_id ORDER BY m RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, train_n = 6 AND train_trades >= 20 AND train_mean > 0 AS passed FROM b), q AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY passed DESC, train_mean DESC, candidate_id) AS place FROM g WHERE train_n = 6) ---
SELECT month, count(*) FILTER (passed AND place <= 3) AS chosen, coalesce(avg(CASE WHEN passed AND place <= 3 THEN return_ratio END), 0) AS portfolio_return, CASE WHEN count(*) FILTER (passed AND place <= 3) = 0 THEN 'cash' WHEN count(*) FILTER (passed AND place <= 3) < 3 THEN 'partial' ELSE 'full' END AS status FROM q GROUP BY month""",
    ["portfolio_return"],
)
def _(spark, sf):
    number = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("m")
    before = Window.partitionBy("candidate_id").orderBy("m").rangeBetween(-6, -1)
    rows = p.monthly(a.ledger(spark, sf)).select("candidate_id", "month", "return_ratio", "trades", number)
    rows = rows.withColumn("mean", F.avg("return_ratio").over(before)).withColumn("n_trades", F.sum("trades").over(before)).withColumn("n", F.count("return_ratio").over(before)).where("n = 6")
    rows = rows.withColumn("passed", (F.col("n_trades") >= 20) & (F.col("mean") > 0))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("month").orderBy(F.desc("passed"), F.desc("mean"), "candidate_id")))
    chosen = F.col("passed") & (F.col("place") <= 3)
    rows = rows.groupBy("month").agg(F.count(F.when(chosen, 1)).alias("chosen"), F.coalesce(F.avg(F.when(chosen, F.col("return_ratio"))), F.lit(0.0)).alias("portfolio_return"))
    return rows.withColumn("status", F.when(F.col("chosen") == 0, "cash").when(F.col("chosen") < 3, "partial").otherwise("full"))


@query(
    "c18_evidence_checks",
    f"""WITH {f.LEDGER}, o AS (SELECT order_id, sum(pnl) AS net, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) - sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS parts, count(*) AS trades, bool_and(exit_ts >= entry_ts) AS ordered FROM ledger GROUP BY order_id) ---
SELECT ordered, abs(net - parts) <= 1e-6 AS sums_agree, count(*) AS orders FROM o GROUP BY ordered, abs(net - parts) <= 1e-6""",
)
def _(spark, sf):
    pnl = F.col("pnl")
    rows = a.ledger(spark, sf).groupBy("order_id").agg(F.sum(pnl).alias("net"), (F.sum(F.when(pnl > 0, pnl).otherwise(0.0)) - F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))).alias("parts"), F.bool_and(F.col("exit_ts") >= F.col("entry_ts")).alias("ordered"))
    return rows.groupBy("ordered", (F.abs(F.col("net") - F.col("parts")) <= 1e-6).alias("sums_agree")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "l5_balance_rank",
    "WITH c AS (SELECT year(o_orderdate) AS model, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY model) AS share FROM c), e AS (SELECT model, sum(-share * ln(share)) / ln(5) AS entropy, min(share) AS least, max(share) AS most FROM s GROUP BY model) --- SELECT model, row_number() OVER (ORDER BY round(entropy, 9) DESC, round(least, 9) DESC, round(most, 9), model) AS place, entropy FROM e",
    ["entropy"],
)
def _(spark, sf):
    counts = a.read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("model"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("model"))
    e = counts.withColumn("share", share).groupBy("model").agg((F.sum(-F.col("share") * F.log("share")) / F.log(F.lit(5.0))).alias("entropy"), F.min("share").alias("least"), F.max("share").alias("most"))
    order = Window.orderBy(F.desc(F.round("entropy", 9)), F.desc(F.round("least", 9)), F.round("most", 9), "model")  # one row a model
    return e.select("model", F.row_number().over(order).cast("long").alias("place"), "entropy")


@query(
    "l9_top_rules",
    f"WITH {f.LEDGER}, g AS (SELECT side, flag, candidate_id, avg(ret) AS mean, count(*) AS n FROM ledger GROUP BY side, flag, candidate_id) --- SELECT side, flag, candidate_id, mean, n FROM g QUALIFY row_number() OVER (PARTITION BY side ORDER BY round(mean, 12) DESC, n DESC, flag, candidate_id) <= 5",
    ["mean"],
)
def _(spark, sf):
    g = a.ledger(spark, sf).groupBy("side", "flag", "candidate_id").agg(F.avg("ret").alias("mean"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("side").orderBy(F.desc(F.round("mean", 12)), F.desc("n"), "flag", "candidate_id")
    return g.withColumn("rn", F.row_number().over(order)).where("rn <= 5").drop("rn")


@query(
    "u3_u4_source_lists",
    f"""WITH {f.LEDGER}, g AS (SELECT candidate_id, list_sort(list(DISTINCT flag)) AS have FROM ledger WHERE pnl > 4900 GROUP BY candidate_id) --- SELECT candidate_id, array_to_string(list_filter(['A', 'N', 'R', 'X'], lambda x: NOT list_contains(have, x)), ',') AS missing, array_to_string(list_concat(have, list_filter(['X', 'A'], lambda x: NOT list_contains(have, x))), ',') AS merged FROM g""",
)
def _(spark, sf):
    rows = a.ledger(spark, sf).where("pnl > 4900").groupBy("candidate_id").agg(F.sort_array(F.collect_set("flag")).alias("have"))
    wanted, more = (F.array(*(F.lit(x) for x in xs)) for xs in (["A", "N", "R", "X"], ["X", "A"]))
    return rows.select("candidate_id", F.array_join(F.array_except(wanted, "have"), ",").alias("missing"), F.array_join(F.array_distinct(F.concat("have", more)), ",").alias("merged"))


@query("u7_unique_combos", f"WITH {f.LEDGER} --- SELECT DISTINCT candidate_id, flag, side, CAST(round(confidence * 10) AS BIGINT) AS level FROM ledger")
def _(spark, sf):
    return a.ledger(spark, sf).select("candidate_id", "flag", "side", F.round(F.col("confidence") * 10).cast("long").alias("level")).distinct()


@query("q2_open_signals", "--- SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '5-LOW' QUALIFY row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= 500", ["o_totalprice"])
def _(spark, sf):
    rows = a.read(spark, sf, "orders").where("o_orderstatus in ('O', 'P') and o_orderpriority <> '5-LOW'")
    return rows.orderBy("o_orderdate", "o_orderkey").limit(500).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "q3_forward_window",
    f"""WITH {f.NUMBERED}, e AS (SELECT symbol, opened_at AS signal_at, rn FROM r) --- SELECT e.symbol, e.signal_at, r.opened_at, r.close, r.rn - e.rn AS step FROM e JOIN r ON r.symbol = e.symbol AND r.rn BETWEEN e.rn + 1 AND e.rn + 6""",
    ["close"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("rn", F.row_number().over(by_time()))
    e = rows.select("symbol", F.col("opened_at").alias("signal_at"), F.col("rn").alias("rn0"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("step"))
    e = e.withColumn("rn", F.col("rn0") + F.col("step"))
    return e.join(rows.select("symbol", "rn", "opened_at", "close"), ["symbol", "rn"]).select("symbol", "signal_at", "opened_at", "close", F.col("step").cast("long").alias("step"))


@query("q7_anomaly_count", "--- SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND value > 150 GROUP BY event_type")
def _(spark, sf):
    rows = a.read(spark, sf, "events").where((F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")) & (F.col("value") > 150))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("t34_routed_signals", f"""WITH {f.BARS}, x AS (SELECT symbol, opened_at, CASE WHEN count(*) OVER w = 20 AND close / avg(close) OVER w - 1 > 0 THEN 'long' WHEN count(*) OVER w = 20 AND close / avg(close) OVER w - 1 < 0 THEN 'short' ELSE 'wait' END AS d FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) ---
SELECT symbol, opened_at, CASE WHEN symbol IN ('click', 'view') THEN d WHEN symbol = 'error' THEN CASE d WHEN 'long' THEN 'short' WHEN 'short' THEN 'long' ELSE 'wait' END ELSE 'wait' END AS direction FROM x""")
def _(spark, sf):
    rows = signals.ma_signal(a.bars_1h(spark, sf))
    flipped = signals.inverted(rows).select("symbol", "opened_at", F.col("direction").alias("flip"))
    rows = rows.join(flipped, ["symbol", "opened_at"])
    return rows.select("symbol", "opened_at", F.when(F.col("symbol").isin("click", "view"), F.col("direction")).when(F.col("symbol") == "error", F.col("flip")).otherwise("wait").alias("direction"))
