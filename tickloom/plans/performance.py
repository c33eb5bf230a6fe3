"""Queries over the trade ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import performance as p
from ..sources import adapters as a
from . import fragments as f
from .registry import query

DAILY = f"{f.LEDGER}, days AS (SELECT candidate_id, CAST(exit_ts AS DATE) AS day, sum(pnl) AS pnl, count(*) AS trades FROM ledger GROUP BY candidate_id, CAST(exit_ts AS DATE))"
EQUITY = f"""{DAILY}, e0 AS (SELECT *, 1000000.0 + sum(pnl) OVER (PARTITION BY candidate_id ORDER BY day) AS equity FROM days),
e1 AS (SELECT *, greatest(1000000.0, max(equity) OVER (PARTITION BY candidate_id ORDER BY day)) AS peak FROM e0)"""


def compounded(value: str, over: str = "") -> str:
    """Product of (1 + value) minus 1; -1 once a value is -1 or less, as nothing is left then."""
    return f"CASE WHEN min({value}){over} <= -1 THEN -1.0 ELSE exp(sum(ln(CASE WHEN {value} > -1 THEN 1 + {value} END)){over}) - 1 END"


MONTHS = f"""{DAILY}, m0 AS (SELECT *, strftime(day, '%Y-%m') AS month FROM days),
m1 AS (SELECT *, 1000000.0 + sum(pnl) OVER (PARTITION BY candidate_id, month ORDER BY day) AS equity FROM m0),
m2 AS (SELECT *, greatest(1000000.0, max(equity) OVER (PARTITION BY candidate_id, month ORDER BY day)) AS peak FROM m1),
months AS (SELECT candidate_id, month, sum(pnl) / 1000000.0 AS return_ratio, CAST(sum(trades) AS BIGINT) AS trades, sum(pnl) / sum(trades) AS expectancy, max((peak - equity) / peak) AS max_drawdown FROM m2 GROUP BY candidate_id, month)"""


@query(
    "a6_performance",
    f"""WITH {f.LEDGER}, g AS (SELECT candidate_id, count(*) AS trades, sum(pnl) AS net, count(*) FILTER (pnl > 0) AS wins, sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) AS gains,
  sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) AS losses, avg(ret) AS mean_return, stddev_pop(ret) AS deviation, sqrt(avg(least(ret, 0) * least(ret, 0))) AS downside, sum(fee) AS fees FROM ledger GROUP BY candidate_id) ---
SELECT *, wins / trades AS win_rate, CASE WHEN losses > 0 THEN gains / losses END AS profit_factor, coalesce(CASE WHEN losses > 0 THEN gains / losses END, 0) AS profit_factor_zero FROM g""",
    ["net", "gains", "losses", "mean_return", "deviation", "downside", "fees", "win_rate", "profit_factor", "profit_factor_zero"],
)
def _(spark, sf):
    return p.summary(a.ledger(spark, sf), ["candidate_id"])


@query("a7_drawdown", f"WITH {EQUITY} --- SELECT candidate_id, max((peak - equity) / peak) AS max_drawdown, arg_max(equity, day) AS final_equity FROM e1 GROUP BY candidate_id", ["max_drawdown", "final_equity"])
def _(spark, sf):
    return p.drawdown(p.daily(a.ledger(spark, sf)))


@query(
    "a34_equity_curve",
    f"WITH {EQUITY}, n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY day) AS rn, count(*) OVER (PARTITION BY candidate_id) AS n FROM e1) --- SELECT candidate_id, day, equity FROM n WHERE (rn - 1) % greatest(1, CAST(ceil(n / 200) AS BIGINT)) = 0 OR rn = n",
    ["equity"],
)
def _(spark, sf):
    return p.sampled_equity(p.daily(a.ledger(spark, sf)), 200)


@query(
    "a8_a10_tail_stats",
    f"""WITH {MONTHS}, n AS (SELECT *, count(*) OVER (PARTITION BY candidate_id) AS n, row_number() OVER (PARTITION BY candidate_id ORDER BY return_ratio, month) AS low, row_number() OVER (PARTITION BY candidate_id ORDER BY return_ratio DESC, month) AS top FROM months),
t AS (SELECT *, greatest(1, ceil(n * 0.1::DOUBLE)) AS tenth FROM n) ---
SELECT candidate_id, avg(CASE WHEN low <= tenth THEN return_ratio END) AS shortfall, max(CASE WHEN low = tenth THEN return_ratio END) AS tenth_percentile,
  coalesce({compounded("(CASE WHEN top > 1 THEN return_ratio END)")}, 0) AS without_best, {compounded("return_ratio")} AS compounded, median(return_ratio) AS median FROM t GROUP BY candidate_id""",
    ["shortfall", "tenth_percentile", "without_best", "compounded", "median"],
)
def _(spark, sf):
    return p.tail_stats(p.monthly(a.ledger(spark, sf)))


@query(
    "a15_concentration",
    f"""WITH {f.LEDGER}, n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY pnl DESC, trade_id) AS rn, sum(pnl) OVER (PARTITION BY candidate_id) AS alls FROM ledger WHERE pnl > 0) ---
SELECT candidate_id, max(CASE WHEN rn = 1 THEN pnl END) / any_value(alls) AS top_1, sum(pnl) / any_value(alls) AS top_5 FROM n WHERE rn <= 5 GROUP BY candidate_id""",
    ["top_1", "top_5"],
)
def _(spark, sf):
    return p.concentration(a.ledger(spark, sf))


@query(
    "a16_worst_7_days",
    f"""WITH {DAILY}, n AS (SELECT *, lag(day, 6) OVER w AS first, {compounded("(pnl / 1000000.0)", " OVER (PARTITION BY candidate_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")} AS block FROM days WINDOW w AS (PARTITION BY candidate_id ORDER BY day)) ---
SELECT candidate_id, min(block) AS worst, count(*) AS blocks FROM n WHERE day - first = 6 GROUP BY candidate_id""",
    ["worst"],
)
def _(spark, sf):
    return p.worst_block(p.daily(a.ledger(spark, sf)), 7)


@query(
    "a17_calibration",
    f"""WITH {f.LEDGER}, b AS (SELECT *, CAST(floor(round(confidence * 10, 9)) AS INTEGER) AS bin FROM ledger WHERE confidence >= 0 AND confidence < 1),
g AS (SELECT bin, count(*) AS trades, sum(pnl) AS net, avg(CAST(pnl > 0 AS INTEGER)) AS win_rate, avg(pnl) AS expected FROM b GROUP BY bin) ---
SELECT CAST(i AS INTEGER) AS bin, i / 10 AS bin_from, coalesce(trades, 0) AS trades, coalesce(net, 0) AS net, coalesce(win_rate, 0) AS win_rate, coalesce(expected, 0) AS expected FROM range(10) t(i) LEFT JOIN g ON g.bin = i""",
    ["bin_from", "net", "win_rate", "expected"],
)
def _(spark, sf):
    return p.calibration(a.ledger(spark, sf))


@query(
    "l11_dynamic_threshold",
    f"""WITH {f.LEDGER}, b AS (SELECT flag, CAST(floor(round(confidence * 10, 9)) AS INTEGER) AS bin, pnl FROM ledger WHERE confidence >= 0 AND confidence < 1),
g AS (SELECT flag, bin FROM b GROUP BY flag, bin HAVING count(*) >= 30 AND avg(pnl) > 0) --- SELECT flag, min(bin) / 10 AS threshold FROM g GROUP BY flag""",
    ["threshold"],
)
def _(spark, sf):
    rows = a.ledger(spark, sf).where("confidence >= 0 and confidence < 1").withColumn("bin", F.floor(F.round(F.col("confidence") * 10, 9)))
    rows = rows.groupBy("flag", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("ev")).where("n >= 30 and ev > 0")
    return rows.groupBy("flag").agg((F.min("bin") / 10).alias("threshold"))


@query(
    "a35_loss_streak",
    f"WITH {f.LEDGER}, n AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY exit_ts DESC, trade_id DESC) AS rn FROM ledger QUALIFY rn <= 50) --- SELECT candidate_id, coalesce(min(CASE WHEN pnl >= 0 THEN rn END) - 1, count(*)) AS streak FROM n GROUP BY candidate_id",
)
def _(spark, sf):
    return p.loss_streak(a.ledger(spark, sf), 50)


@query(
    "a36_loss_limits",
    f"""WITH {DAILY}, w AS (SELECT candidate_id, date_trunc('week', day) AS week, min(pnl) AS worst_day, sum(pnl) AS week_pnl FROM days GROUP BY candidate_id, date_trunc('week', day)) ---
SELECT candidate_id, count(*) FILTER (worst_day <= -20000) AS day_limit_weeks, count(*) FILTER (week_pnl <= -50000) AS week_limit_weeks, count(*) AS weeks FROM w GROUP BY candidate_id""",
)
def _(spark, sf):
    rows = p.daily(a.ledger(spark, sf)).groupBy("candidate_id", F.date_trunc("week", "day").alias("week")).agg(F.min("pnl").alias("worst_day"), F.sum("pnl").alias("week_pnl"))
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("candidate_id").agg(count(F.col("worst_day") <= -20000).alias("day_limit_weeks"), count(F.col("week_pnl") <= -50000).alias("week_limit_weeks"), F.count(F.lit(1)).alias("weeks"))


@query("a19_monthly_summary", f"WITH {MONTHS} --- SELECT candidate_id, avg(return_ratio) AS mean, min(return_ratio) AS worst, avg(CAST(return_ratio > 0 AS INTEGER)) AS positive, count(*) AS months FROM months GROUP BY candidate_id", ["mean", "worst", "positive"])
def _(spark, sf):
    rows = p.monthly(a.ledger(spark, sf)).groupBy("candidate_id")
    return rows.agg(F.avg("return_ratio").alias("mean"), F.min("return_ratio").alias("worst"), F.avg((F.col("return_ratio") > 0).cast("double")).alias("positive"), F.count(F.lit(1)).alias("months"))


@query("a20_portfolio", f"WITH {MONTHS} --- SELECT month, avg(return_ratio) AS return_ratio, count(*) AS candidates FROM months GROUP BY month", ["return_ratio"])
def _(spark, sf):
    return p.monthly(a.ledger(spark, sf)).groupBy("month").agg(F.avg("return_ratio").alias("return_ratio"), F.count(F.lit(1)).alias("candidates"))


@query(
    "j10_corr_matrix",
    f"""WITH {MONTHS} --- SELECT a.candidate_id AS a, b.candidate_id AS b, count(*) AS months, CASE WHEN count(*) >= 2 AND stddev_pop(a.return_ratio) > 0 AND stddev_pop(b.return_ratio) > 0 THEN corr(a.return_ratio, b.return_ratio) END AS correlation
FROM months a JOIN months b ON a.month = b.month AND a.candidate_id < b.candidate_id GROUP BY a.candidate_id, b.candidate_id""",
    ["correlation"],
)
def _(spark, sf):
    months = p.monthly(a.ledger(spark, sf)).select("month", "candidate_id", "return_ratio")
    one, two = months.toDF("month", "a", "ra"), months.toDF("month", "b", "rb")
    rows = one.join(two, "month").where("a < b").groupBy("a", "b")
    rows = rows.agg(F.count(F.lit(1)).alias("months"), F.corr("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return rows.select("a", "b", "months", F.when((F.col("months") >= 2) & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("c")).alias("correlation"))


SCORES = f"""{MONTHS}, s0 AS (SELECT candidate_id, {compounded("return_ratio")} AS total, avg(CAST(return_ratio > 0 AS INTEGER)) AS positive, sum(expectancy / 1000000.0 * trades) / sum(trades) AS expectancy,
  max(max_drawdown) AS worst_drawdown, CAST(sum(trades) AS BIGINT) AS trades, count(*) AS months FROM months GROUP BY candidate_id), s1 AS (SELECT *, (total * positive + expectancy) / (1 + worst_drawdown) AS score FROM s0)"""


@query("a23_train_score", f"WITH {SCORES} --- SELECT * FROM s1", ["total", "positive", "expectancy", "worst_drawdown", "score"])
def _(spark, sf):
    return p.train_score(p.monthly(a.ledger(spark, sf)))


@query(
    "l1_rank",
    f"WITH {SCORES} --- SELECT candidate_id, row_number() OVER (ORDER BY trades / months >= 60 DESC, positive >= 0.5 DESC, round(total, 9) DESC, round(worst_drawdown, 9), candidate_id) AS place FROM s1",
)
def _(spark, sf):
    rows = p.train_score(p.monthly(a.ledger(spark, sf)))
    order = Window.orderBy(F.desc(F.col("trades") / F.col("months") >= 60), F.desc(F.col("positive") >= 0.5), F.desc(F.round("total", 9)), F.round("worst_drawdown", 9), "candidate_id")
    return rows.select("candidate_id", F.row_number().over(order).alias("place"))  # one row a candidate


@query(
    "l4_family_best",
    f"WITH {f.LEDGER}, g AS (SELECT flag, candidate_id, sum(pnl) AS net, count(*) AS trades FROM ledger GROUP BY flag, candidate_id) --- SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY flag ORDER BY round(net, 6) DESC, candidate_id) = 1",
    ["net"],
)
def _(spark, sf):
    rows = a.ledger(spark, sf).groupBy("flag", "candidate_id").agg(F.sum("pnl").alias("net"), F.count(F.lit(1)).alias("trades"))
    order = Window.partitionBy("flag").orderBy(F.desc(F.round("net", 6)), "candidate_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


@query(
    "c14_walk_forward",
    f"""WITH {MONTHS}, n AS (SELECT candidate_id, month, return_ratio, trades, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS m FROM months),
b AS (SELECT *, avg(return_ratio) OVER w AS train_mean, count(return_ratio) OVER w AS train_n FROM n WINDOW w AS (PARTITION BY candidate_id ORDER BY m RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY train_mean DESC, candidate_id) AS place FROM b WHERE train_n = 6) ---
SELECT month, candidate_id, place, train_mean, return_ratio AS test_return, trades AS test_trades FROM q WHERE place <= 3""",
    ["train_mean", "test_return"],
)
def _(spark, sf):
    return p.walk_forward(p.monthly(a.ledger(spark, sf)))


@query(
    "a22_walk_forward_summary",
    f"""WITH {MONTHS}, n AS (SELECT candidate_id, month, return_ratio, trades, max_drawdown, CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) AS m FROM months),
b AS (SELECT *, avg(return_ratio) OVER w AS train_mean, count(return_ratio) OVER w AS train_n FROM n WINDOW w AS (PARTITION BY candidate_id ORDER BY m RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY train_mean DESC, candidate_id) AS place FROM b WHERE train_n = 6) ---
SELECT candidate_id, avg(return_ratio) AS mean_return, count(*) FILTER (return_ratio > 0) AS positive_folds, count(*) AS folds, CAST(sum(trades) AS BIGINT) AS trades FROM q WHERE place <= 3 GROUP BY candidate_id""",
    ["mean_return"],
)
def _(spark, sf):
    rows = p.walk_forward(p.monthly(a.ledger(spark, sf))).groupBy("candidate_id")
    return rows.agg(F.avg("test_return").alias("mean_return"), F.count(F.when(F.col("test_return") > 0, 1)).alias("positive_folds"), F.count(F.lit(1)).alias("folds"), F.sum("test_trades").alias("trades"))


@query(
    "a39_fee_reconciliation",
    f"WITH {f.LEDGER}, g AS (SELECT candidate_id, sum(notional) AS turnover, sum(fee) AS fees FROM ledger GROUP BY candidate_id) --- SELECT candidate_id, turnover, fees, abs(fees - turnover * 0.0004) <= greatest(1e-8, 1e-10 * abs(fees)) AS reconciled FROM g",
    ["turnover", "fees"],
)
def _(spark, sf):
    rows = a.ledger(spark, sf).groupBy("candidate_id").agg(F.sum("notional").alias("turnover"), F.sum("fee").alias("fees"))
    return rows.withColumn("reconciled", F.abs(F.col("fees") - F.col("turnover") * 0.0004) <= F.greatest(F.lit(1e-8), F.abs("fees") * 1e-10))


@query(
    "a38_time_in_market",
    f"WITH {f.LEDGER}, g AS (SELECT candidate_id, sum(epoch(exit_ts) - epoch(entry_ts)) / 3600.0 AS holding_hours, (epoch(max(exit_ts)) - epoch(min(entry_ts))) / 3600.0 AS span_hours, sum(pnl) AS net FROM ledger GROUP BY candidate_id) --- SELECT candidate_id, holding_hours / span_hours AS exposure, net / (holding_hours / span_hours) AS net_per_exposure FROM g",
    ["exposure", "net_per_exposure"],
)
def _(spark, sf):
    t = lambda c: F.unix_timestamp(c)
    rows = a.ledger(spark, sf).groupBy("candidate_id").agg((F.sum(t("exit_ts") - t("entry_ts")) / 3600.0).alias("hold"), ((F.max(t("exit_ts")) - F.min(t("entry_ts"))) / 3600.0).alias("span"), F.sum("pnl").alias("net"))
    return rows.select("candidate_id", (F.col("hold") / F.col("span")).alias("exposure"), (F.col("net") / (F.col("hold") / F.col("span"))).alias("net_per_exposure"))


@query("j5_fill_signal", f"WITH {f.LEDGER} --- SELECT l.trade_id, l.confidence, l.pnl, o.o_orderpriority AS priority FROM ledger l JOIN orders o ON o.o_orderkey = l.order_id WHERE l.status = 'F' AND l.flag = 'R'", ["confidence", "pnl"])
def _(spark, sf):
    orders = a.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority"))
    return a.ledger(spark, sf).where("status = 'F' and flag = 'R'").join(orders, "order_id").select("trade_id", "confidence", "pnl", "priority")


@query(
    "p8_rejection_reasons",
    f"""WITH {SCORES} --- SELECT candidate_id, array_to_string(list_filter([CASE WHEN trades < 500 THEN 'too_few_trades' END, CASE WHEN positive < 0.5 THEN 'unstable' END, CASE WHEN worst_drawdown > 0.02 THEN 'drawdown' END, CASE WHEN total <= 0 THEN 'no_profit' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s1""",
)
def _(spark, sf):
    gates = {"too_few_trades": F.col("trades") < 500, "unstable": F.col("positive") < 0.5, "drawdown": F.col("worst_drawdown") > 0.02, "no_profit": F.col("total") <= 0}
    failed = F.array_compact(F.array(*(F.when(c, name) for name, c in gates.items())))
    return p.train_score(p.monthly(a.ledger(spark, sf))).select("candidate_id", F.array_join(failed, ",").alias("reasons"))


@query(
    "b9_sizing",
    f"""WITH {f.LEDGER} --- SELECT trade_id, 1000.0::DOUBLE AS fixed, 200 + 1800 * least(greatest(confidence, 0), 1) AS linear, 200 + 1800 * least(greatest(confidence, 0), 1) * least(greatest(confidence, 0), 1) AS squared,
  least(50000.0, greatest(0, 60000.0 - notional)) * least(greatest(confidence, 0), 1) AS capped FROM ledger""",
    ["fixed", "linear", "squared", "capped"],
)
def _(spark, sf):
    quality = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0))
    capped = F.least(F.lit(50000.0), F.greatest(F.lit(0.0), 60000.0 - F.col("notional"))) * quality
    return a.ledger(spark, sf).select("trade_id", F.lit(1000.0).alias("fixed"), (200 + 1800 * quality).alias("linear"), (200 + 1800 * quality * quality).alias("squared"), capped.alias("capped"))


@query(
    "b10_entry_risk",
    f"WITH {f.LEDGER} --- SELECT trade_id, CASE WHEN qty <= 0 THEN 'no_quantity' WHEN notional > 80000 THEN 'notional' WHEN confidence < 0.2 THEN 'confidence' WHEN fee > 30 THEN 'fee' ELSE 'ok' END AS decision FROM ledger",
)
def _(spark, sf):
    decision = F.when(F.col("qty") <= 0, "no_quantity").when(F.col("notional") > 80000, "notional").when(F.col("confidence") < 0.2, "confidence").when(F.col("fee") > 30, "fee").otherwise("ok")
    return a.ledger(spark, sf).select("trade_id", decision.alias("decision"))


@query(
    "u1_dedupe_conflict",
    f"""WITH {f.LEDGER}, k AS (SELECT candidate_id, CAST(exit_ts AS DATE) AS day, flag, round(confidence * 10) AS level FROM ledger) ---
SELECT candidate_id, day, flag, count(*) AS rows, count(DISTINCT level) AS versions FROM k GROUP BY candidate_id, day, flag HAVING count(DISTINCT level) > 1""",
)
def _(spark, sf):
    rows = a.ledger(spark, sf).select("candidate_id", F.to_date("exit_ts").alias("day"), "flag", F.round(F.col("confidence") * 10).alias("level"))
    return rows.groupBy("candidate_id", "day", "flag").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("level").alias("versions")).where("versions > 1")


@query(
    "u2_month_sets",
    f"""WITH {f.LEDGER}, m AS (SELECT DISTINCT candidate_id, strftime(exit_ts, '%Y-%m') AS month FROM ledger WHERE pnl > 3500), one AS (SELECT month FROM m WHERE candidate_id = 1), two AS (SELECT month FROM m WHERE candidate_id = 2) ---
SELECT 'both' AS kind, month FROM (SELECT month FROM one INTERSECT SELECT month FROM two) UNION ALL SELECT 'any', month FROM (SELECT month FROM one UNION SELECT month FROM two) UNION ALL SELECT 'only_first', month FROM (SELECT month FROM one EXCEPT SELECT month FROM two)""",
)
def _(spark, sf):
    rows = a.ledger(spark, sf).where("pnl > 3500").select("candidate_id", F.date_format("exit_ts", "yyyy-MM").alias("month")).distinct()
    one, two = (rows.where(F.col("candidate_id") == k).select("month") for k in (1, 2))
    parts = {"both": one.intersect(two), "any": one.union(two).distinct(), "only_first": one.subtract(two)}
    kinds = [df.select(F.lit(k).alias("kind"), "month") for k, df in parts.items()]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(
    "u6_resume",
    f"WITH {f.LEDGER}, planned AS (SELECT DISTINCT candidate_id, flag, side FROM ledger), done AS (SELECT candidate_id, flag, side FROM ledger GROUP BY candidate_id, flag, side HAVING sum(pnl) > 0) --- SELECT p.candidate_id, p.flag, p.side FROM planned p ANTI JOIN done d ON p.candidate_id = d.candidate_id AND p.flag = d.flag AND p.side = d.side",
)
def _(spark, sf):
    keys = ["candidate_id", "flag", "side"]
    rows = a.ledger(spark, sf).groupBy(*keys).agg(F.sum("pnl").alias("net"))
    return rows.select(*keys).join(rows.where("net > 0").select(*keys), keys, "left_anti")


@query(
    "j12_grid_completeness",
    f"""WITH {f.LEDGER}, have AS (SELECT DISTINCT candidate_id, CAST(exit_ts AS DATE) AS day FROM ledger), grid AS (SELECT c.candidate_id, d.day FROM (SELECT DISTINCT candidate_id FROM have) c, (SELECT DISTINCT day FROM have) d) --- SELECT g.candidate_id, g.day FROM grid g ANTI JOIN have h ON g.candidate_id = h.candidate_id AND g.day = h.day""",
)
def _(spark, sf):
    have = a.ledger(spark, sf).select("candidate_id", F.to_date("exit_ts").alias("day")).distinct()
    grid = have.select("day").distinct().crossJoin(F.broadcast(have.select("candidate_id").distinct()))  # candidates: a fixed list of ten
    return grid.join(have, ["candidate_id", "day"], "left_anti").select("candidate_id", "day")


@query("k6_latest_state", f"WITH {f.TICKS} --- SELECT symbol, ts, trade_id, price FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, trade_id DESC) = 1", ["price"])
def _(spark, sf):
    rows = a.ticks(spark, sf).groupBy("symbol").agg(F.max(F.struct("ts", "trade_id", "price")).alias("m"))
    return rows.select("symbol", "m.ts", "m.trade_id", "m.price")


@query(
    "l10_recent_rows",
    f"WITH {f.BARS} --- SELECT symbol, opened_at, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY opened_at DESC) <= 24",
    ["close"],
)
def _(spark, sf):
    order = Window.partitionBy("symbol").orderBy(F.desc("opened_at"))
    return a.bars_1h(spark, sf).withColumn("rn", F.row_number().over(order)).where("rn <= 24").select("symbol", "opened_at", "close")


@query(
    "a37_source_coverage",
    f"""WITH {f.BARS}, {f.FUNDING}, {f.METRICS}, j AS (SELECT b.symbol, EXISTS (SELECT 1 FROM metrics m WHERE m.symbol = b.symbol AND m.metric_at = b.closed_at) AS has_metrics,
  EXISTS (SELECT 1 FROM funding x WHERE x.symbol = b.symbol AND date_trunc('hour', x.funding_at) = b.opened_at) AS has_funding FROM bars b) ---
SELECT 'metrics' AS source, count(*) FILTER (has_metrics) AS available, count(*) FILTER (NOT has_metrics) AS unavailable FROM j UNION ALL SELECT 'funding', count(*) FILTER (has_funding), count(*) FILTER (NOT has_funding) FROM j""",
)
def _(spark, sf):
    bars = a.bars_1h(spark, sf).select("symbol", "opened_at", "closed_at")
    m = a.metrics(spark, sf).select("symbol", F.col("metric_at").alias("closed_at"), F.lit(1).alias("metrics"))
    x = a.funding(spark, sf).select("symbol", F.date_trunc("hour", "funding_at").alias("opened_at"), F.lit(1).alias("funding")).distinct()
    rows = bars.join(m, ["symbol", "closed_at"], "left").join(x, ["symbol", "opened_at"], "left")
    rows = rows.select(F.explode(F.create_map(F.lit("metrics"), F.col("metrics"), F.lit("funding"), F.col("funding"))).alias("source", "has"))
    return rows.groupBy("source").agg(F.count("has").alias("available"), F.count(F.when(F.col("has").isNull(), 1)).alias("unavailable"))


@query(
    "a16_worst_14_days",
    f"""WITH {DAILY}, n AS (SELECT *, lag(day, 13) OVER w AS first, {compounded("(pnl / 1000000.0)", " OVER (PARTITION BY candidate_id ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")} AS block FROM days WINDOW w AS (PARTITION BY candidate_id ORDER BY day)) ---
SELECT candidate_id, min(block) AS worst, count(*) AS blocks FROM n WHERE day - first = 13 GROUP BY candidate_id""",
    ["worst"],
)
def _(spark, sf):
    return p.worst_block(p.daily(a.ledger(spark, sf)), 14)


@query(
    "a36_exposure",
    f"""WITH {f.LEDGER}, d AS (SELECT candidate_id, CAST(exit_ts AS DATE) AS day, sum(pnl) AS pnl, sum(notional) AS notional, count(*) AS trades, count(*) FILTER (abs(ret) > 0.045) AS odd FROM ledger GROUP BY ALL),
e AS (SELECT *, 1000000.0 + coalesce(sum(pnl) OVER (PARTITION BY candidate_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) ---
SELECT candidate_id, max(greatest(0, -pnl) / before) AS worst_day_ratio, max(notional / before) AS largest_exposure, count(*) FILTER (notional / before > 0.5) AS days_over_limit, sum(odd) / sum(trades) AS anomaly_rate FROM e GROUP BY candidate_id""",
    ["worst_day_ratio", "largest_exposure", "anomaly_rate"],
)
def _(spark, sf):
    return p.exposure(a.ledger(spark, sf), 0.5, 0.045)


@query(
    "a39_diagnostics",
    f"""WITH {f.LEDGER}, t AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY pnl DESC, trade_id) AS rn FROM ledger), d AS (SELECT candidate_id, date_diff('day', min(CAST(exit_ts AS DATE)), max(CAST(exit_ts AS DATE))) + 1 AS span, count(DISTINCT CAST(exit_ts AS DATE)) AS active FROM ledger GROUP BY candidate_id) ---
SELECT candidate_id, any_value(1 - active / span) AS cash_share, sum(2 * notional + pnl) AS turnover, sum(CASE WHEN rn <= 5 AND pnl > 0 THEN pnl ELSE 0 END) / nullif(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END), 0) AS top_5_share, count(*) / (SELECT count(*) FROM ledger) AS trade_share FROM t JOIN d USING (candidate_id) GROUP BY candidate_id""",
    ["cash_share", "turnover", "top_5_share", "trade_share"],
)
def _(spark, sf):
    return p.diagnostics(a.ledger(spark, sf))
