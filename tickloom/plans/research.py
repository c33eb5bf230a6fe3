"""Simulation, inference, clustering, archive and streaming queries (rows only where SQL has no form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, inference, mixtures, patterns, performance, ranking, signals, simulation
from ..operators.recursive import smooth
from ..operators.windows import full, true_range
from ..sources import adapters as a
from ..sources import archives
from ..streaming import jobs
from . import fragments as f
from .registry import query

POLICIES = [
    simulation.Policy("fixed", stop=0.3, target=0.6),
    simulation.Policy("time", exit="time", stop=0.3, target=0.6, max_bars=12),
    simulation.Policy("atr", exit="atr", stop=1.5, target=3.0),
    simulation.Policy("trailing", exit="trailing", stop=0.3, trail=0.2),
    simulation.Policy("partial", exit="partial_trailing", stop=0.3, target=0.4, trail=0.2),
    simulation.Policy("guarded", stop=0.3, target=0.6, max_bars=24, spacing=4, daily_cap=3, loss_run=3, pause=24, peak_loss=0.5, daily_loss=0.1, by_confidence=True),
]


def with_atr(bars, w: int = 14):
    return smooth(bars.withColumn("tr", true_range()), {"atr": ("tr", 1 / w, w)})


def burst_signals(spark, sf):
    return signals.momentum_burst(with_atr(a.bars_1h(spark, sf)))


@query("b1_backtest")
def _(spark, sf):
    return simulation.simulate(burst_signals(spark, sf), POLICIES[:1])


@query("b3_scheduler_guarded")
def _(spark, sf):
    return simulation.simulate(burst_signals(spark, sf), POLICIES[5:])


@query("b6_exit_models")
def _(spark, sf):
    trades = simulation.simulate(burst_signals(spark, sf), POLICIES[:5])
    return trades.groupBy("policy_id", "symbol").agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("net"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), F.avg("held").alias("held"), F.max("adverse").alias("worst_adverse"))


@query("b7_regime_routed")
def _(spark, sf):
    bars = with_atr(a.bars_1h(spark, sf))
    regime = bars.select("symbol", "closed_at", F.when(full(F.stddev_pop("close"), 24) > full(F.stddev_pop("close"), 120), "loud").when(full(F.avg("close"), 24).isNotNull(), "calm").otherwise("none").alias("regime"))
    rows = simulation.routed({"burst": signals.momentum_burst(bars), "edge": signals.range_edge(bars)}, regime, {"loud": "burst", "calm": "edge"})
    return simulation.simulate(rows.select(*[c for c in bars.columns], "direction", "confidence"), POLICIES[1:2])


@query(
    "c16_grid",
    "--- SELECT stop, target, CAST(h AS INTEGER) AS max_bars, count(*) OVER () AS n FROM (VALUES (0.1::DOUBLE), (0.2), (0.3)) s(stop), (VALUES (0.2::DOUBLE), (0.4)) t(target), (VALUES (0), (12), (24)) h(h), (SELECT count(*) AS c FROM region) WHERE target > stop AND c > 0",
    ["stop", "target"],
)
def _(spark, sf):
    grid = a.read(spark, sf, "region").agg(F.count(F.lit(1)).alias("c")).where("c > 0")
    for name, values in (("stop", [0.1, 0.2, 0.3]), ("target", [0.2, 0.4]), ("max_bars", [0, 12, 24])):
        grid = grid.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    grid = grid.where("target > stop").drop("c")
    return grid.join(grid.agg(F.count(F.lit(1)).alias("n")).hint("broadcast"))


def draws_sql(draws: int, blocks: str, name: str = "draws") -> str:
    """Uniform numbers by draw and block, as a CTE (draw, us)."""
    return f"""{name} AS (SELECT draw, list(CAST(('0x' || substr(md5('{bootstrap.SEED}:' || draw || ':' || b), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE ORDER BY b) AS us
  FROM (SELECT unnest(range(0, {draws})) AS draw), (SELECT unnest(range(0, CAST(({blocks}) AS BIGINT))) AS b) GROUP BY draw)"""


SHARES_SQL = f"""WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS k FROM orders GROUP BY ALL),
top AS (SELECT o_orderpriority, month, o_orderstatus AS status FROM m QUALIFY row_number() OVER (PARTITION BY o_orderpriority, month ORDER BY k DESC, o_orderstatus) = 1),
ser AS (SELECT o_orderpriority, list(status ORDER BY month) AS labels, count(*) AS n, CAST(ceil(count(*) / 3.0) AS BIGINT) AS blocks FROM top GROUP BY o_orderpriority),
lab AS (SELECT ser.*, n - 3 * (blocks - 1) AS tail, unnest(list_distinct(labels)) AS status FROM ser),
hit AS (SELECT *, list_transform(labels, lambda v: CAST(v = status AS INTEGER)) AS hits FROM lab),
blk AS (SELECT *, list_transform(range(0, n), lambda i: list_sum(list_transform(range(0, 3), lambda k: hits[(i + k) % n + 1]))) AS whole, list_transform(range(0, n), lambda i: list_sum(list_transform(range(0, tail), lambda k: hits[(i + k) % n + 1]))) AS last FROM hit),
{draws_sql(5000, "SELECT max(blocks) FROM ser")},
d AS (SELECT o_orderpriority, status, list_sum(hits) / n AS share, (coalesce(list_sum(list_transform(us[1:blocks - 1], lambda u: whole[CAST(floor(u * n) AS BIGINT) + 1])), 0) + last[CAST(floor(us[blocks] * n) AS BIGINT) + 1]) / n AS value FROM blk, draws),
q AS (SELECT o_orderpriority, status, any_value(share) AS share, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM d GROUP BY o_orderpriority, status) ---
SELECT o_orderpriority, status, share, greatest(0, least(lo, share)) AS low, least(1, greatest(hi, share)) AS high FROM q"""


@query("c6_share_intervals", SHARES_SQL, ["share", "low", "high"])
def _(spark, sf):
    rows = a.read(spark, sf, "orders").groupBy("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderstatus").agg(F.count(F.lit(1)).alias("k"))
    top = rows.groupBy("o_orderpriority", "month").agg(F.min_by("o_orderstatus", F.struct(-F.col("k"), "o_orderstatus")).alias("status"))
    return bootstrap.share_intervals(top, "o_orderpriority", "month", "status")


#: Weekly returns of a candidate in a regime (the return flag) with their bounds.
BOUNDS_SQL = f"""{f.LEDGER}, wk AS (SELECT flag, candidate_id, date_trunc('week', exit_ts) AS week, sum(ret) AS v, count(*) AS trades FROM ledger GROUP BY ALL),
mt AS (SELECT flag, candidate_id, count(DISTINCT m) AS months FROM (SELECT flag, candidate_id, unnest([strftime(week, '%Y-%m'), strftime(week + INTERVAL '7 days' - INTERVAL '1 microsecond', '%Y-%m')]) AS m FROM wk) GROUP BY ALL),
nb AS (SELECT *, coalesce(week - lag(week) OVER w = INTERVAL '7 days', false) AS after, coalesce(lead(week) OVER w - week = INTERVAL '7 days', false) AS before, lead(v) OVER w AS v1 FROM wk WINDOW w AS (PARTITION BY flag, candidate_id ORDER BY week)),
ev AS (SELECT flag, candidate_id, count(*) AS n, CAST(sum(trades) AS BIGINT) AS trades, avg(v) AS mean, median(v) AS median, bool_and(before OR after) AS adjacent, list(v + v1 ORDER BY week) FILTER (before) AS pair, list(v ORDER BY week) FILTER (before) AS single FROM nb GROUP BY ALL),
en AS (SELECT ev.*, months, n >= 8 AND months >= 3 AND trades >= 30 AND adjacent AS enough FROM ev JOIN mt USING (flag, candidate_id)),
{draws_sql(2000, "SELECT coalesce(max(ceil(n / 2.0)), 1) FROM en WHERE enough")},
dr AS (SELECT flag, draw, max((coalesce(list_sum(list_transform(us[1:n // 2], lambda u: pair[CAST(least(floor(u * len(pair)), len(pair) - 1) AS BIGINT) + 1])), 0) + CASE WHEN n % 2 = 1 THEN single[CAST(least(floor(us[n // 2 + 1] * len(single)), len(single) - 1) AS BIGINT) + 1] ELSE 0 END) / n - mean) AS top FROM en, draws WHERE enough GROUP BY flag, draw),
cr AS (SELECT flag, list_sort(list(top))[1900] AS critical FROM dr GROUP BY flag),
bd AS (SELECT en.flag, candidate_id, n, months, trades, mean, median, adjacent, enough, CASE WHEN enough THEN mean - critical ELSE 0.0 END AS bound FROM en LEFT JOIN cr USING (flag))"""


def weeks(spark, sf):
    return bootstrap.weeks_of(a.ledger(spark, sf), "flag", "candidate_id", "exit_ts", "ret")


@query("c7_weekly_bounds", f"WITH {BOUNDS_SQL} --- SELECT flag, candidate_id, n, months, trades, mean, adjacent, enough, bound FROM bd", ["mean", "bound"])
def _(spark, sf):
    return bootstrap.bounds_of_weeks(weeks(spark, sf), "flag", "candidate_id").withColumn("n", F.col("n").cast("long")).withColumn("months", F.col("months").cast("long"))


@query("c8_daily_bounds")
def _(spark, sf):
    days = performance.daily(a.ledger(spark, sf)).withColumn("family", F.lit("all")).withColumn("ret", F.col("pnl") / performance.CASH)
    return inference.family_bounds(days, "family", "candidate_id", "day", "ret", block=7, draws=500)


@query(
    "c9_mapping",
    f"""WITH {BOUNDS_SQL}, rs AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in bootstrap.REASONS.items())}], lambda x: x IS NOT NULL) AS failed FROM bd),
best AS (SELECT flag, candidate_id, bound FROM rs WHERE len(failed) = 0 QUALIFY row_number() OVER (PARTITION BY flag ORDER BY bound DESC, median DESC, mean DESC, candidate_id) = 1),
al AS (SELECT flag, flatten(list(failed)) AS failed FROM rs GROUP BY flag) ---
SELECT al.flag, CASE WHEN candidate_id IS NULL THEN 'cash' ELSE 'strategy' END AS decision, candidate_id, coalesce(bound, 0.0) AS bound, CASE WHEN candidate_id IS NULL THEN array_to_string(list_filter([{", ".join(f"'{n}'" for n in bootstrap.REASONS)}], lambda n: list_contains(failed, n)), ',') ELSE '' END AS reasons FROM al LEFT JOIN best USING (flag)""",
    ["bound"],
)
def _(spark, sf):
    rows, key = weeks(spark, sf), ("flag", "candidate_id")
    return bootstrap.weekly_mapping(bootstrap.bounds_of_weeks(rows, *key), bootstrap.weekly_medians(rows, *key), *key)


@query(
    "l8_weekly_ranks",
    f"WITH {BOUNDS_SQL} --- SELECT flag, candidate_id, bound, row_number() OVER (PARTITION BY flag ORDER BY bound DESC, median DESC, mean DESC, candidate_id) AS place FROM bd WHERE enough",
    ["bound"],
)
def _(spark, sf):
    own, key = weeks(spark, sf), ["flag", "candidate_id"]
    rows = bootstrap.bounds_of_weeks(own, *key).where("enough").join(bootstrap.weekly_medians(own, *key), key)
    rows = rows.select("flag", "candidate_id", "bound", F.col("bound").alias("lower_bound"), F.col("median").alias("median_return"), F.col("mean").alias("mean_return"))
    return ranking.ranked(rows, ranking.KEYS["weekly_winner"], "candidate_id", ["flag"]).select("flag", "candidate_id", "bound", "place")


@query("c12_selection")
def _(spark, sf):
    daily = a.ticks(spark, sf).groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("price").alias("level"), F.stddev_pop("price").alias("spread"))
    rows = daily.select("symbol", "day", F.when(F.col("level") > 50, 1).otherwise(0).alias("cluster"), (F.abs(F.col("level") - 50) > 2).alias("confident"))
    return inference.selection_states(rows, "symbol", "day", "cluster", "confident")


@query(
    "w14_pivots",
    f"""WITH {f.BARS}, p AS (SELECT symbol, opened_at, high, low, count(*) OVER w = 7 AND high = max(high) OVER w AS pivot_high, count(*) OVER w = 7 AND low = min(low) OVER w AS pivot_low FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) ---
SELECT symbol, opened_at, high, low, pivot_high, pivot_low FROM p WHERE pivot_high OR pivot_low""",
    ["high", "low"],
)
def _(spark, sf):
    return inference.pivots(a.bars_1h(spark, sf)).where("pivot_high or pivot_low").select("symbol", "opened_at", "high", "low", "pivot_high", "pivot_low")


@query("t28_chart_patterns")
def _(spark, sf):
    return patterns.chart_patterns(a.bars_1h(spark, sf))


@query("c1_kmeans")
def _(spark, sf):
    rows, limits = mixtures.kmeans(a.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").alias("x")), 8)
    return rows.join(F.broadcast(limits), "cluster").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("limit"), F.count(F.when(F.col("distance") > F.col("limit"), 1)).alias("outside"))


PLAN_SQL = """WITH r AS (SELECT event_type AS symbol, date_trunc('hour', min(ts)) - INTERVAL '40 days' AS s, date_trunc('hour', max(ts)) AS e FROM events GROUP BY event_type),
m AS (SELECT symbol, s, e, CAST(unnest(generate_series(date_trunc('month', s), date_trunc('month', e - INTERVAL '1 microsecond'), INTERVAL '1 month')) AS DATE) AS month FROM r),
x AS (SELECT m.*, v.source, strftime(month, '%Y-%m') >= '2024-01' AS current FROM m, (VALUES ('klines'), ('fundingRate'), ('metrics')) v(source) WHERE NOT (v.source = 'fundingRate' AND strftime(month, '%Y-%m') >= '2024-01')),
y AS (SELECT *, source = 'metrics' OR (current AND source <> 'fundingRate') AS daily FROM x),
z AS (SELECT source, symbol, 'daily' AS grain, strftime(unnest(generate_series(greatest(CAST(s AS DATE), month), least(CAST(e - INTERVAL '1 microsecond' AS DATE), CAST(last_day(month) AS DATE)), INTERVAL '1 day')), '%Y-%m-%d') AS period FROM y WHERE daily
  UNION ALL SELECT source, symbol, 'monthly', strftime(month, '%Y-%m') FROM y WHERE NOT daily) ---
SELECT DISTINCT source, symbol, period, grain, grain || '/' || source || '/' || symbol || '/' || symbol || '-' || source || '-' || period AS path FROM z"""


@query("s2_archive_plan", PLAN_SQL)
def _(spark, sf):
    rows = a.read(spark, sf, "events").groupBy(F.col("event_type").alias("symbol")).agg((F.date_trunc("hour", F.min("ts")) - F.expr("interval 40 days")).alias("start"), F.date_trunc("hour", F.max("ts")).alias("end"))
    return archives.plan(rows, ["klines", "fundingRate", "metrics"], "2024-01")


@query(
    "s5_violations",
    f"""WITH {f.BARS}, b AS (SELECT symbol, opened_at, open, CASE WHEN trades % 7 = 0 THEN low - 1 ELSE high END AS high, low, close, CASE WHEN trades % 5 = 0 THEN -volume ELSE volume END AS volume FROM bars),
v AS (SELECT symbol, opened_at, list_filter([CASE WHEN least(open, high, low, close) <= 0 THEN 'not_positive' END, CASE WHEN greatest(open, close) > high OR least(open, close) < low THEN 'outside_range' END, CASE WHEN volume < 0 THEN 'negative_volume' END], lambda x: x IS NOT NULL) AS broken FROM b) ---
SELECT symbol, opened_at, array_to_string(broken, ',') AS broken FROM v WHERE len(broken) > 0""",
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf)
    rows = rows.withColumn("high", F.when(F.col("trades") % 7 == 0, F.col("low") - 1).otherwise(F.col("high"))).withColumn("volume", F.when(F.col("trades") % 5 == 0, -F.col("volume")).otherwise(F.col("volume")))
    return archives.violations(rows).select("symbol", "opened_at", F.array_join("broken", ",").alias("broken"))


@query(
    "stream_bars",
    f"WITH {f.BARS} --- SELECT * FROM bars WHERE closed_at <= (SELECT max(ts) FROM ticks) - INTERVAL '10 minutes'",
    ["open", "high", "low", "close", "volume"],
)
def _(spark, sf):
    return jobs.run_to_end(jobs.stream_bars(jobs.tick_stream(spark, f"{sf}/events.parque[t]"), "1 hour", "10 minutes"))


@query(
    "stream_sliding_bars",
    f"""WITH {f.TICKS}, w AS (SELECT *, unnest(generate_series(time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01') - INTERVAL '3 hours', time_bucket(INTERVAL '1 hour', ts, TIMESTAMP '1970-01-01'), INTERVAL '1 hour')) AS opened_at FROM ticks) ---
SELECT symbol, opened_at, opened_at + INTERVAL '4 hours' AS closed_at, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close, sum(qty) AS volume, count(*) AS trades
FROM w WHERE opened_at + INTERVAL '4 hours' <= (SELECT max(ts) FROM ticks) - INTERVAL '10 minutes' GROUP BY symbol, opened_at""",
    ["open", "high", "low", "close", "volume"],
)
def _(spark, sf):
    return jobs.run_to_end(jobs.stream_bars(jobs.tick_stream(spark, f"{sf}/events.parque[t]"), "4 hours", "10 minutes", "1 hour"))


@query(
    "stream_position",
    f"""WITH RECURSIVE {f.TICKS}, fl AS (SELECT symbol, ts, price, CASE WHEN trade_id % 2 = 0 THEN qty ELSE -qty END AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS rn FROM ticks),
po AS (SELECT symbol, rn, ts, x AS q, price AS e, 0.0::DOUBLE AS r FROM fl WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn, n.ts, p.q + n.x, CASE WHEN p.q = 0 OR (p.q > 0) = (n.x > 0) THEN (abs(p.q) * p.e + abs(n.x) * n.price) / (abs(p.q) + abs(n.x)) WHEN p.q + n.x = 0 THEN 0 WHEN (p.q + n.x > 0) = (n.x > 0) THEN n.price ELSE p.e END,
    p.r + CASE WHEN p.q = 0 OR (p.q > 0) = (n.x > 0) THEN 0 ELSE least(abs(n.x), abs(p.q)) * (n.price - p.e) * sign(p.q) END FROM po p JOIN fl n ON n.symbol = p.symbol AND n.rn = p.rn + 1) ---
SELECT symbol, rn AS fills, CASE WHEN q > 0 THEN 'long' WHEN q < 0 THEN 'short' ELSE 'flat' END AS side, abs(q) AS quantity, e AS entry, r AS realized, ts AS last_at FROM po QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1""",
    ["quantity", "entry", "realized"],
)
def _(spark, sf):
    fills = jobs.tick_stream(spark, f"{sf}/events.parque[t]").withColumn("buy", F.col("trade_id") % 2 == 0)
    path = jobs.folder(spark)
    jobs.run_positions(fills, path)
    return jobs.positions(spark, path)


@query(
    "k1_cache_summary",
    f"WITH {f.BARS}, {f.FUNDING}, j AS (SELECT b.symbol, b.closed_at, b.close, CASE WHEN b.closed_at - funding_at <= INTERVAL '8 hours' THEN rate END AS rate FROM bars b ASOF LEFT JOIN funding x ON b.symbol = x.symbol AND b.closed_at >= x.funding_at) --- SELECT symbol, count(*) AS rows, min(closed_at) AS first_at, max(closed_at) AS last_at, count(rate) AS with_rate FROM j GROUP BY symbol",
)
def _(spark, sf):
    from ..operators.asof import asof_join
    from ..sources.sinks import feature_cache

    left = a.bars_1h(spark, sf).select("symbol", "closed_at", "close")
    rows = asof_join(left, a.funding(spark, sf), ["symbol"], "closed_at", "funding_at", 8 * 3600)
    cached = feature_cache(rows, jobs.folder(spark), "symbol")
    return cached.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("closed_at").alias("first_at"), F.max("closed_at").alias("last_at"), F.count("rate").alias("with_rate"))


@query(
    "k2_ledger_append",
    f"WITH {f.LEDGER}, k AS (SELECT candidate_id, CAST(exit_ts AS DATE) AS day, sum(pnl) AS pnl, count(*) AS trades FROM ledger GROUP BY candidate_id, CAST(exit_ts AS DATE)) --- SELECT * FROM k",
    ["pnl"],
)
def _(spark, sf):
    from ..sources.sinks import append_new

    days = performance.daily(a.ledger(spark, sf))
    path = f"{jobs.folder(spark)}/ledger"
    append_new(days.where("day < '1998-01-01'"), path, ["candidate_id", "day"])
    append_new(days, path, ["candidate_id", "day"])
    append_new(days, path, ["candidate_id", "day"])
    return spark.read.schema(days.schema).parquet(path)
