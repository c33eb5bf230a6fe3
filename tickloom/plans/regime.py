"""Chart features, profiles, cluster and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chart_blocks, features, profile, stats
from ..operators.bars import bars_of, dense_bars
from ..operators.recursive import hysteresis
from ..operators.windows import full, shift
from ..sources import adapters as a
from . import fragments as f
from .registry import query

O3 = "PARTITION BY symbol, anchor_at ORDER BY opened_at"
FEATURES_SQL = f"""WITH {f.DENSE}, an AS (SELECT DISTINCT symbol, date_trunc('day', opened_at + INTERVAL '15 minutes') AS anchor_at FROM dense),
w0 AS (SELECT d.*, an.anchor_at FROM an JOIN dense d ON d.symbol = an.symbol AND d.opened_at >= an.anchor_at - INTERVAL '3 days' AND d.opened_at < an.anchor_at
  QUALIFY count(*) OVER (PARTITION BY d.symbol, an.anchor_at) = 288),
w1 AS (SELECT *, 289 - row_number() OVER ({O3}) AS age, coalesce(lag(close) OVER ({O3}), open) AS before, first_value(open) OVER ({O3}) AS start FROM w0),
w2 AS (SELECT *, ln(close / before) AS r, close - before AS step, high - low AS span, greatest(start, max(close) OVER ({O3})) AS peak, least(start, min(close) OVER ({O3})) AS trough,
  CASE WHEN count(*) OVER p = 96 THEN CAST(close > max(high) OVER p OR close < min(low) OVER p AS INTEGER) END AS outside,
  row_number() OVER (PARTITION BY symbol, anchor_at ORDER BY volume DESC, age) AS vrank
  FROM w1 WINDOW p AS ({O3} ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)),
w3 AS (SELECT *, lag(r) OVER ({O3}) AS r0, lag(step) OVER ({O3}) AS s0, max(CASE WHEN age = 1 THEN close END) OVER (PARTITION BY symbol, anchor_at) AS c FROM w2) ---
SELECT symbol, anchor_at,
  any_value(c) / max(CASE WHEN age = 16 THEN open END) - 1 AS ret_4h, any_value(c) / max(CASE WHEN age = 48 THEN open END) - 1 AS ret_12h,
  any_value(c) / max(CASE WHEN age = 96 THEN open END) - 1 AS ret_1d, any_value(c) / max(CASE WHEN age = 288 THEN open END) - 1 AS ret_full,
  stddev_pop(CASE WHEN age <= 16 THEN r END) AS rv_4h, stddev_pop(CASE WHEN age <= 96 THEN r END) AS rv_1d, stddev_pop(r) AS rv_full,
  stddev_pop(CASE WHEN age <= 96 THEN r END) / stddev_pop(r) AS rv_ratio, (max(high) - min(low)) / any_value(c) AS range_ratio,
  (any_value(c) - min(low)) / (max(high) - min(low)) AS close_location,
  abs(sum(CASE WHEN age <= 96 THEN step END)) / sum(CASE WHEN age <= 96 THEN abs(step) END) AS efficiency_1d, abs(sum(step)) / sum(abs(step)) AS efficiency_full,
  count(*) FILTER (step * s0 < 0) / count(*) FILTER (step * s0 <> 0) AS sign_change_full, corr(CASE WHEN r0 IS NOT NULL THEN r END, r0) AS autocorr_full,
  max((peak - close) / peak) AS max_drawdown, max((close - trough) / trough) AS max_runup, avg(outside) AS breakout_rate,
  avg(coalesce(abs(close - open) / nullif(span, 0), 0)) AS body_ratio, avg(coalesce((high - greatest(open, close)) / nullif(span, 0), 0)) AS upper_wick,
  avg(coalesce((least(open, close) - low) / nullif(span, 0), 0)) AS lower_wick, stddev_pop(volume) / avg(volume) AS volume_cv,
  sum(CASE WHEN vrank <= 29 THEN volume END) / sum(volume) AS top_decile_volume, avg(CASE WHEN age <= 96 THEN volume END) / avg(volume) AS volume_ratio
FROM w3 GROUP BY symbol, anchor_at"""


@query("f_registry_3d", FEATURES_SQL, list(features.NAMES))
def _(spark, sf):
    return features.registry(a.bars_15m(spark, sf))


def _path_sql(k: int) -> str:
    """Features of the path over the last k bars of 15 minutes, which begins with the first of their opens."""
    return f"""p{k} AS (SELECT symbol, anchor_at, first_value(open) OVER w AS start, close, coalesce(lag(close) OVER w, open) AS p, opened_at FROM w15 WHERE age <= {k} WINDOW w AS ({O3})),
q{k} AS (SELECT *, close / p - 1 AS x, greatest(start, max(close) OVER w) AS peak, least(start, min(close) OVER w) AS trough FROM p{k} WINDOW w AS ({O3})),
s{k} AS (SELECT *, lag(x) OVER ({O3}) AS x0 FROM q{k}),
f{k} AS (SELECT symbol, anchor_at, arg_max(close, opened_at) / any_value(start) - 1 AS ret, stddev_pop(ln(close / p)) AS rv, abs(arg_max(close, opened_at) - any_value(start)) / nullif(sum(abs(close - p)), 0) AS eff,
  CAST(count(*) FILTER (x * x0 < 0) AS DOUBLE) / nullif(count(*) FILTER (x <> 0 AND x0 <> 0), 0) AS turns, corr(x, x0) AS ac, least(0, min(close / peak - 1)) AS dd, greatest(0, max(close / trough - 1)) AS ru FROM s{k} GROUP BY symbol, anchor_at)"""


DENSE_SYMBOLS = f.DENSE.replace("SELECT 'ALL' AS symbol,", "SELECT symbol,")
WEEK_SQL = f"""WITH {DENSE_SYMBOLS}, an AS (SELECT DISTINCT symbol, time_bucket(INTERVAL '4 hours', opened_at, TIMESTAMP '1970-01-01') + INTERVAL '4 hours' AS anchor_at FROM dense),
w15 AS (SELECT d.*, an.anchor_at, row_number() OVER (PARTITION BY d.symbol, an.anchor_at ORDER BY d.opened_at DESC) AS age FROM an JOIN dense d ON d.symbol = an.symbol AND d.opened_at >= an.anchor_at - INTERVAL '7 days' AND d.opened_at < an.anchor_at
  QUALIFY count(*) OVER (PARTITION BY d.symbol, an.anchor_at) = 672 AND min(d.opened_at) OVER (PARTITION BY d.symbol, an.anchor_at) = an.anchor_at - INTERVAL '7 days'),
{", ".join(_path_sql(k) for k in (16, 48, 96, 288, 672))},
h0 AS (SELECT symbol, date_trunc('hour', opened_at) AS hour, arg_min(open, opened_at) AS open, max(high) AS high, min(low) AS low, arg_max(close, opened_at) AS close, sum(volume) AS volume FROM dense GROUP BY ALL HAVING count(*) = 4),
h1 AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY hour) AS c0 FROM h0),
wh AS (SELECT h.*, an.anchor_at, row_number() OVER (PARTITION BY h.symbol, an.anchor_at ORDER BY h.hour DESC) AS age FROM (SELECT DISTINCT symbol, anchor_at FROM w15) an JOIN h1 h ON h.symbol = an.symbol AND h.hour >= an.anchor_at - INTERVAL '7 days' AND h.hour < an.anchor_at),
wi AS (SELECT *, greatest(high - low, abs(high - CASE WHEN age = 168 THEN open ELSE c0 END), abs(low - CASE WHEN age = 168 THEN open ELSE c0 END)) AS tr, CASE WHEN age <= 144 THEN CAST(close > max(high) OVER w OR close < min(low) OVER w AS INTEGER) END AS broke,
  row_number() OVER (PARTITION BY symbol, anchor_at ORDER BY volume DESC, age) AS vrank FROM wh WINDOW w AS (PARTITION BY symbol, anchor_at ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
fh AS (SELECT symbol, anchor_at, arg_max(close, hour) AS c, sum(CASE WHEN age <= 24 THEN tr END) / 24 AS atr1, avg(tr) AS atr7, max(high) AS hi, min(low) AS lo, avg(broke) AS br, avg(coalesce(abs(close - open) / nullif(high - low, 0), 0)) AS body,
  avg(coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)) AS upper, avg(coalesce((least(open, close) - low) / nullif(high - low, 0), 0)) AS lower, stddev_pop(volume) / nullif(avg(volume), 0) AS cv,
  sum(CASE WHEN vrank <= 17 THEN volume END) / nullif(sum(volume), 0) AS top, avg(CASE WHEN age <= 24 THEN volume END) / nullif(avg(volume), 0) AS vr FROM wi GROUP BY symbol, anchor_at) ---
SELECT symbol, anchor_at, f16.ret AS return_4h, f48.ret AS return_12h, f96.ret AS return_1d, f288.ret AS return_3d, f672.ret AS return_7d, f16.rv AS rv_4h, f96.rv AS rv_1d, f672.rv AS rv_7d, f96.rv / nullif(f672.rv, 0) AS rv_ratio_1d_7d,
  atr1 / c AS atr_ratio_1d, atr7 / c AS atr_ratio_7d, (hi - lo) / c AS range_ratio_7d, (c - lo) / nullif(hi - lo, 0) AS close_location_7d, f96.eff AS directional_efficiency_1d, f672.eff AS directional_efficiency_7d,
  f96.turns AS sign_change_rate_1d, f672.turns AS sign_change_rate_7d, f96.ac AS return_autocorr_1d, f672.ac AS return_autocorr_7d, f672.dd AS max_drawdown_7d, f672.ru AS max_runup_7d, br AS breakout_rate_7d,
  body AS mean_body_ratio_7d, upper AS mean_upper_wick_ratio_7d, lower AS mean_lower_wick_ratio_7d, cv AS volume_cv_7d, top AS top_decile_volume_share_7d, vr AS volume_ratio_1d_7d
FROM fh JOIN f16 USING (symbol, anchor_at) JOIN f48 USING (symbol, anchor_at) JOIN f96 USING (symbol, anchor_at) JOIN f288 USING (symbol, anchor_at) JOIN f672 USING (symbol, anchor_at)
WHERE f96.turns IS NOT NULL AND f672.turns IS NOT NULL AND f96.ac IS NOT NULL AND NOT isnan(f96.ac) AND f672.ac IS NOT NULL AND NOT isnan(f672.ac) AND f96.eff IS NOT NULL AND f672.eff IS NOT NULL AND f672.rv > 0 AND hi > lo AND top IS NOT NULL"""


@query("f_registry_7d", WEEK_SQL, list(chart_blocks.NAMES))
def _(spark, sf):
    return chart_blocks.weekly_registry(dense_bars(bars_of(a.ticks(spark, sf), "15 minutes"), 900))


@query(
    "f13_spearman",
    f"""WITH {f.VECTORS}, k AS (SELECT *, rank() OVER (PARTITION BY dim ORDER BY x) + (count(*) OVER (PARTITION BY dim, x) - 1) / 2 AS rk FROM vectors) ---
SELECT CAST(a.dim AS INTEGER) AS a, CAST(b.dim AS INTEGER) AS b, corr(a.rk, b.rk) AS rho FROM k a JOIN k b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.dim, b.dim""",
    ["rho"],
)
def _(spark, sf):
    return features.rank_correlation(a.vectors(spark, sf))


@query(
    "f15_robust_scale",
    f"""WITH {f.VECTORS}, q AS (SELECT dim, quantile_cont(x, 0.005) AS lo, quantile_cont(x, 0.995) AS hi FROM vectors GROUP BY dim),
c AS (SELECT vec_id, v.dim, least(greatest(x, lo), hi) AS c FROM vectors v JOIN q ON q.dim = v.dim), s AS (SELECT dim, quantile_cont(c, 0.25) AS a, quantile_cont(c, 0.5) AS m, quantile_cont(c, 0.75) AS b FROM c GROUP BY dim) ---
SELECT vec_id, CAST(c.dim AS INTEGER) AS dim, (c - m) / CASE WHEN b > a THEN b - a ELSE 1 END AS z FROM c JOIN s ON s.dim = c.dim""",
    ["z"],
)
def _(spark, sf):
    return features.robust_scale(a.vectors(spark, sf))


PROFILE = f"""{f.BARS}, pb AS (SELECT symbol, CAST(opened_at AS DATE) AS day, volume / (floor(high / 5) - floor(low / 5) + 1) AS v, unnest(generate_series(CAST(floor(low / 5) AS BIGINT), CAST(floor(high / 5) AS BIGINT))) AS bin FROM bars),
prof AS (SELECT symbol, day, bin, sum(v) AS volume FROM pb GROUP BY symbol, day, bin)"""


@query("a4_volume_profile", f"WITH {PROFILE} --- SELECT * FROM prof", ["volume"])
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("day", F.to_date("opened_at"))
    return profile.volume_profile(rows, 5.0, ["symbol", "day"])


@query("a4_control_point", f"WITH {PROFILE} --- SELECT symbol, day, arg_max(bin, (round(volume, 9), -bin)) AS poc, sum(volume) AS total FROM prof GROUP BY symbol, day", ["total"])
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("day", F.to_date("opened_at"))
    return profile.control_point(profile.volume_profile(rows, 5.0, ["symbol", "day"]), ["symbol", "day"])


#: Grown bin by bin over the numbered bins of a profile.
AREA = f"""{PROFILE}, nb AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, day) AS m FROM prof WINDOW w AS (PARTITION BY symbol, day ORDER BY bin)),
pt AS (SELECT symbol, day, arg_max(i, (round(volume, 9), -bin)) AS i, sum(volume) AS total FROM nb GROUP BY symbol, day),
grown AS (SELECT pt.symbol, pt.day, pt.i AS a, pt.i AS b, n.volume AS v, total, n.m, 0 AS step FROM pt JOIN nb n ON n.symbol = pt.symbol AND n.day = pt.day AND n.i = pt.i UNION ALL
  SELECT g.symbol, g.day, CASE WHEN down THEN a - 1 ELSE a END, CASE WHEN down THEN b ELSE b + 1 END, v + CASE WHEN down THEN lv ELSE uv END, total, m, step + 1 FROM (
    SELECT g.*, l.volume AS lv, u.volume AS uv, a > 1 AND (b >= g.m OR round(l.volume, 9) >= round(u.volume, 9)) AS down FROM grown g LEFT JOIN nb l ON l.symbol = g.symbol AND l.day = g.day AND l.i = a - 1 LEFT JOIN nb u ON u.symbol = g.symbol AND u.day = g.day AND u.i = b + 1
    WHERE v < 0.7 * total - 0.000000001 AND (a > 1 OR b < g.m)) g),
area AS (SELECT e.symbol, e.day, p.bin AS poc, l.bin AS area_low, u.bin AS area_high, e.v AS area_volume, e.total FROM (SELECT * FROM grown QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY step DESC) = 1) e
  JOIN pt ON pt.symbol = e.symbol AND pt.day = e.day JOIN nb p ON p.symbol = e.symbol AND p.day = e.day AND p.i = pt.i JOIN nb l ON l.symbol = e.symbol AND l.day = e.day AND l.i = e.a JOIN nb u ON u.symbol = e.symbol AND u.day = e.day AND u.i = e.b)"""


@query("a5_value_area", f"WITH RECURSIVE {AREA} --- SELECT * FROM area", ["area_volume", "total"])
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("day", F.to_date("opened_at"))
    return profile.value_area(profile.volume_profile(rows, 5.0, ["symbol", "day"]), ["symbol", "day"])


@query(
    "t27_session_profile",
    f"""WITH RECURSIVE {AREA}, x AS (SELECT symbol, CAST(opened_at AS DATE) AS day, opened_at, open, high, low, close, volume, count(*) OVER (PARTITION BY symbol, CAST(opened_at AS DATE)) AS n FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, CAST(opened_at AS DATE) ORDER BY opened_at DESC) = 1),
y AS (SELECT x.*, poc * 5.0::DOUBLE AS point, area_low * 5.0::DOUBLE AS bottom, area_high * 5.0::DOUBLE AS top, total, total / n AS usual, CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END AS lw, CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END AS uw FROM x JOIN area USING (symbol, day)),
z AS (SELECT *, low < bottom AND close >= bottom AND lw >= 0.4 AS lr, high > top AND close <= top AND uw >= 0.4 AS ur, close >= top AND volume >= usual * 1.2 AS ub, close <= bottom AND volume >= usual * 1.2 AS lb FROM y),
k AS (SELECT *, CASE WHEN n < 3 THEN 'insufficient_bars' WHEN total = 0 THEN 'empty_profile' WHEN low < bottom AND high > top THEN 'ambiguous_overlap' WHEN CAST(lr AS INT) + CAST(ur AS INT) + CAST(ub AS INT) + CAST(lb AS INT) > 1 THEN 'conflicting_signals' END AS w,
  CASE WHEN lr THEN 'lower_rejection' WHEN ur THEN 'upper_rejection' WHEN ub THEN 'upper_breakout' WHEN lb THEN 'lower_breakout' END AS kind, CASE WHEN close > top THEN close - top WHEN close < bottom THEN bottom - close ELSE least(abs(close - top), abs(close - bottom)) END AS distance FROM z) ---
SELECT symbol, day, opened_at, CASE WHEN w IS NULL AND kind IS NOT NULL THEN CASE WHEN kind IN ('lower_rejection', 'upper_breakout') THEN 1 ELSE -1 END ELSE 0 END AS direction, CASE WHEN w IS NULL AND kind IS NOT NULL THEN kind ELSE 'wait' END AS decision,
  coalesce(w, kind, CASE WHEN close > top OR close < bottom THEN 'unconfirmed_breakout' WHEN abs(close - point) <= 5 THEN 'balanced_near_point' ELSE 'no_signal' END) AS reason,
  CASE WHEN w IS NULL AND kind IS NOT NULL THEN least(1.0, greatest(0.1, CASE WHEN kind LIKE '%rejection' THEN 0.45 ELSE 0.5 END + least(0.25, distance / 5 * 0.05) + least(0.2, volume / usual * 0.05))) ELSE 0 END AS confidence FROM k""",
    ["confidence"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).withColumn("day", F.to_date("opened_at"))
    return profile.session_signals(rows, 5.0, ["symbol", "day"])


@query("a24_balance", "--- SELECT CAST(i AS INTEGER) AS label, coalesce(n, 0) AS n, coalesce(n, 0) / sum(n) OVER () AS share FROM range(12) t(i) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) g ON g.label = i", ["share"])
def _(spark, sf):
    return stats.balance(a.read(spark, sf, "embeddings").select("label"), "label", 12)


@query(
    "a24_entropy",
    "WITH g AS (SELECT i, coalesce(n, 0) / (SELECT count(*) FROM embeddings) AS share FROM range(12) t(i) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) g ON g.label = i) --- SELECT sum(CASE WHEN share > 0 THEN -share * ln(share) ELSE 0 END) / ln(12) AS entropy, min(share) AS least, max(share) AS most FROM g",
    ["entropy", "least", "most"],
)
def _(spark, sf):
    return stats.entropy(a.read(spark, sf, "embeddings").select("label"), "label", 12)


@query(
    "a25_quarterly",
    """WITH c AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT q.quarter, l.label, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT quarter FROM c) q CROSS JOIN (SELECT DISTINCT label FROM c) l LEFT JOIN c ON c.quarter = q.quarter AND c.label = l.label),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY quarter) AS share FROM g) --- SELECT *, n = 0 OR share > 0.5 AS warning FROM s""",
    ["share"],
)
def _(spark, sf):
    rows = a.read(spark, sf, "orders").select("o_orderdate", F.col("o_orderpriority").alias("label"))
    return stats.quarterly(rows, "o_orderdate", "label")


@query(
    "a26_envelope",
    f"""WITH {f.VECTORS}, q AS (SELECT dim, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM vectors WHERE label < 5 GROUP BY dim),
e AS (SELECT CAST(v.dim AS INTEGER) AS dim, count(*) FILTER (x < lo) AS below, count(*) FILTER (x > hi) AS above, count(*) AS n FROM vectors v JOIN q ON q.dim = v.dim WHERE label >= 5 GROUP BY v.dim) --- SELECT *, (below + above) / n AS share FROM e""",
    ["share"],
)
def _(spark, sf):
    rows = a.vectors(spark, sf)
    return stats.envelope(rows.where("label < 5"), rows.where("label >= 5"), 0.05, 0.95)


@query(
    "a27_quantiles",
    f"WITH {f.VECTORS} --- SELECT label, CAST(dim AS INTEGER) AS dim, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95, quantile_cont(x, 0.995) AS p995 FROM vectors GROUP BY label, dim",
    ["p05", "p50", "p95", "p995"],
)
def _(spark, sf):
    q = F.percentile("x", [0.05, 0.5, 0.95, 0.995])
    rows = a.vectors(spark, sf).groupBy("label", "dim").agg(q.alias("q"))
    return rows.select("label", "dim", *(F.col("q")[i].alias(n) for i, n in enumerate(("p05", "p50", "p95", "p995"))))


@query(
    "a29_divergence",
    """WITH one AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), two AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE year(o_orderdate) = 1999 AND o_orderpriority <> '5-LOW' GROUP BY 1),
p AS (SELECT label, n / sum(n) OVER () AS p FROM one), q AS (SELECT label, n / sum(n) OVER () AS q FROM two), j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q USING (label)), k AS (SELECT *, (p + q) / 2 AS m FROM j) ---
SELECT sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2 AS divergence, sum(abs(p - q)) AS l1, max(abs(p - q)) AS largest FROM k""",
    ["divergence", "l1", "largest"],
)
def _(spark, sf):
    rows = a.read(spark, sf, "orders").select(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("label"))
    return stats.divergence(rows.where("y = 1996"), rows.where("y = 1999 and label <> '5-LOW'"), "label")


_LAGS = ", ".join(f"lag(d, {k}) OVER w AS l{k}" for k in range(1, 31))
_RHO = ", ".join(f"coalesce(sum(d * l{k}), 0) / nullif(sum(d * d), 0) AS r{k}" for k in range(1, 31))
_TAU = "1"
for _i in reversed(range(1, 31, 2)):
    _TAU = f"CASE WHEN r{_i} + r{_i + 1} > 0 THEN 2 * (r{_i} + r{_i + 1}) + ({_TAU if _i < 29 else '0'}) ELSE 0 END"


@query(
    "a30_effective_size",
    f"""WITH {f.BARS}, u AS (SELECT symbol, opened_at, CAST(close > open AS DOUBLE) AS up FROM bars), x AS (SELECT *, up - avg(up) OVER (PARTITION BY symbol) AS d FROM u),
y AS (SELECT *, {_LAGS} FROM x WINDOW w AS ({f.W})), z AS (SELECT symbol, count(*) AS n, {_RHO} FROM y GROUP BY symbol) ---
SELECT symbol, n, least(n, greatest(1, n / greatest(1, 1 + {_TAU}))) AS ess FROM z""",
    ["ess"],
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf).select("symbol", "opened_at", (F.col("close") > F.col("open")).alias("up"))
    return stats.effective_size(rows, "symbol", "opened_at", "up")


@query(
    "a32_agreement",
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM c GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
t AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS both_, (SELECT sum(na * (na - 1) / 2) FROM x) AS pa, (SELECT sum(nb * (nb - 1) / 2) FROM y) AS pb,
  (SELECT sum(na * ln(na)) FROM x) AS ea, (SELECT sum(nb * ln(nb)) FROM y) AS eb, (SELECT sum(n * ln(n)) FROM c) AS eab), e AS (SELECT *, pa * pb / (n * (n - 1) / 2) AS ex FROM t) ---
SELECT (both_ - ex) / ((pa + pb) / 2 - ex) AS ari, ((ln(n) - ea / n) + (ln(n) - eb / n) - (ln(n) - eab / n)) / (((ln(n) - ea / n) + (ln(n) - eb / n)) / 2) AS nmi FROM e""",
    ["ari", "nmi"],
)
def _(spark, sf):
    rows = a.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b"))
    return stats.agreement(rows, "a", "b")


CENTRES = f"""{f.VECTORS}, centres AS (SELECT label AS component, dim, avg(x) AS mean, var_pop(x) + 0.001 AS var, count(*) / (SELECT count(*) FROM embeddings) AS weight FROM vectors GROUP BY label, dim)"""


def centres(spark, sf):
    rows = a.vectors(spark, sf)
    total = a.read(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("total"))
    rows = rows.groupBy(F.col("label").alias("component"), "dim").agg(F.avg("x").alias("mean"), (F.var_pop("x") + 0.001).alias("var"), F.count(F.lit(1)).alias("n"))
    return rows.crossJoin(F.broadcast(total)).withColumn("weight", F.col("n") / F.col("total")).drop("n", "total")


@query(
    "c3_assign",
    f"""WITH {CENTRES}, g AS (SELECT vec_id, component, sum((x - mean) * (x - mean) / var) AS d2, ln(any_value(weight)) - sum(ln(var) + (x - mean) * (x - mean) / var + ln(2 * 3.141592653589793::DOUBLE)) / 2 AS lp FROM vectors v JOIN centres c ON c.dim = v.dim GROUP BY vec_id, component),
e AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY vec_id)) AS e FROM g), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(p, 12) DESC, component) AS rn FROM p) ---
SELECT vec_id, max(CASE WHEN rn = 1 THEN component END) AS component, max(CASE WHEN rn = 1 THEN p END) AS p, max(CASE WHEN rn = 2 THEN p END) AS second_p, max(CASE WHEN rn = 1 THEN d2 END) AS distance_sq, sqrt(max(CASE WHEN rn = 1 THEN d2 END)) AS distance FROM n GROUP BY vec_id""",
    ["p", "second_p", "distance_sq", "distance"],
)
def _(spark, sf):
    return stats.assign(a.vectors(spark, sf), centres(spark, sf))


@query(
    "a28_confidence_tails",
    f"""WITH {CENTRES}, g AS (SELECT v.vec_id, v.label, component, sum((x - mean) * (x - mean) / var) AS d2 FROM vectors v JOIN centres c ON c.dim = v.dim AND c.component = v.label GROUP BY v.vec_id, v.label, component), q AS (SELECT label, quantile_cont(d2, 0.9) AS lim FROM g GROUP BY label) ---
SELECT g.label, count(*) AS n, count(*) FILTER (d2 > lim) AS far, count(*) FILTER (d2 > lim) / count(*) AS share FROM g JOIN q ON q.label = g.label GROUP BY g.label""",
    ["share"],
)
def _(spark, sf):
    c = centres(spark, sf).withColumnRenamed("component", "label")
    rows = a.vectors(spark, sf).join(F.broadcast(c), ["label", "dim"])  # ten labels
    rows = rows.groupBy("vec_id", "label").agg(F.sum(F.pow(F.col("x") - F.col("mean"), 2) / F.col("var")).alias("d2"))
    limit = rows.groupBy("label").agg(F.percentile("d2", 0.9).alias("lim"))
    out = rows.join(limit, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("d2") > F.col("lim"), 1)).alias("far"))
    return out.withColumn("share", F.col("far") / F.col("n"))


@query(
    "w19_hysteresis",
    f"""WITH RECURSIVE {f.BARS}, m AS (SELECT symbol, opened_at, CASE WHEN count(*) OVER w = 20 AND close > avg(close) OVER w THEN 'up' ELSE 'down' END AS raw, row_number() OVER ({f.W}) AS rn FROM bars WINDOW w AS ({f.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
h AS (SELECT symbol, opened_at, rn, raw, raw AS state, 1 AS run FROM m WHERE rn = 1 UNION ALL
  SELECT m.symbol, m.opened_at, m.rn, m.raw, CASE WHEN m.raw = h.raw THEN m.raw ELSE h.state END, CASE WHEN m.raw = h.raw THEN h.run + 1 ELSE 1 END FROM h JOIN m ON m.symbol = h.symbol AND m.rn = h.rn + 1) ---
SELECT symbol, opened_at, raw, state FROM h""",
)
def _(spark, sf):
    rows = a.bars_1h(spark, sf)
    rows = rows.withColumn("raw", F.when(F.col("close") > full(F.avg("close"), 20), "up").otherwise("down"))
    return hysteresis(rows, "raw", "state").select("symbol", "opened_at", "raw", "state")


@query(
    "w10_w13_path",
    f"""WITH {f.BARS}, x AS (SELECT *, lag(close) OVER ({f.W}) AS c0 FROM bars), y AS (SELECT *, close - c0 AS step, ln(close / c0) AS r FROM x), z AS (SELECT *, lag(step) OVER ({f.W}) AS s0, lag(r) OVER ({f.W}) AS r0, max(close) OVER ({f.W}) AS peak, min(close) OVER ({f.W}) AS trough FROM y) ---
SELECT symbol, max((peak - close) / peak) AS drawdown, max((close - trough) / trough) AS runup, count(*) FILTER (step * s0 < 0) / count(*) FILTER (step * s0 <> 0) AS sign_changes, corr(CASE WHEN r0 IS NOT NULL THEN r END, r0) AS autocorr FROM z GROUP BY symbol""",
    ["drawdown", "runup", "sign_changes", "autocorr"],
)
def _(spark, sf):
    from ..operators.windows import running

    rows = a.bars_1h(spark, sf).withColumn("c0", shift("close", 1))
    rows = rows.withColumn("step", F.col("close") - F.col("c0")).withColumn("r", F.log(F.col("close") / F.col("c0")))
    rows = rows.withColumn("s0", shift("step", 1)).withColumn("r0", shift("r", 1)).withColumn("peak", running(F.max("close"))).withColumn("trough", running(F.min("close")))
    changes = F.count(F.when(F.col("step") * F.col("s0") < 0, 1)) / F.count(F.when(F.col("step") * F.col("s0") != 0, 1))
    return rows.groupBy("symbol").agg(F.max((F.col("peak") - F.col("close")) / F.col("peak")).alias("drawdown"), F.max((F.col("close") - F.col("trough")) / F.col("trough")).alias("runup"), changes.alias("sign_changes"), F.corr(F.when(F.col("r0").isNotNull(), F.col("r")), "r0").alias("autocorr"))
