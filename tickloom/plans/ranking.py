"""Queries that rank candidates, choose winners and apply gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import performance as p
from ..operators import ranking as r
from ..sources import adapters as a
from . import fragments as f
from .performance import MONTHS, compounded
from .registry import query

RESULTS = f"""{MONTHS}, tr AS (SELECT candidate_id, strftime(exit_ts, '%Y-%m') AS month, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, avg(ret) AS average_return, avg(ret + 0.0008) AS average_gross, sum(notional) / 1000000 AS turnover FROM ledger GROUP BY ALL),
res AS (SELECT candidate_id, month, round(return_ratio, 9) AS return_ratio, trades, trades / 5 AS trades_per_day, round(return_ratio / 5, 9) AS daily_return, round(max_drawdown, 9) AS max_drawdown,
  round(win_rate, 9) AS win_rate, round(average_return, 9) AS average_return, round(average_gross, 9) AS average_gross, round(turnover, 9) AS turnover FROM months JOIN tr USING (candidate_id, month))"""
PAIRS = f"""{RESULTS}, pairs AS (SELECT candidate_id, month, return_ratio AS test_return, trades_per_day AS test_trades_per_day, daily_return AS test_daily_return, max_drawdown AS test_drawdown, win_rate AS test_win_rate, average_gross AS test_roe,
  lag(return_ratio) OVER w AS train_return, lag(trades_per_day) OVER w AS train_trades_per_day, lag(daily_return) OVER w AS train_daily_return, lag(max_drawdown) OVER w AS train_drawdown, lag(win_rate) OVER w AS train_win_rate, lag(average_gross) OVER w AS train_roe
  FROM res WINDOW w AS (PARTITION BY candidate_id ORDER BY month) QUALIFY train_return IS NOT NULL)"""


def results(spark, sf):
    """A month's results of each candidate; a month counts as a week of five days of trading."""
    trades = a.ledger(spark, sf)
    more = trades.groupBy("candidate_id", F.date_format("exit_ts", "yyyy-MM").alias("month")).agg(
        F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("average_return"), F.avg(F.col("ret") + 0.0008).alias("average_gross"), (F.sum("notional") / 1000000).alias("turnover")
    )
    rows = p.monthly(trades).join(more, ["candidate_id", "month"])
    rounded = lambda c, name: F.round(c, 9).alias(name)
    return rows.select(
        "candidate_id", "month", rounded("return_ratio", "return_ratio"), "trades", (F.col("trades") / 5).alias("trades_per_day"), rounded(F.col("return_ratio") / 5, "daily_return"),
        *(rounded(c, c) for c in ("max_drawdown", "win_rate", "average_return", "average_gross", "turnover")),
    )


def pairs(spark, sf):
    """Each month as test, the candidate's month before it as train."""
    names = {"return_ratio": "return", "trades_per_day": "trades_per_day", "daily_return": "daily_return", "max_drawdown": "drawdown", "win_rate": "win_rate", "average_gross": "roe"}
    before = Window.partitionBy("candidate_id").orderBy("month")
    rows = results(spark, sf)
    rows = rows.select("candidate_id", "month", *(F.col(c).alias(f"test_{n}") for c, n in names.items()), *(F.lag(c).over(before).alias(f"train_{n}") for c, n in names.items()))
    return rows.where("train_return is not null")


def order_sql(name: str, by: str = "candidate_id") -> str:
    return ", ".join([f"{k[1:]} ASC NULLS LAST" if k.startswith("-") else f"{k} DESC NULLS LAST" for k in r.KEYS[name]] + [by])


def _rank(name: str, key: str, source, sql: str, table: str, shown: str):
    @query(name, f"WITH {sql} --- SELECT month, candidate_id, {shown}, row_number() OVER (PARTITION BY month ORDER BY {order_sql(key)}) AS place FROM {table}", [shown])
    def _(spark, sf):
        return r.ranked(source(spark, sf), r.KEYS[key], "candidate_id", ["month"]).select("month", "candidate_id", shown, "place")


_rank("l2_rank_train_test", "train_test", pairs, PAIRS, "pairs", "test_return")
_rank("l13_rank_scalping", "scalping", pairs, PAIRS, "pairs", "test_return")
_rank("l13_rank_novel", "novel_train", results, RESULTS, "res", "return_ratio")
_rank("l13_rank_validation", "validation", results, RESULTS, "res", "return_ratio")


@query(
    "l13_train_selection",
    f"WITH {PAIRS}, s AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY {order_sql('train_selection')}) AS place FROM pairs WHERE train_trades_per_day >= 10 AND train_win_rate >= 0.45 AND train_roe >= 0.0003 AND train_return > 0) --- SELECT month, candidate_id, train_return, place FROM s WHERE place <= 20",
    ["train_return"],
)
def _(spark, sf):
    rows = r.targets(pairs(spark, sf), {"train_trades_per_day": 10, "train_win_rate": 0.45, "train_roe": 0.0003}).where("train_return > 0")
    return r.ranked(rows, r.KEYS["train_selection"], "candidate_id", ["month"]).where("place <= 20").select("month", "candidate_id", "train_return", "place")


@query(
    "l15_targets",
    f"WITH {RESULTS} --- SELECT month, candidate_id, return_ratio, row_number() OVER (PARTITION BY month ORDER BY {order_sql('validation')}) AS place FROM res WHERE trades >= 5 AND win_rate >= 0.4 AND average_return >= -0.01",
    ["return_ratio"],
)
def _(spark, sf):
    rows = r.targets(results(spark, sf), {"trades": 5, "win_rate": 0.4, "average_return": -0.01})
    return r.ranked(rows, r.KEYS["validation"], "candidate_id", ["month"]).select("month", "candidate_id", "return_ratio", "place")


@query(
    "l3_rank_walk_forward",
    f"""WITH {RESULTS}, y AS (SELECT substring(month, 1, 4) AS year, candidate_id, round(avg(return_ratio), 9) AS average_return, count(*) FILTER (return_ratio > 0) AS positive_folds, round(avg(daily_return), 9) AS average_daily_return,
  round(avg(trades_per_day), 9) AS average_trades_per_day, round(avg(win_rate), 9) AS average_win_rate, max(max_drawdown) AS worst_drawdown FROM res GROUP BY ALL) --- SELECT *, row_number() OVER (PARTITION BY year ORDER BY {order_sql("walk_forward")}) AS place FROM y""",
    ["average_return", "average_daily_return", "average_trades_per_day", "average_win_rate", "worst_drawdown"],
)
def _(spark, sf):
    mean = lambda c, n: F.round(F.avg(c), 9).alias(n)
    rows = results(spark, sf).groupBy(F.substring("month", 1, 4).alias("year"), "candidate_id").agg(
        mean("return_ratio", "average_return"), F.count(F.when(F.col("return_ratio") > 0, 1)).alias("positive_folds"), mean("daily_return", "average_daily_return"),
        mean("trades_per_day", "average_trades_per_day"), mean("win_rate", "average_win_rate"), F.max("max_drawdown").alias("worst_drawdown"),
    )
    return r.ranked(rows, r.KEYS["walk_forward"], "candidate_id", ["year"])


@query(
    "l14_policy_winner",
    f"""WITH {f.LEDGER}, g AS (SELECT flag AS family, candidate_id, round(sum(pnl) / 1000000, 9) AS return_ratio, round(max(-pnl) / 1000000, 9) AS max_drawdown, round(sum(notional) / 1000000, 9) AS turnover FROM ledger GROUP BY ALL),
w AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY family ORDER BY {order_sql("validation_policy")}) = 1) --- SELECT *, row_number() OVER (ORDER BY {order_sql("validation_policy")}) = 1 AS overall FROM w""",
    ["return_ratio", "max_drawdown", "turnover"],
)
def _(spark, sf):
    rows = a.ledger(spark, sf).groupBy(F.col("flag").alias("family"), "candidate_id")
    rows = rows.agg(F.round(F.sum("pnl") / 1000000, 9).alias("return_ratio"), F.round(F.max(-F.col("pnl")) / 1000000, 9).alias("max_drawdown"), F.round(F.sum("notional") / 1000000, 9).alias("turnover"))
    return r.winners(rows, r.KEYS["validation_policy"], "candidate_id", "family")


#: Monthly returns of a candidate in a regime (the return flag), and what winners are chosen by.
EVIDENCE = f"""{f.LEDGER}, ev AS (SELECT flag, candidate_id, strftime(exit_ts, '%Y-%m') AS month, sum(pnl) / 1000000 AS v FROM ledger GROUP BY ALL),
c0 AS (SELECT *, sum(v) OVER (PARTITION BY flag, candidate_id ORDER BY month) AS cum, row_number() OVER (PARTITION BY flag, candidate_id ORDER BY v, month) AS low, row_number() OVER (PARTITION BY flag, candidate_id ORDER BY v DESC, month) AS top, count(*) OVER (PARTITION BY flag, candidate_id) AS n FROM ev),
c1 AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY flag, candidate_id ORDER BY month)) - cum AS dd FROM c0),
sc AS (SELECT flag, candidate_id, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 9) AS lower_bound, round(median(v), 9) AS median_return, round(avg(v), 9) AS mean_return, round({compounded("(CASE WHEN top > 1 THEN v END)")}, 9) AS without_best,
  round(avg(CASE WHEN low <= ceil(n * 0.1::DOUBLE) THEN v END), 9) AS shortfall, round(max(dd), 9) AS max_drawdown FROM c1 GROUP BY flag, candidate_id)"""


def evidence(spark, sf):
    key = ["flag", "candidate_id"]
    rows = a.ledger(spark, sf).groupBy(*key, F.date_format("exit_ts", "yyyy-MM").alias("month")).agg((F.sum("pnl") / 1000000).alias("v"))
    path, own = Window.partitionBy(*key).orderBy("month").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*key)
    rows = rows.withColumn("cum", F.sum("v").over(path)).withColumn("low", F.row_number().over(own.orderBy("v", "month"))).withColumn("top", F.row_number().over(own.orderBy(F.desc("v"), "month"))).withColumn("n", F.count(F.lit(1)).over(own))
    rows = rows.withColumn("dd", F.greatest(F.lit(0.0), F.max("cum").over(path)) - F.col("cum"))
    rounded = lambda c, name: F.round(c, 9).alias(name)
    return rows.groupBy(*key).agg(
        rounded(F.avg("v") - 1.96 * F.stddev_samp("v") / F.sqrt(F.count(F.lit(1))), "lower_bound"), rounded(F.percentile("v", F.lit(0.5)), "median_return"), rounded(F.avg("v"), "mean_return"),
        rounded(p.compounded(F.when(F.col("top") > 1, F.col("v"))), "without_best"), rounded(F.avg(F.when(F.col("low") <= F.ceil(F.col("n") * 0.1), F.col("v"))), "shortfall"), rounded(F.max("dd"), "max_drawdown"),
    )


_SHOWN = ["lower_bound", "median_return", "mean_return", "without_best", "shortfall", "max_drawdown"]


@query("l7_daily_winner", f"WITH {EVIDENCE} --- SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY flag ORDER BY {order_sql('daily_winner')}) = 1", _SHOWN)
def _(spark, sf):
    return r.first_of(evidence(spark, sf), r.KEYS["daily_winner"], "candidate_id", ["flag"])


@query("l8_weekly_winner", f"WITH {EVIDENCE} --- SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY flag ORDER BY {order_sql('weekly_winner')}) = 1", _SHOWN)
def _(spark, sf):
    return r.first_of(evidence(spark, sf), r.KEYS["weekly_winner"], "candidate_id", ["flag"])


#: Of every label, a model of two components (the label and the rest): moments, likelihood, BIC, silhouette.
MODELS = f"""{f.VECTORS}, mom AS (SELECT label, dim, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM vectors GROUP BY label, dim), tot AS (SELECT dim, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM mom GROUP BY dim),
sides AS (SELECT label AS model_id, true AS own, dim, n, s, q FROM mom UNION ALL SELECT label, false, m.dim, t.n - m.n, t.s - m.s, t.q - m.q FROM mom m JOIN tot t ON t.dim = m.dim),
st AS (SELECT model_id, own, dim, CAST(n AS DOUBLE) AS n, s / n AS mean, q / n - (s / n) * (s / n) AS v FROM sides WHERE n > 0),
ll0 AS (SELECT model_id, own, any_value(n) AS n, count(*) AS dims, sum(ln(2 * 3.141592653589793::DOUBLE * (v + 0.000001)) + v / (v + 0.000001)) AS e FROM st GROUP BY model_id, own),
ll AS (SELECT model_id, sum(n * (ln(n / (SELECT max(n) FROM tot)) - e / 2)) AS log_likelihood, CAST(2 - 1 + 2 * max(dims) + 2 * max(dims) AS DOUBLE) AS parameters FROM ll0 GROUP BY model_id),
bic AS (SELECT *, -2 * log_likelihood + parameters * ln((SELECT max(n) FROM tot)) AS bic FROM ll)"""


def model_moments(spark, sf):
    own = a.vectors(spark, sf).groupBy(F.col("label").alias("model_id"), "dim").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    total = own.groupBy("dim").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    both = own.join(F.broadcast(total), "dim")  # one row a component
    sides = both.select("model_id", F.lit(True).alias("own"), "dim", "tn", "n", "s", "q").unionByName(both.select("model_id", F.lit(False).alias("own"), "dim", "tn", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q")))
    mean = F.col("s") / F.col("n")
    return sides.where("n > 0").select("model_id", "own", "dim", "tn", F.col("n").cast("double").alias("n"), mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("v"))


def model_bic(spark, sf):
    v = F.col("v")
    rows = model_moments(spark, sf).groupBy("model_id", "own").agg(F.max("n").alias("n"), F.max("tn").alias("tn"), F.count(F.lit(1)).alias("dims"), F.sum(F.log(2 * 3.141592653589793 * (v + 0.000001)) + v / (v + 0.000001)).alias("e"))
    rows = rows.groupBy("model_id").agg(F.sum(F.col("n") * (F.log(F.col("n") / F.col("tn")) - F.col("e") / 2)).alias("log_likelihood"), F.max("dims").alias("dims"), F.max("tn").alias("tn"))
    rows = rows.withColumn("parameters", r.parameters_of(F.lit(2), F.col("dims"), F.lit(False)).cast("double"))
    return rows.withColumn("bic", r.bic(F.col("log_likelihood"), F.col("tn"), F.col("parameters"))).drop("dims", "tn")


@query("a33_bic", f"WITH {MODELS} --- SELECT model_id, log_likelihood, parameters, bic FROM bic", ["log_likelihood", "bic"])
def _(spark, sf):
    return model_bic(spark, sf)


@query(
    "l12_family_winner",
    f"""WITH {MODELS}, d AS (SELECT v.vec_id, st.model_id, sqrt(sum(CASE WHEN st.own = (v.label = st.model_id) THEN (x - mean) * (x - mean) END)) AS a, sqrt(sum(CASE WHEN st.own <> (v.label = st.model_id) THEN (x - mean) * (x - mean) END)) AS b FROM vectors v JOIN st ON st.dim = v.dim GROUP BY v.vec_id, st.model_id),
sil AS (SELECT model_id, round(avg((b - a) / greatest(a, b)), 9) AS silhouette FROM d GROUP BY model_id),
m AS (SELECT model_id, CASE WHEN model_id % 2 = 0 THEN 'kmeans' ELSE 'gmm' END AS family, silhouette, round(bic, 6) AS bic FROM bic JOIN sil USING (model_id)),
w AS (SELECT family, model_id, CASE family WHEN 'kmeans' THEN 'silhouette' ELSE 'bic' END AS metric_name, CASE family WHEN 'kmeans' THEN silhouette ELSE bic END AS metric FROM m QUALIFY row_number() OVER (PARTITION BY family ORDER BY CASE family WHEN 'kmeans' THEN silhouette ELSE -bic END DESC, model_id) = 1) --- SELECT *, family = 'gmm' OR NOT EXISTS (SELECT 1 FROM w WHERE family = 'gmm') AS chosen FROM w""",
    ["metric"],
)
def _(spark, sf):
    centres = model_moments(spark, sf).select("model_id", "own", "dim", "mean")
    rows = a.vectors(spark, sf).join(F.broadcast(centres), "dim")  # two centres a label
    gap, same = F.pow(F.col("x") - F.col("mean"), 2), F.col("own") == (F.col("label") == F.col("model_id"))
    rows = rows.groupBy("vec_id", "model_id").agg(F.sqrt(F.sum(F.when(same, gap))).alias("a"), F.sqrt(F.sum(F.when(~same, gap))).alias("b"))
    sil = rows.groupBy("model_id").agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 9).alias("silhouette"))
    family = F.when(F.col("model_id") % 2 == 0, "kmeans").otherwise("gmm").alias("family")
    models = model_bic(spark, sf).join(sil, "model_id").select("model_id", family, "silhouette", F.round("bic", 6).alias("bic"), F.lit(True).alias("eligible"))
    return r.family_winner(models, ["gmm", "kmeans"])


@query(
    "l6_preference_rank",
    f"""WITH {f.VECTORS}, q AS (SELECT dim, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM vectors GROUP BY dim), n2 AS (SELECT vec_id, label, sum(x * x) AS d2, max(CAST(x < lo OR x > hi AS INTEGER)) AS clipped, max(x) - quantile_cont(x, 0.95) AS margin FROM vectors v JOIN q ON q.dim = v.dim GROUP BY vec_id, label),
lim AS (SELECT quantile_cont(d2, 0.9) AS far, quantile_cont(margin, 0.1) AS near FROM n2), parts AS (SELECT label, vec_id % 4 AS part, count(*) AS n FROM n2 GROUP BY ALL), pw AS (SELECT label, count(*) FILTER (n < 5) + 4 - count(*) AS quarter_warnings, CAST(min(n) AS DOUBLE) AS least_effective_size, round((max(n) - min(n)) / sum(n), 9) AS divergence FROM parts GROUP BY label),
g AS (SELECT label, round(avg(clipped), 9) AS clipping_share, round(avg(CAST(margin < near AS INTEGER)), 9) AS margin_tail_share, round(avg(CAST(d2 > far AS INTEGER)), 9) AS distance_tail_share FROM n2, lim GROUP BY label) ---
SELECT label, clipping_share, margin_tail_share, distance_tail_share, quarter_warnings, least_effective_size, divergence, label % 3 + 4 AS cluster_count, row_number() OVER (ORDER BY {order_sql("preference", "label")}) AS place FROM g JOIN pw USING (label)""",
    ["clipping_share", "margin_tail_share", "distance_tail_share", "divergence"],
)
def _(spark, sf):
    rows = a.vectors(spark, sf)
    q = rows.groupBy("dim").agg(F.percentile("x", [0.01, 0.99]).alias("q"))
    rows = rows.join(F.broadcast(q), "dim").groupBy("vec_id", "label").agg(
        F.sum(F.col("x") * F.col("x")).alias("d2"), F.max(((F.col("x") < F.col("q")[0]) | (F.col("x") > F.col("q")[1])).cast("int")).alias("clipped"), (F.max("x") - F.percentile("x", F.lit(0.95))).alias("margin")
    )
    limits = rows.agg(F.percentile("d2", F.lit(0.9)).alias("far"), F.percentile("margin", F.lit(0.1)).alias("near"))
    mean = lambda c, n: F.round(F.avg(c.cast("int")), 9).alias(n)
    shares = rows.crossJoin(F.broadcast(limits)).groupBy("label").agg(mean(F.col("clipped"), "clipping_share"), mean(F.col("margin") < F.col("near"), "margin_tail_share"), mean(F.col("d2") > F.col("far"), "distance_tail_share"))  # one row
    parts = rows.groupBy("label", F.col("vec_id") % 4).agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(
        (F.count(F.when(F.col("n") < 5, 1)) + 4 - F.count(F.lit(1))).alias("quarter_warnings"), F.min("n").cast("double").alias("least_effective_size"), F.round((F.max("n") - F.min("n")) / F.sum("n"), 9).alias("divergence")
    )
    return r.ranked(shares.join(parts, "label").withColumn("cluster_count", F.col("label") % 3 + 4), r.KEYS["preference"], "label")


@query(
    "c10_model_gates",
    f"""WITH {f.LEDGER}, h AS (SELECT *, exit_ts < TIMESTAMP '1995-06-01' AS early, count(*) OVER (PARTITION BY exit_ts < TIMESTAMP '1995-06-01') AS all_ FROM ledger),
g AS (SELECT candidate_id, flag, count(DISTINCT date_trunc('week', exit_ts)) AS weekly_episodes, count(DISTINCT strftime(exit_ts, '%Y-%m')) AS distinct_months,
  round(1 - abs(avg(CASE WHEN trade_id % 2 = 0 THEN CAST(pnl > 0 AS DOUBLE) END) - avg(CASE WHEN trade_id % 2 = 1 THEN CAST(pnl > 0 AS DOUBLE) END)), 9) AS seed_ari, round(1 - abs(avg(CASE WHEN trade_id % 2 = 0 THEN confidence END) - avg(CASE WHEN trade_id % 2 = 1 THEN confidence END)), 9) AS seed_nmi,
  round(10 * abs(avg(CASE WHEN early THEN confidence END) - avg(CASE WHEN NOT early THEN confidence END)), 9) AS centroid_distance, round(10 * abs(sum(CASE WHEN early THEN 1.0::DOUBLE / all_ ELSE 0 END) - sum(CASE WHEN early THEN 0 ELSE 1.0::DOUBLE / all_ END)), 9) AS prevalence_drift,
  round(avg(CAST(confidence < 0.25 AS INTEGER)), 9) AS low_confidence_rate FROM h GROUP BY candidate_id, flag),
k AS (SELECT *, concat_ws(',', CASE WHEN weekly_episodes >= 8 THEN NULL ELSE 'weekly_episodes' END, CASE WHEN distinct_months >= 3 THEN NULL ELSE 'distinct_months' END, CASE WHEN seed_ari >= 0.8 THEN NULL ELSE 'seed_ari' END, CASE WHEN seed_nmi >= 0.8 THEN NULL ELSE 'seed_nmi' END,
  CASE WHEN centroid_distance <= 0.5 THEN NULL ELSE 'centroid_distance' END, CASE WHEN prevalence_drift <= 0.2 THEN NULL ELSE 'prevalence_drift' END, CASE WHEN low_confidence_rate <= 0.25 THEN NULL ELSE 'low_confidence_rate' END) AS failed FROM g) --- SELECT candidate_id, flag, weekly_episodes, distinct_months, coalesce(failed, '') AS failed, coalesce(failed, '') = '' AS eligible FROM k""",
)
def _(spark, sf):
    rows = a.ledger(spark, sf).withColumn("early", F.col("exit_ts") < F.lit("1995-06-01").cast("timestamp"))
    alls = rows.groupBy("early").agg(F.count(F.lit(1)).alias("all_"))
    rows = rows.join(F.broadcast(alls), "early")  # two rows
    mean = lambda c, when: F.avg(F.when(when, c))
    even, early, won = F.col("trade_id") % 2 == 0, F.col("early"), (F.col("pnl") > 0).cast("double")
    gap = lambda c, when: F.abs(mean(c, when) - mean(c, ~when))
    drift = F.abs(F.sum(F.when(early, 1 / F.col("all_")).otherwise(0.0)) - F.sum(F.when(early, 0.0).otherwise(1 / F.col("all_"))))
    rows = rows.groupBy("candidate_id", "flag").agg(
        F.countDistinct(F.date_trunc("week", "exit_ts")).alias("weekly_episodes"), F.countDistinct(F.date_format("exit_ts", "yyyy-MM")).alias("distinct_months"),
        F.round(1 - gap(won, even), 9).alias("seed_ari"), F.round(1 - gap(F.col("confidence"), even), 9).alias("seed_nmi"), F.round(10 * gap(F.col("confidence"), early), 9).alias("centroid_distance"),
        F.round(10 * drift, 9).alias("prevalence_drift"), F.round(F.avg((F.col("confidence") < 0.25).cast("int")), 9).alias("low_confidence_rate"),
    )
    return r.gated(rows, r.GATES).select("candidate_id", "flag", "weekly_episodes", "distinct_months", "failed", "eligible")


@query("f14_family_cap", "WITH g AS (SELECT p_type AS family, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_type) --- SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total, n <= 0.5 * sum(n) OVER () AND n <= 5 AS within_cap FROM g")
def _(spark, sf):
    rows = a.read(spark, sf, "part").where("p_size > 25").select(F.col("p_type").alias("family"))
    return r.family_cap(rows, 0.5, 5)


#: A registry of deferred candidates, by group or by pattern of the id.
DEFERRED = [("Brand#11", None), ("Brand#23", None), (None, "%green%"), (None, "1%7")]


@query("p9_not_deferred", "--- SELECT p_partkey, p_brand AS candidate_group FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#23') AND NOT (CAST(p_partkey AS VARCHAR) LIKE '%green%' OR CAST(p_partkey AS VARCHAR) LIKE '1%7')")
def _(spark, sf):
    registry = spark.createDataFrame(DEFERRED, "candidate_group string, id_pattern string")
    rows = a.read(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_brand").alias("candidate_group"))
    return r.not_deferred(rows, registry).select("p_partkey", "candidate_group")
