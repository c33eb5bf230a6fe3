"""Rankings by several keys, winners of families, filters before ranks, and gates.

A key is a column expression and a direction; rows that agree in all keys are ordered by ``by`` id, so ranks
are unique and the same in every run. Ranks run inside ``group`` (a fold, a family, a month), whose
rows are candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The keys of each ranking, in order; "-" before an expression ranks small values first.
KEYS = {
    "train_test": [
        "test_trades_per_day >= 5", "test_trades_per_day <= 15", "test_win_rate >= 0.60", "train_return > 0", "test_return > 0",
        "test_daily_return", "train_daily_return", "-test_drawdown",
    ],
    "walk_forward": ["average_return > 0", "positive_folds", "average_daily_return", "average_trades_per_day", "average_win_rate", "-worst_drawdown"],
    "preference": ["-clipping_share", "-margin_tail_share", "-distance_tail_share", "-quarter_warnings", "least_effective_size", "-divergence", "-cluster_count"],
    "daily_winner": ["lower_bound", "without_best", "shortfall", "-max_drawdown", "median_return"],
    "weekly_winner": ["lower_bound", "median_return", "mean_return"],
    "validation_policy": ["return_ratio", "-max_drawdown", "-turnover"],
    "novel_train": ["win_rate >= 0.80", "average_gross >= 0.006", "return_ratio", "average_gross", "win_rate"],
    "scalping": ["test_trades_per_day >= 10", "test_roe >= 0.003", "test_win_rate >= 0.55", "test_return > 0", "train_return > 0", "test_return", "test_roe", "test_win_rate"],
    "validation": ["return_ratio", "win_rate", "average_return", "trades"],
    "train_selection": ["train_return", "train_roe", "train_win_rate", "train_trades_per_day", "-train_drawdown"],
}


def order_of(keys: Sequence[str], by: str) -> list[Column]:
    """Sort columns: large values first, those with '-' small ones first, nulls last, then the id."""
    out = [F.expr(k[1:]).asc_nulls_last() if k.startswith("-") else F.expr(k).desc_nulls_last() for k in keys]
    return [*out, F.col(by).asc()]


def ranked(rows: DataFrame, keys: Sequence[str], by: str, group: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place from 1 on in each group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order_of(keys, by))))


def first_of(rows: DataFrame, keys: Sequence[str], by: str, group: Sequence[str] = ()) -> DataFrame:
    return ranked(rows, keys, by, group).where("place = 1").drop("place")


def winners(rows: DataFrame, keys: Sequence[str], by: str, family: str) -> DataFrame:
    """The winner of every family, ``overall`` for the best of them."""
    own = first_of(rows, keys, by, [family])
    return ranked(own, keys, by).withColumn("overall", F.col("place") == 1).drop("place")


def family_winner(models: DataFrame, priority: Sequence[str]) -> DataFrame:
    """family, model_id, metric_name, metric, chosen of each family's winner.

    Families: kmeans by the largest silhouette, others by the smallest BIC; the first family of ``priority``
    that has an eligible model gives the chosen one. ``models``: model_id, family, silhouette, bic, eligible.
    """
    by_bic = F.col("family") != "kmeans"
    metric = F.when(by_bic, F.col("bic")).otherwise(F.col("silhouette"))
    rows = models.where("eligible").withColumn("metric", metric).where("metric is not null").withColumn("better", F.when(by_bic, -F.col("metric")).otherwise(F.col("metric")))
    rows = rows.where(F.col("family").isin(*priority))
    own = first_of(rows, ["better"], "model_id", ["family"])
    rank = F.array_position(F.array(*(F.lit(f) for f in priority)), F.col("family"))
    own = own.withColumn("rank", rank).withColumn("chosen", F.col("rank") == F.min("rank").over(Window.partitionBy(F.lit(0))))
    return own.select("family", "model_id", F.when(F.col("family") == "kmeans", "silhouette").otherwise("bic").alias("metric_name"), "metric", "chosen")


def targets(rows: DataFrame, least: dict[str, float]) -> DataFrame:
    """Rows that reach all minima."""
    for name, value in least.items():
        rows = rows.where(F.col(name) >= value)
    return rows


#: The limits of a regime model; "-" before a column makes the limit an upper one.
GATES = {
    "weekly_episodes": 8, "distinct_months": 3, "seed_ari": 0.8, "seed_nmi": 0.8,
    "-centroid_distance": 0.5, "-prevalence_drift": 0.2, "-low_confidence_rate": 0.25,
}


def gated(models: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Adds failed (the columns whose limit is missed or unknown, in order) and eligible."""
    checks = []
    for name, limit in gates.items():
        column = name.removeprefix("-")
        right = F.col(column) <= limit if name.startswith("-") else F.col(column) >= limit
        checks.append(F.when(~F.coalesce(right, F.lit(False)), F.lit(column)))
    failed = F.array_compact(F.array(*checks))
    return models.withColumn("failed", F.array_join(failed, ",")).withColumn("eligible", F.size(failed) == 0)


def family_cap(features: DataFrame, most_share: float = 0.5, most: int | None = None) -> DataFrame:
    """Families of retained features with their number and whether it keeps the cap (at most a half of all)."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    rows = features.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("total", total)
    right = F.col("n") <= most_share * F.col("total")
    return rows.withColumn("within_cap", right & (F.col("n") <= most) if most else right)


def not_deferred(candidates: DataFrame, registry: DataFrame, include_deferred: bool = False) -> DataFrame:
    """Candidates of no deferred group and with no deferred id pattern (SQL LIKE)."""
    if include_deferred:
        return candidates
    rows = candidates.join(F.broadcast(registry.where("candidate_group is not null").select("candidate_group").distinct()), "candidate_group", "left_anti")
    patterns = F.broadcast(registry.where("id_pattern is not null").select("id_pattern"))  # a written registry
    return rows.join(patterns, F.expr("candidate_id LIKE id_pattern"), "left_anti")


def parameters_of(components: Column, dims: Column, tied: Column) -> Column:
    """Free parameters of a Gaussian mixture with diagonal or tied covariance."""
    spread = F.when(tied, dims * (dims + 1) / 2).otherwise(components * dims)
    return components - 1 + components * dims + spread


def bic(log_likelihood: Column, rows: Column, parameters: Column) -> Column:
    return -2 * log_likelihood + parameters * F.log(rows)
