"""Queries on fitted regime models: mixtures, the grid of settings, their choice, and stability under other seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fits, ranking
from ..sources import adapters as a
from .registry import query

#: Limits below which a mixture's assignment counts as unsure, and the quantile of a k-means cluster's distances.
LEAST_P, LEAST_MARGIN, FAR = 0.65, 0.10, 0.99
SEEDS = 5


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return a.read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))


def _components(spark, sf, covariance: str) -> DataFrame:
    rows = vectors(spark, sf)
    best = fits.best_starts(fits.fit_all(rows, fits.grid([("gmm", covariance)], [8])))
    good = [f for f in best if f.status == "converged"]
    found = fits.assigned(rows, good, ["vec_id"]).groupBy("component")
    return found.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("distance").alias("distance"))


@query("c2_diagonal_mixture")
def _(spark, sf):
    return _components(spark, sf, "diag")


@query("c2_tied_mixture")
def _(spark, sf):
    return _components(spark, sf, "tied")


def grid_table(spark: SparkSession, sf: str) -> DataFrame:
    """The best start of every setting, rejected ones with their reason."""
    rows = vectors(spark, sf)
    return fits.model_table(rows, fits.best_starts(fits.fit_all(rows, fits.grid())))


@query("c17_model_grid")
def _(spark, sf):
    return grid_table(spark, sf).drop("fit", "start")


@query("l12_model_choice")
def _(spark, sf):
    name = F.concat_ws("-", "family", "covariance", F.format_string("%02d", "k")).alias("model_id")
    rows = grid_table(spark, sf).select(name, "family", "silhouette", "bic", (F.col("status") == "converged").alias("eligible"))
    return ranking.family_winner(rows, ["gmm", "kmeans"])


def day_features(spark: SparkSession, sf: str) -> DataFrame:
    """symbol, opened_at, x: standardised return of a day and a week, range and volume against its mean, of daily order bars."""
    by = Window.partitionBy("symbol").orderBy("opened_at")
    rows = a.order_bars_1d(spark, sf)
    before = lambda n: F.lag("close", n).over(by)
    raw = rows.select(
        "symbol", "opened_at", F.log(F.col("close") / before(1)).alias("f0"), F.log(F.col("close") / before(5)).alias("f1"),
        F.log(F.col("high") / F.col("low")).alias("f2"), (F.col("volume") / F.avg("volume").over(by.rowsBetween(-19, 0))).alias("f3"),
    ).where("f1 is not null")
    names = ["f0", "f1", "f2", "f3"]
    scale = raw.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names))
    scaled = raw.join(F.broadcast(scale))  # one row
    return scaled.select("symbol", "opened_at", F.array(*(F.try_divide(F.col(c) - F.col(f"m_{c}"), f"s_{c}") for c in names)).alias("x"))


def refits(kinds: list[tuple[str, str, int]]) -> list[fits.Fit]:
    """Of every setting ``SEEDS`` fits from other starts."""
    return [fits.Fit(family, covariance, k, start) for family, covariance, k in kinds for start in range(SEEDS)]


def by_setting(done: list[fits.Fit]) -> dict[str, list[fits.Fit]]:
    out: dict[str, list[fits.Fit]] = {}
    for f in done:
        if f.status == "converged":
            out.setdefault("-".join(filter(None, (f.family, f.covariance, str(f.k)))), []).append(f)
    return out


@query("a43_seed_stability")
def _(spark, sf):
    """Every pair of refits of a k-means setting on the embeddings."""
    rows = vectors(spark, sf)
    done = fits.fit_all(rows, refits([("kmeans", "", 6)]))
    return fits.seed_stability(rows, [f for f in done if f.status == "converged"], "vec_id")


def model_evidence(rows: DataFrame, models: list[fits.Fit], key: list[str], ts: str) -> DataFrame:
    """fit, weekly_episodes, distinct_months, low_confidence_rate, prevalence_drift of each model (a component's least or largest).

    The drift is the largest change of a component's share between the rows before and after the middle of the time range.
    """
    found = fits.assigned(rows, models, [*key, ts])
    edges = rows.agg(F.min(F.unix_seconds(ts)).alias("lo"), F.max(F.unix_seconds(ts)).alias("hi"))
    found = found.join(F.broadcast(edges)).withColumn("late", F.unix_seconds(ts) > (F.col("lo") + F.col("hi")) / 2)  # one row
    limits = found.groupBy("fit", "component").agg(F.percentile_approx("distance", FAR, 10000).alias("limit"))
    found = found.join(F.broadcast(limits), ["fit", "component"])  # a row a component
    unsure = F.when(F.col("p").isNull(), F.col("distance") > F.col("limit")).otherwise((F.col("p") < LEAST_P) | (F.col("p") - F.col("second_p") < LEAST_MARGIN))
    each = found.groupBy("fit", "component").agg(
        F.countDistinct(F.date_trunc("week", ts)).alias("weeks"), F.countDistinct(F.date_trunc("month", ts)).alias("months"),
        F.count(F.when(unsure, 1)).alias("unsure"), F.count(F.when(F.col("late"), 1)).alias("late"), F.count(F.when(~F.col("late"), 1)).alias("early"),
    )
    own = Window.partitionBy("fit")
    moved = F.abs(F.try_divide("late", F.sum("late").over(own)) - F.try_divide("early", F.sum("early").over(own)))
    return each.withColumn("moved", moved).groupBy("fit").agg(
        F.min("weeks").alias("weekly_episodes"), F.min("months").alias("distinct_months"), (F.sum("unsure") / F.sum(F.col("late") + F.col("early"))).alias("low_confidence_rate"), F.max("moved").alias("prevalence_drift")
    )


@query("c10_fitted_gates")
def _(spark, sf):
    """The gates over real refits of models of daily order bars; a setting whose fits were rejected has no row."""
    rows = day_features(spark, sf)
    models = by_setting(fits.fit_all(rows, refits([("kmeans", "", 3), ("kmeans", "", 5), ("gmm", "diag", 3), ("gmm", "tied", 3)])))
    names = sorted(n for n, own in models.items() if len(own) > 1)
    first = [max(models[n], key=lambda f: f.score) for n in names]
    held = F.array(*(F.lit(n) for n in names))
    evidence = model_evidence(rows, first, ["symbol"], "opened_at").select(held[F.col("fit")].alias("model_id"), "weekly_episodes", "distinct_months", "low_confidence_rate", "prevalence_drift")
    keyed = rows.withColumn("row_key", F.struct("symbol", "opened_at"))
    stable = None
    for n in names:
        own = fits.seed_stability(keyed, models[n], "row_key").agg(F.min("ari").alias("seed_ari"), F.min("nmi").alias("seed_nmi"), F.max("centroid_distance").alias("centroid_distance")).withColumn("model_id", F.lit(n))
        stable = own if stable is None else stable.unionByName(own)
    return ranking.gated(evidence.join(F.broadcast(stable), "model_id"), ranking.GATES)
