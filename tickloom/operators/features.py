"""The chart-feature registry: windows of bars described at anchors, and preparation of vectors.

Features run over path = [first open, closes...]. A window with a zero denominator or a missing bar has
no vector (its row is left out). The long registry takes 7 days and 4-hour anchors, the short one 3 days
and midnight anchors. Each bar is dealt to the anchors whose window holds it (a fixed number of copies),
so all features are grouped aggregates and windows over (symbol, anchor), never over the whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = (
    "ret_4h", "ret_12h", "ret_1d", "ret_full", "rv_4h", "rv_1d", "rv_full", "rv_ratio", "range_ratio", "close_location",
    "efficiency_1d", "efficiency_full", "sign_change_full", "autocorr_full", "max_drawdown", "max_runup", "breakout_rate",
    "body_ratio", "upper_wick", "lower_wick", "volume_cv", "top_decile_volume", "volume_ratio",
)


def anchored(bars: DataFrame, bar_s: int, days: int, every_s: int) -> DataFrame:
    """Bars with (anchor_at, age): age 1 is the bar that closes at the anchor; whole windows only."""
    n = days * 86400 // bar_s
    close = F.unix_timestamp("closed_at")
    first = (F.ceil(close / every_s) * every_s).cast("long")
    last = F.unix_timestamp("opened_at") + days * 86400
    rows = bars.select("*", F.explode(F.sequence(first, F.greatest(first, last), F.lit(every_s).cast("long"))).alias("at"))
    rows = rows.where(F.col("at") <= last).withColumn("age", ((F.col("at") - close) / bar_s + 1).cast("int"))
    rows = rows.withColumn("anchor_at", F.timestamp_seconds("at")).drop("at")
    whole = Window.partitionBy("symbol", "anchor_at")
    return rows.withColumn("__n", F.count(F.lit(1)).over(whole)).where(F.col("__n") == n).drop("__n")


def registry(bars: DataFrame, bar_s: int = 900, days: int = 3, every_s: int = 86400, breakout: int = 96) -> DataFrame:
    """symbol, anchor_at and the features of NAMES."""
    day = 86400 // bar_s
    rows = anchored(bars, bar_s, days, every_s)
    order = Window.partitionBy("symbol", "anchor_at").orderBy(F.desc("age"))
    n = days * day
    rows = rows.withColumn("before", F.coalesce(F.lag("close").over(order), F.col("open")))
    safe = (F.col("before") > 0) & (F.col("close") > 0)
    rows = rows.withColumn("r", F.when(safe, F.log(F.col("close") / F.col("before")))).withColumn("step", F.col("close") - F.col("before"))
    rows = rows.withColumn("r0", F.lag("r").over(order)).withColumn("s0", F.lag("step").over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    start = F.first("open").over(upto)
    rows = rows.withColumn("peak", F.greatest(start, F.max("close").over(upto))).withColumn("trough", F.least(start, F.min("close").over(upto)))
    prior = order.rowsBetween(-breakout, -1)
    full = F.count(F.lit(1)).over(prior) == breakout
    rows = rows.withColumn("out", F.when(full, ((F.col("close") > F.max("high").over(prior)) | (F.col("close") < F.min("low").over(prior))).cast("double")))
    rows = rows.withColumn("span", F.col("high") - F.col("low"))
    rows = rows.withColumn("vrank", F.row_number().over(Window.partitionBy("symbol", "anchor_at").orderBy(F.desc("volume"), "age")))
    last = lambda x, k: F.when(F.col("age") <= k, x)
    shape = lambda x: F.avg(F.coalesce(F.try_divide(x, F.col("span")), F.lit(0.0)))
    base = lambda k: F.max(F.when(F.col("age") == k, F.col("open")))
    close = F.max(F.when(F.col("age") == 1, F.col("close")))
    top = -(-n // 10)
    g = rows.groupBy("symbol", "anchor_at").agg(
        *((close / base(k) - 1).alias(a) for a, k in (("ret_4h", day // 6), ("ret_12h", day // 2), ("ret_1d", day), ("ret_full", n))),
        *(F.stddev_pop(last(F.col("r"), k)).alias(a) for a, k in (("rv_4h", day // 6), ("rv_1d", day), ("rv_full", n))),
        ((F.max("high") - F.min("low")) / close).alias("range_ratio"),
        F.try_divide(close - F.min("low"), F.max("high") - F.min("low")).alias("close_location"),
        F.try_divide(F.abs(F.sum(last(F.col("step"), day))), F.sum(F.abs(last(F.col("step"), day)))).alias("efficiency_1d"),
        F.try_divide(F.abs(F.sum("step")), F.sum(F.abs("step"))).alias("efficiency_full"),
        F.coalesce(F.try_divide(F.count(F.when(F.col("step") * F.col("s0") < 0, 1)), F.count(F.when(F.col("step") * F.col("s0") != 0, 1))), F.lit(0.0)).alias("sign_change_full"),
        F.corr(F.when(F.col("r0").isNotNull(), F.col("r")), "r0").alias("autocorr_full"),
        F.max((F.col("peak") - F.col("close")) / F.col("peak")).alias("max_drawdown"),
        F.max((F.col("close") - F.col("trough")) / F.col("trough")).alias("max_runup"),
        F.avg("out").alias("breakout_rate"),
        shape(F.abs(F.col("close") - F.col("open"))).alias("body_ratio"),
        shape(F.col("high") - F.greatest("open", "close")).alias("upper_wick"),
        shape(F.least("open", "close") - F.col("low")).alias("lower_wick"),
        F.try_divide(F.stddev_pop("volume"), F.avg("volume")).alias("volume_cv"),
        F.try_divide(F.sum(F.when(F.col("vrank") <= top, F.col("volume"))), F.sum("volume")).alias("top_decile_volume"),
        F.try_divide(F.avg(last(F.col("volume"), day)), F.avg("volume")).alias("volume_ratio"),
    )
    g = g.withColumn("rv_ratio", F.try_divide("rv_1d", "rv_full"))
    g = g.select("symbol", "anchor_at", *NAMES)
    return g.dropna(subset=list(NAMES))


def rank_correlation(vectors: DataFrame) -> DataFrame:
    """Spearman's rho of every pair of dimensions of long rows (vec_id, dim, x); average ranks for ties.

    Average ranks come from counts of values, so no dimension is sorted in one task.
    """
    counts = vectors.groupBy("dim", "x").agg(F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("dim").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("rank", below + (F.col("n") + 1) / 2).drop("n")
    rows = vectors.join(ranks, ["dim", "x"]).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("dim", "rank"))).alias("d"))
    pair = F.flatten(F.transform("d", lambda p: F.transform(F.filter("d", lambda q: q["dim"] > p["dim"]), lambda q: F.struct(p["dim"].alias("a"), q["dim"].alias("b"), p["rank"].alias("ra"), q["rank"].alias("rb")))))
    return rows.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.corr("p.ra", "p.rb").alias("rho"))


def pruned(correlations: DataFrame, dims: list[int], limit: float = 0.95) -> list[int]:
    """Dimensions kept greedily in registry order: each must stay below ``limit`` with all kept ones."""
    strong = {(r.a, r.b) for r in correlations.where(F.abs("rho") >= limit).collect()}  # pairs of a fixed registry
    kept: list[int] = []
    for d in dims:
        if not any((k, d) in strong for k in kept):
            kept.append(d)
    return kept


def robust_scale(vectors: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Values clipped to the quantiles of their dimension, centred by the median and scaled by the IQR."""
    q = vectors.groupBy("dim").agg(F.percentile("x", [low, high]).alias("q"))
    rows = vectors.join(F.broadcast(q), "dim")  # one row a dimension
    rows = rows.withColumn("c", F.least(F.greatest("x", F.col("q")[0]), F.col("q")[1]))
    s = rows.groupBy("dim").agg(F.percentile("c", [0.25, 0.5, 0.75]).alias("s"))
    rows = rows.drop("q").join(F.broadcast(s), "dim")
    scale = F.when(F.col("s")[2] > F.col("s")[0], F.col("s")[2] - F.col("s")[0]).otherwise(1.0)
    return rows.select("vec_id", "dim", ((F.col("c") - F.col("s")[1]) / scale).alias("z"))


def ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x, y)
