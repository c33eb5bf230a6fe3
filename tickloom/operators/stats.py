"""Cluster, regime and drift statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balance(rows: DataFrame, label: str, labels: int) -> DataFrame:
    """Counts of all labels 0..labels-1 (zeros included), shares, and the share-weighted entropy terms."""
    spine = rows.sparkSession.range(labels).select(F.col("id").cast("int").alias(label))
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = F.broadcast(spine).join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))
    share = F.try_divide("n", F.sum("n").over(Window.partitionBy()))  # one row a label
    return out.withColumn("share", F.coalesce(share, F.lit(0.0)))


def entropy(rows: DataFrame, label: str, labels: int) -> DataFrame:
    """Normalised entropy, smallest and largest share."""
    term = F.when(F.col("share") > 0, -F.col("share") * F.log("share")).otherwise(0.0)
    return balance(rows, label, labels).agg((F.sum(term) / F.log(F.lit(float(labels)))).alias("entropy"), F.min("share").alias("least"), F.max("share").alias("most"))


def quarterly(rows: DataFrame, ts: str, label: str) -> DataFrame:
    """Quarter by label counts, zero-filled, with a warning where a label has none or over half."""
    q = F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")).alias("quarter")
    counts = rows.groupBy(q, label).agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("quarter").distinct().crossJoin(F.broadcast(counts.select(label).distinct()))  # labels: a fixed set
    out = grid.join(counts, ["quarter", label], "left").select("quarter", label, F.coalesce("n", F.lit(0)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("quarter"))
    return out.withColumn("share", share).withColumn("warning", (F.col("n") == 0) | (F.col("share") > 0.5))


def envelope(train: DataFrame, rows: DataFrame, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """Per dimension: how many values lie below or above the training quantiles, and their shares."""
    q = train.groupBy("dim").agg(F.percentile("x", [low, high]).alias("q"))
    r = rows.join(F.broadcast(q), "dim")  # one row a dimension
    count = lambda c: F.count(F.when(c, 1))
    out = r.groupBy("dim").agg(count(F.col("x") < F.col("q")[0]).alias("below"), count(F.col("x") > F.col("q")[1]).alias("above"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", (F.col("below") + F.col("above")) / F.col("n"))


def divergence(one: DataFrame, two: DataFrame, label: str) -> DataFrame:
    """Jensen-Shannon divergence (natural logarithm) of two label distributions."""
    dist = lambda df, name: df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).select(label, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))
    rows = dist(one, "p").join(dist(two, "q"), label, "full").na.fill(0.0, ["p", "q"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return rows.agg((F.sum(term("p")) / 2 + F.sum(term("q")) / 2).alias("divergence"), F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"), F.max(F.abs(F.col("p") - F.col("q"))).alias("largest"))


def effective_size(rows: DataFrame, key: str, order: str, flag: str, lags: int = 30) -> DataFrame:
    """Effective sample size of an indicator series by Geyer's initial positive pairs, lags 1..``lags``.

    n / tau with tau = 1 + 2 * sum of autocorrelations up to the first non-positive pair sum, at least 1.
    """
    by = Window.partitionBy(key).orderBy(order)
    whole = Window.partitionBy(key)
    x = rows.withColumn("d", F.col(flag).cast("double") - F.avg(F.col(flag).cast("double")).over(whole))
    x = x.select(key, "d", *(F.lag("d", k).over(by).alias(f"l{k}") for k in range(1, lags + 1)))
    sums = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d") * F.col("d")).alias("v"), *(F.coalesce(F.sum(F.col("d") * F.col(f"l{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)))
    rho = F.array(*(F.try_divide(f"s{k}", "v") for k in range(1, lags + 1)))
    rows = sums.select(key, "n", "v", rho.alias("rho"))
    pairs = F.expr(f"transform(sequence(0, {lags // 2 - 1}), i -> rho[2 * i] + rho[2 * i + 1])")
    total = F.expr("aggregate(pairs, named_struct('on', true, 's', 0d), (a, p) -> named_struct('on', a.on and p > 0, 's', a.s + CASE WHEN a.on and p > 0 THEN p ELSE 0d END)).s")
    rows = rows.withColumn("pairs", pairs).withColumn("tau", F.greatest(F.lit(1.0), 1 + 2 * total))
    size = F.least(F.col("n").cast("double"), F.greatest(F.lit(1.0), F.col("n") / F.col("tau")))
    return rows.select(key, "n", F.when(F.col("v") > 0, size).otherwise(F.col("n").cast("double")).alias("ess"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    one = cells.groupBy(a).agg(F.sum("n").alias("na"))
    two = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    t = cells.agg(F.sum("n").alias("total"), F.sum(pairs("n")).alias("both"))
    ga = one.agg(F.sum(pairs("na")).alias("pa"), F.sum(F.col("na") * F.log("na")).alias("ea"))
    gb = two.agg(F.sum(pairs("nb")).alias("pb"), F.sum(F.col("nb") * F.log("nb")).alias("eb"))
    mi = cells.join(one, a).join(two, b).agg(F.sum(F.col("n") * F.log("n")).alias("eab"))
    x = t.crossJoin(ga).crossJoin(gb).crossJoin(mi)  # one row each
    expected = F.col("pa") * F.col("pb") / (F.col("total") * (F.col("total") - 1) / 2)
    n, ln = F.col("total"), F.log("total")
    ha, hb, hab = ln - F.col("ea") / n, ln - F.col("eb") / n, ln - F.col("eab") / n
    ari = F.try_divide(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected)
    return x.select(ari.alias("ari"), F.try_divide(ha + hb - hab, (ha + hb) / 2).alias("nmi"))


def assign(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Nearest centre by diagonal Gaussian: vec_id, component, p, second_p, squared and plain Mahalanobis distance.

    centres (component, dim, mean, var, weight) are a fitted model: a fixed small table, so broadcast.
    """
    rows = vectors.join(F.broadcast(centres), "dim")
    d2 = F.pow(F.col("x") - F.col("mean"), 2) / F.col("var")
    g = rows.groupBy("vec_id", "component").agg(F.sum(d2).alias("d2"), (F.log(F.first("weight")) - F.sum(F.log("var") + d2 + F.log(F.lit(2 * 3.141592653589793))) / 2).alias("lp"))
    best = Window.partitionBy("vec_id")
    g = g.withColumn("e", F.exp(F.col("lp") - F.max("lp").over(best)))
    g = g.withColumn("p", F.col("e") / F.sum("e").over(best))
    g = g.withColumn("rn", F.row_number().over(best.orderBy(F.desc(F.round("p", 12)), "component")))
    top = F.when(F.col("rn") == 1, F.struct("component", "p", "d2"))
    out = g.groupBy("vec_id").agg(F.max(top).alias("t"), F.max(F.when(F.col("rn") == 2, F.col("p"))).alias("second_p"))
    return out.select("vec_id", "t.component", "t.p", "second_p", F.col("t.d2").alias("distance_sq"), F.sqrt("t.d2").alias("distance"))
