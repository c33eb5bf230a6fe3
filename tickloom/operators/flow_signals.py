"""Rules that also read order flow, open interest, positioning and funding.

Input rows are bars with ``flow_delta``, ``volume``, ``open_interest``, ``ratio`` and ``rate`` (null where a
source had nothing fresh). A rule whose feature is missing waits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .signals import clamp, inverted, momentum_burst, range_edge, signal
from .windows import by_time, full, prior_full, shift


def with_features(bars: DataFrame, flow: DataFrame, metrics: DataFrame, funding: DataFrame) -> DataFrame:
    rows = bars.join(flow.select("symbol", "opened_at", "flow_delta"), ["symbol", "opened_at"], "left")
    rows = asof_join(rows, metrics.select("symbol", "metric_at", "open_interest", "ratio"), ["symbol"], "closed_at", "metric_at", 3600)
    return asof_join(rows, funding, ["symbol"], "closed_at", "funding_at", 8 * 3600).drop("metric_at", "funding_at")


def share() -> Column:
    return F.try_divide(F.col("flow_delta"), F.col("volume"))


def flow_breakout(rows: DataFrame, w: int = 24, least: float = 0.1) -> DataFrame:
    """A break of the prior range that the signed flow confirms."""
    rows = rows.withColumn("ph", prior_full(F.max("high"), w)).withColumn("pl", prior_full(F.min("low"), w)).withColumn("f", share())
    return signal(rows, (F.col("close") > F.col("ph")) & (F.col("f") >= least), (F.col("close") < F.col("pl")) & (F.col("f") <= -least), clamp(F.abs("f"), 0.1, 1.0))


def flow_exhaustion(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """One-sided flow that did not move the price its way."""
    rows = rows.withColumn("f", share())
    return signal(rows, (F.col("f") <= -least) & (F.col("close") > F.col("open")), (F.col("f") >= least) & (F.col("close") < F.col("open")), clamp(F.abs("f"), 0.1, 1.0))


def interest_impulse(rows: DataFrame, n: int = 3, least: float = 0.2) -> DataFrame:
    """Open interest and price that rise or fall together: new positions follow the move."""
    rows = rows.withColumn("oi", F.try_divide(F.col("open_interest"), shift("open_interest", n)) - 1).withColumn("move", F.col("close") / shift("close", n) - 1)
    grown = F.col("oi") >= least
    return signal(rows, grown & (F.col("move") >= least), grown & (F.col("move") <= -least), clamp(F.col("oi"), 0.1, 1.0))


def crowding(rows: DataFrame, w: int = 48, z: float = 1.5) -> DataFrame:
    """Against a positioning ratio far from its mean."""
    rows = rows.withColumn("z", F.try_divide(F.col("ratio") - full(F.avg("ratio"), w, "ratio"), full(F.stddev_pop("ratio"), w, "ratio")))
    return signal(rows, F.col("z") <= -z, F.col("z") >= z, clamp(F.abs("z") / 4, 0.1, 1.0))


def interest_divergence(rows: DataFrame, n: int = 6) -> DataFrame:
    """A move that loses open interest is faded."""
    rows = rows.withColumn("oi", F.col("open_interest") - shift("open_interest", n)).withColumn("move", F.col("close") / shift("close", n) - 1)
    left = F.col("oi") < 0
    return signal(rows, left & (F.col("move") < -0.1), left & (F.col("move") > 0.1), clamp(F.abs("move"), 0.1, 1.0))


def ratio_shock(rows: DataFrame, least: float = 0.5) -> DataFrame:
    rows = rows.withColumn("jump", F.try_divide(F.col("ratio") - shift("ratio", 1), shift("ratio", 1)))
    return signal(rows, F.col("jump") <= -least, F.col("jump") >= least, clamp(F.abs("jump"), 0.1, 1.0))


def funding_reversion(rows: DataFrame, least: float = 0.002) -> DataFrame:
    """Against a funding rate far from zero once the bar turns."""
    return signal(rows, (F.col("rate") <= -least) & (F.col("close") > F.col("open")), (F.col("rate") >= least) & (F.col("close") < F.col("open")), clamp(F.abs("rate") * 100, 0.1, 1.0))


def trend_on_two_scales(rows: DataFrame, slow: int = 48, fast: int = 6) -> DataFrame:
    """The slow trend decides the side, a fast pull-back that ends gives the time."""
    rows = rows.withColumn("slow", full(F.avg("close"), slow)).withColumn("fast", full(F.avg("close"), fast))
    up = (F.col("close") > F.col("slow")) & (shift("close", 1) < shift("fast", 1)) & (F.col("close") > F.col("fast"))
    down = (F.col("close") < F.col("slow")) & (shift("close", 1) > shift("fast", 1)) & (F.col("close") < F.col("fast"))
    return signal(rows, up, down, F.lit(0.6))


def donchian_breakout(rows: DataFrame, w: int = 55, every: int = 4) -> DataFrame:
    """A break of a long range, asked only at every ``every``-th hour."""
    rows = rows.withColumn("ph", prior_full(F.max("high"), w)).withColumn("pl", prior_full(F.min("low"), w)).withColumn("gate", F.hour("opened_at") % every == 0)
    return signal(rows, F.col("gate") & (F.col("close") > F.col("ph")), F.col("gate") & (F.col("close") < F.col("pl")), F.lit(0.6))


def mean_distance(rows: DataFrame, w: int = 24, z: float = 1.5) -> DataFrame:
    """Reversion to the mean of the prior bars."""
    rows = rows.withColumn("d", F.try_divide(F.col("close") - prior_full(F.avg("close"), w), prior_full(F.stddev_pop("close"), w)))
    return signal(rows, F.col("d") <= -z, F.col("d") >= z, clamp(F.abs("d") / 4, 0.1, 1.0))


def snapback(rows: DataFrame, n: int = 4, least: float = 0.3) -> DataFrame:
    """A fast move of n bars that closes back over the last open."""
    rows = rows.withColumn("move", shift("close", 1) / shift("close", 1 + n) - 1)
    return signal(rows, (F.col("move") <= -least) & (F.col("close") > shift("open", 1)), (F.col("move") >= least) & (F.col("close") < shift("open", 1)), clamp(F.abs("move"), 0.1, 1.0))


def impulse_pullback(rows: DataFrame) -> DataFrame:
    """A large bar, a small one against it, and a third that goes on."""
    b = lambda n: shift("close", n) - shift("open", n)
    big = F.abs(b(2)) >= 2 * F.abs(b(1))
    up = big & (b(2) > 0) & (b(1) < 0) & (F.col("close") > shift("high", 1))
    down = big & (b(2) < 0) & (b(1) > 0) & (F.col("close") < shift("low", 1))
    return signal(rows, up, down, F.lit(0.6))


def opening_range(rows: DataFrame, hours: int = 1) -> DataFrame:
    """Breaks of the range of the first hours of the UTC day, later that day."""
    from pyspark.sql import Window

    day = Window.partitionBy("symbol", F.to_date("opened_at"))
    first = F.hour("opened_at") < hours
    rows = rows.withColumn("rh", F.max(F.when(first, F.col("high"))).over(day)).withColumn("rl", F.min(F.when(first, F.col("low"))).over(day))
    return signal(rows, ~first & (F.col("close") > F.col("rh")), ~first & (F.col("close") < F.col("rl")), F.lit(0.55))


def micro_router(rows: DataFrame, w: int = 24) -> DataFrame:
    """Loud bars follow bursts, quiet ones trade the range; the volatility window holds the current bar."""
    loud = rows.select("symbol", "opened_at", (full(F.stddev_pop("close"), 6) > full(F.stddev_pop("close"), w)).alias("loud"))
    parts = []
    for name, df in (("b", momentum_burst(rows)), ("e", range_edge(rows, w))):
        parts.append(df.select("symbol", "opened_at", F.col("direction").alias(f"d{name}"), F.col("confidence").alias(f"c{name}")))
    out = loud.join(parts[0], ["symbol", "opened_at"]).join(parts[1], ["symbol", "opened_at"])
    pick = lambda k, other: F.when(F.col("loud"), F.col(f"{k}b")).when(~F.col("loud"), F.col(f"{k}e")).otherwise(other)
    return out.select("symbol", "opened_at", pick("d", F.lit("wait")).alias("direction"), pick("c", F.lit(0.0)).alias("confidence"))


def faded(rows: DataFrame) -> DataFrame:
    return inverted(rows)


def last_rows(order: str = "opened_at"):
    return by_time(order=order)
