"""Rules from bars to signals: pure columns over each symbol's trailing rows.

A signal is direction ('long', 'short' or 'wait') and confidence in 0..1. Range windows leave out the
current bar unless a rule says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import by_time, full, prior_full, shift


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def signal(bars: DataFrame, long: Column, short: Column, confidence: Column) -> DataFrame:
    """Adds direction and confidence; a condition that is null is false, long is asked first."""
    is_long, is_short = F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False))
    rows = bars.withColumn("direction", F.when(is_long, "long").when(is_short, "short").otherwise("wait"))
    return rows.withColumn("confidence", F.when(F.col("direction") == "wait", 0.0).otherwise(F.coalesce(confidence, F.lit(0.0))))


def inverted(rows: DataFrame) -> DataFrame:
    flip = F.when(F.col("direction") == "long", "short").when(F.col("direction") == "short", "long").otherwise("wait")
    return rows.withColumn("direction", flip)


def ma_signal(bars: DataFrame, w: int = 20, band: float = 0.0) -> DataFrame:
    """Close against its moving average; confidence is the distance, kept within 0.1 and 1."""
    rows = bars.withColumn("sma", full(F.avg("close"), w)).withColumn("distance", F.col("close") / F.col("sma") - 1)
    return signal(rows, F.col("distance") > band, F.col("distance") < -band, clamp(F.abs("distance"), 0.1, 1.0))


def range_position(bars: DataFrame, w: int) -> DataFrame:
    """prior_high, prior_low and where the close stands between them."""
    rows = bars.withColumn("prior_high", prior_full(F.max("high"), w)).withColumn("prior_low", prior_full(F.min("low"), w))
    return rows.withColumn("position", F.try_divide(F.col("close") - F.col("prior_low"), F.col("prior_high") - F.col("prior_low")))


def range_edge(bars: DataFrame, w: int = 48, band: float = 0.08) -> DataFrame:
    """Reversion at the edges of the prior range once the close turns back inside."""
    rows = range_position(bars, w)
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    edge = F.greatest(F.lit(band) - F.col("position"), F.col("position") - (1 - band))
    return signal(rows, (F.col("position") <= band) & up, (F.col("position") >= 1 - band) & down, clamp(0.5 + edge, 0.1, 1.0))


def compression_breakout(bars: DataFrame, short: int = 6, long: int = 48, squeeze: float = 0.7, push: float = 1.2) -> DataFrame:
    """A close outside a short range that is narrow against the long one, on raised volume."""
    rows = bars.withColumn("h1", prior_full(F.max("high"), short)).withColumn("l1", prior_full(F.min("low"), short))
    rows = rows.withColumn("h2", prior_full(F.max("high"), long)).withColumn("l2", prior_full(F.min("low"), long)).withColumn("v", prior_full(F.avg("volume"), short))
    narrow = (F.col("h1") - F.col("l1")) <= squeeze * (F.col("h2") - F.col("l2"))
    lively = F.col("volume") >= push * F.col("v")
    out = F.try_divide(F.greatest(F.col("close") - F.col("h1"), F.col("l1") - F.col("close")), F.col("close"))
    return signal(rows, narrow & lively & (F.col("close") > F.col("h1")), narrow & lively & (F.col("close") < F.col("l1")), clamp(out * 10, 0.1, 1.0))


def trend_pullback(bars: DataFrame, trend: int = 24, pull: int = 3) -> DataFrame:
    """A move against the trend of the last day that turns."""
    rows = bars.withColumn("trend", F.col("close") / shift("close", trend) - 1).withColumn("pull", shift("close", 1) / shift("close", 1 + pull) - 1)
    up, down = F.col("close") > shift("close", 1), F.col("close") < shift("close", 1)
    return signal(rows, (F.col("trend") > 0) & (F.col("pull") < 0) & up, (F.col("trend") < 0) & (F.col("pull") > 0) & down, clamp(F.abs("trend"), 0.1, 1.0))


def momentum_burst(bars: DataFrame, n: int = 3, least: float = 0.2, fade: bool = False) -> DataFrame:
    rows = bars.withColumn("burst", F.col("close") / shift("close", n) - 1).withColumn("v", prior_full(F.avg("volume"), 20))
    lively = F.col("volume") > F.col("v")
    rows = signal(rows, lively & (F.col("burst") >= least), lively & (F.col("burst") <= -least), clamp(F.abs("burst"), 0.1, 1.0))
    return inverted(rows) if fade else rows


def breakout_retest(bars: DataFrame, w: int = 24, skip: int = 3) -> DataFrame:
    """A range left ``skip`` bars ago whose edge held when it was touched again."""
    rows = bars.withColumn("edge_high", prior_full(F.max("high"), w, skip)).withColumn("edge_low", prior_full(F.min("low"), w, skip))
    rows = rows.withColumn("max_close", prior_full(F.max("close"), skip)).withColumn("min_close", prior_full(F.min("close"), skip))
    long = (F.col("max_close") > F.col("edge_high")) & (F.col("low") <= F.col("edge_high")) & (F.col("close") > F.col("edge_high"))
    short = (F.col("min_close") < F.col("edge_low")) & (F.col("high") >= F.col("edge_low")) & (F.col("close") < F.col("edge_low"))
    return signal(rows, long, short, F.lit(0.6))


def volatility_expansion(bars: DataFrame, w: int = 20, factor: float = 1.8) -> DataFrame:
    rows = bars.withColumn("span", F.col("high") - F.col("low"))
    rows = rows.withColumn("typical", prior_full(F.avg("span"), w))
    wide = F.col("span") >= factor * F.col("typical")
    where = F.try_divide(F.col("close") - F.col("low"), F.col("span"))
    return signal(rows, wide & (where >= 0.7), wide & (where <= 0.3), clamp(F.try_divide(F.col("span"), F.col("typical")) / 4, 0.1, 1.0))


def liquidity_sweep(bars: DataFrame, w: int = 24) -> DataFrame:
    """The prior extreme is passed but the close comes back inside."""
    rows = range_position(bars, w)
    long = (F.col("low") < F.col("prior_low")) & (F.col("close") > F.col("prior_low"))
    short = (F.col("high") > F.col("prior_high")) & (F.col("close") < F.col("prior_high"))
    return signal(rows, long, short, F.lit(0.55))


def dry_up_breakout(bars: DataFrame, w: int = 20, quiet: int = 3, factor: float = 0.7) -> DataFrame:
    """A breakout after bars of low volume."""
    rows = range_position(bars, w).withColumn("calm", prior_full(F.avg("volume"), quiet)).withColumn("usual", prior_full(F.avg("volume"), w, quiet))
    dry = F.col("calm") <= factor * F.col("usual")
    return signal(rows, dry & (F.col("close") > F.col("prior_high")), dry & (F.col("close") < F.col("prior_low")), F.lit(0.6))


def exhaustion(bars: DataFrame, w: int = 12, least: float = 0.3) -> DataFrame:
    """A stretched move with a closing turn; the window includes the current bar."""
    mean, dev = full(F.avg("close"), w), full(F.stddev_pop("close"), w)
    rows = bars.withColumn("stretch", F.try_divide(F.col("close") - mean, dev))
    up, down = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    return signal(rows, (F.col("stretch") <= -1 - least) & up, (F.col("stretch") >= 1 + least) & down, clamp(F.abs("stretch") / 4, 0.1, 1.0))


def three_push(bars: DataFrame) -> DataFrame:
    """Three rising highs with shrinking bodies, or three falling lows."""
    body = F.abs(F.col("close") - F.col("open"))
    rows = bars.withColumn("body", body)
    tired = (F.col("body") < F.lag("body").over(by_time())) & (F.lag("body").over(by_time()) < F.lag("body", 2).over(by_time()))
    rising = (F.col("high") > shift("high", 1)) & (shift("high", 1) > shift("high", 2))
    falling = (F.col("low") < shift("low", 1)) & (shift("low", 1) < shift("low", 2))
    return signal(rows, falling & tired, rising & tired, F.lit(0.5))


def router(bars: DataFrame, trend: int = 24, limit: float = 0.3) -> DataFrame:
    """The first leg that does not wait: pull-back, then burst, then range edge where the trend is weak."""
    legs = []
    for name, rows in (("pull", trend_pullback(bars, trend)), ("burst", momentum_burst(bars)), ("edge", range_edge(bars))):
        legs.append(rows.select("symbol", "opened_at", F.col("direction").alias(f"d_{name}"), F.col("confidence").alias(f"c_{name}")))
    rows = bars.withColumn("strength", F.abs(F.col("close") / shift("close", trend) - 1))
    for leg in legs:
        rows = rows.join(leg, ["symbol", "opened_at"])
    edge = F.coalesce(F.col("strength") <= limit, F.lit(False))
    pick = lambda kind, other: F.when(F.col("d_pull") != "wait", F.col(f"{kind}_pull")).when(F.col("d_burst") != "wait", F.col(f"{kind}_burst")).when(edge, F.col(f"{kind}_edge")).otherwise(other)
    return rows.withColumn("direction", pick("d", F.lit("wait"))).withColumn("confidence", pick("c", F.lit(0.0)))


def vote(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Joins several strategies' rows: the side with more confidence wins, a tie waits; confidence is the winners' mean."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("confidence")).otherwise(0.0))
    mean = lambda d: F.avg(F.when(F.col("direction") == d, F.col("confidence")))
    rows = signals.groupBy(*keys).agg(side("long").alias("long_sum"), side("short").alias("short_sum"), mean("long").alias("long_mean"), mean("short").alias("short_mean"))
    diff = F.round(F.col("long_sum") - F.col("short_sum"), 9)
    rows = rows.withColumn("direction", F.when(diff > 0, "long").when(diff < 0, "short").otherwise("wait"))
    confidence = F.when(diff > 0, F.col("long_mean")).when(diff < 0, F.col("short_mean")).otherwise(0.0)
    return rows.withColumn("confidence", confidence).drop("long_mean", "short_mean")


def first_touch(bars: DataFrame, entries: DataFrame, stop: float, target: float, horizon: int) -> DataFrame:
    """Outcome of single trades by the first bar that touches stop or target, stop first; else the last close.

    Every entry meets the next ``horizon`` bars of its symbol by their row number: an equality join on
    blocks of rows, so no range join is needed.
    """
    numbered = bars.withColumn("rn", F.row_number().over(by_time()))
    starts = entries.join(numbered.select("symbol", "opened_at", "rn"), ["symbol", "opened_at"])
    starts = starts.select("symbol", "opened_at", "direction", F.col("close").alias("entry"), F.col("rn").alias("rn0"))
    later = starts.select("*", F.explode(F.sequence(F.col("rn0") + 1, F.col("rn0") + horizon)).alias("rn"))
    rows = later.join(numbered.select("symbol", "rn", "high", "low", "close"), ["symbol", "rn"])
    long = F.col("direction") == "long"
    stop_at = F.when(long, F.col("entry") * (1 - stop)).otherwise(F.col("entry") * (1 + stop))
    goal_at = F.when(long, F.col("entry") * (1 + target)).otherwise(F.col("entry") * (1 - target))
    stopped = F.when(long, F.col("low") <= stop_at).otherwise(F.col("high") >= stop_at)
    reached = F.when(long, F.col("high") >= goal_at).otherwise(F.col("low") <= goal_at)
    rows = rows.withColumn("hit", F.when(stopped, "stop").when(reached, "target")).withColumn("price", F.when(stopped, stop_at).when(reached, goal_at).otherwise(F.col("close")))
    rows = rows.withColumn("best", F.struct(F.when(F.col("hit").isNotNull(), 0).otherwise(1), F.when(F.col("hit").isNotNull(), F.col("rn")).otherwise(-F.col("rn"))))
    out = rows.groupBy("symbol", "opened_at", "direction", "entry", "rn0").agg(F.min_by(F.struct("hit", "price", "rn"), "best").alias("x"))
    side = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    return out.select("symbol", "opened_at", "direction", F.coalesce("x.hit", F.lit("end")).alias("reason"), (F.col("x.rn") - F.col("rn0")).alias("held"), (side * (F.col("x.price") / F.col("entry") - 1)).alias("ret"))
