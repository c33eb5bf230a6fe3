"""Rules on higher time frames: returns and ranges over thousands of bars, looked at on an interval of the day.

The extremes of ``p`` bars before a bar are put together from the end of the block where the window begins, whole blocks, and the
beginning of the block where it ends. Running extremes of a block and extremes of blocks are computed once, so a bar costs the
same whatever ``p`` is. A bar has features once ``p + 1`` bars lie before it, ``p`` being the longest period. Defaults of
parameters are fixed values, in bars of a minute.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import signal
from .windows import by_time, shift


def prior_extremes(rows: DataFrame, p: int, high: str, low: str) -> DataFrame:
    """Adds the highest high and the lowest low of the ``p`` bars before each bar (p > 1); null where there are fewer."""
    size = max(isqrt(p) // 2, 1)
    rows = rows.withColumn("__i", F.row_number().over(by_time()) - 1).withColumn("__b", F.floor(F.col("__i") / size))
    block = Window.partitionBy("symbol", "__b").orderBy("__i")
    begin, end = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    few = (p - 1) // size - 1  # whole blocks between the two ends: these or one more
    parts = rows.groupBy("symbol", "__b").agg(F.max("high").alias("__h"), F.min("low").alias("__l"))
    order = Window.partitionBy("symbol").orderBy("__b")
    for name, column, extreme, join in ((high, "high", F.max, F.greatest), (low, "low", F.min, F.least)):
        rows = rows.withColumn("__first", extreme(column).over(begin)).withColumn("__last", extreme(column).over(end))
        rows = rows.withColumn(f"__left_{column}", shift("__last", p)).withColumn(f"__right_{column}", shift("__first", 1)).drop("__first", "__last")
        for k in (few, few + 1):
            value = extreme("__h" if column == "high" else "__l").over(order.rowsBetween(-k, -1)) if k > 0 else F.lit(None).cast("double")
            parts = parts.withColumn(f"__{column}_{k}", value)
    parts = parts.drop("__h", "__l").withColumnRenamed("__b", "__to")
    rows = rows.withColumn("__to", shift("__b", 1)).withColumn("__from", shift("__b", p)).join(parts, ["symbol", "__to"], "left")
    whole = F.col("__to") - F.col("__from") - 1
    for name, column, join in ((high, "high", F.greatest), (low, "low", F.least)):
        between = F.when(whole == few, F.col(f"__{column}_{few}")).otherwise(F.col(f"__{column}_{few + 1}"))
        rows = rows.withColumn(name, F.when(F.col("__from").isNotNull(), join(f"__left_{column}", f"__right_{column}", between)))
    return rows.drop(*(c for c in rows.columns if c.startswith("__")))


def featured(rows: DataFrame, interval: int, returns: dict[str, int], ranges: dict[str, int]) -> DataFrame:
    """Adds warm, returns and prior ranges (<name>_high, <name>_low); ``warm`` also asks for the interval of the day."""
    longest = max(*returns.values(), *ranges.values())
    for name, p in returns.items():
        rows = rows.withColumn(name, F.col("close") / shift("close", p) - 1)
    rows = rows.withColumn("warm", shift("opened_at", longest + 1).isNotNull())
    for name, p in ranges.items():
        rows = prior_extremes(rows, p, f"{name}_high", f"{name}_low")
    minute = F.hour("opened_at") * 60 + F.minute("opened_at")
    return rows.withColumn("warm", F.col("warm") & (minute % max(interval, 1) == 0))


def donchian(rows: DataFrame, trend: int = 4320, confirm: int = 1440, breakout: int = 720, least_trend: float = 0.03, least_confirm: float = 0.008, buffer: float = 0.001, interval: int = 360) -> DataFrame:
    """A close beyond the range of the bars before, along a trend and a shorter move."""
    rows = featured(rows, interval, {"gain": trend, "confirm": confirm}, {"range": breakout})
    long = F.col("warm") & (F.col("gain") >= least_trend) & (F.col("confirm") >= least_confirm) & (F.col("close") > F.col("range_high") * (1 + buffer))
    short = F.col("warm") & (F.col("gain") <= -least_trend) & (F.col("confirm") <= -least_confirm) & (F.col("close") < F.col("range_low") * (1 - buffer))
    return signal(rows, long, short, F.lit(1.0))


def pullback(
    rows: DataFrame, trend: int = 10080, confirm: int = 2880, recent: int = 720, reclaim: int = 120, least_trend: float = 0.06, least_confirm: float = 0.012, least_pullback: float = 0.012, buffer: float = 0.001, interval: int = 360
) -> DataFrame:
    """Along a trend and a shorter move: the previous close well off the recent extreme, and a close beyond the last bars' range."""
    rows = featured(rows, interval, {"gain": trend, "confirm": confirm}, {"recent": recent, "reclaim": reclaim}).withColumn("c1", shift("close", 1))
    fallen, risen = (F.col("recent_high") - F.col("c1")) / F.col("recent_high"), (F.col("c1") - F.col("recent_low")) / F.col("c1")
    long = F.col("warm") & (F.col("gain") >= least_trend) & (F.col("confirm") >= least_confirm) & (fallen >= least_pullback) & (F.col("close") > F.col("reclaim_high") * (1 + buffer))
    short = F.col("warm") & (F.col("gain") <= -least_trend) & (F.col("confirm") <= -least_confirm) & (risen >= least_pullback) & (F.col("close") < F.col("reclaim_low") * (1 - buffer))
    return signal(rows, long, short, F.lit(1.0))


def acceleration(
    rows: DataFrame, trend: int = 20160, fast: int = 1440, slow: int = 4320, least_trend: float = 0.08, least_fast: float = 0.015, least_slow: float = 0.03, most_extension: float = 0.10, interval: int = 720
) -> DataFrame:
    """Trend, slow and fast move the same way, while the close is not far from the other end of the slow range."""
    rows = featured(rows, interval, {"gain": trend, "fast": fast, "slow": slow}, {"slow": slow})
    above, below = (F.col("close") - F.col("slow_low")) / F.col("slow_low"), (F.col("slow_high") - F.col("close")) / F.col("slow_high")
    long = F.col("warm") & (F.col("gain") >= least_trend) & (F.col("fast") >= least_fast) & (F.col("slow") >= least_slow) & (above <= most_extension)
    short = F.col("warm") & (F.col("gain") <= -least_trend) & (F.col("fast") <= -least_fast) & (F.col("slow") <= -least_slow) & (below <= most_extension)
    return signal(rows, long, short, F.lit(1.0))
