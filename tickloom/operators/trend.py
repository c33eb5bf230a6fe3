"""Rules on long trends: pull-backs, retests, breakouts, accelerations and exhausted moves; windows are counted in bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signals import signal
from .windows import full, prior_full, shift


def waited(rows: DataFrame, bars: int) -> DataFrame:
    """``rows`` with ``warm``: whether the rule has seen that many bars, the present one included."""
    return rows.withColumn("warm", shift("opened_at", bars - 1).isNotNull())


def pullback_resume(rows: DataFrame, trend: int = 2880, pullback: int = 240, trigger: int = 12, least_trend: float = 0.018, least_pullback: float = 0.004, resume: float = 0.0008) -> DataFrame:
    """A trend over ``trend`` bars, a close away from the extreme of the ``pullback`` bars before, and a move of ``trigger`` bars with the trend."""
    gain = lambda n: F.col("close") / shift("close", n) - 1
    rows = waited(rows, max(trend, pullback, trigger) + 2)
    rows = rows.withColumn("gain", gain(trend)).withColumn("move", gain(trigger)).withColumn("ph", prior_full(F.max("high"), pullback)).withColumn("pl", prior_full(F.min("low"), pullback))
    long = F.col("warm") & (F.col("gain") >= least_trend) & ((F.col("ph") - F.col("close")) / F.col("close") >= least_pullback) & (F.col("move") >= resume)
    short = F.col("warm") & (F.col("gain") <= -least_trend) & ((F.col("close") - F.col("pl")) / F.col("close") >= least_pullback) & (F.col("move") <= -resume)
    return signal(rows, long, short, F.lit(0.88))


def timed_acceleration(rows: DataFrame, trend: int = 1440, impulse: int = 15, least_trend: float = 0.01, least_impulse: float = 0.002, hour: int = 0, side: str = "both") -> DataFrame:
    """A trend and an impulse the same way, at the bar that opens at ``hour`` exactly."""
    gain = lambda n: F.col("close") / shift("close", n) - 1
    rows = waited(rows, max(trend, impulse) + 2).withColumn("gain", gain(trend)).withColumn("move", gain(impulse))
    at = F.col("warm") & (F.hour("opened_at") == hour) & (F.minute("opened_at") == 0)
    long = at & F.lit(side in ("both", "long")) & (F.col("gain") >= least_trend) & (F.col("move") >= least_impulse)
    short = at & F.lit(side in ("both", "short")) & (F.col("gain") <= -least_trend) & (F.col("move") <= -least_impulse)
    return signal(rows, long, short, F.lit(0.99))


def breakout_momentum(rows: DataFrame, w: int = 60, buffer: float = 0.001, n: int = 10, least: float = 0.001) -> DataFrame:
    """A close beyond the range of the ``w`` bars before, with a move of ``n`` bars the same way."""
    rows = rows.withColumn("ph", prior_full(F.max("high"), w)).withColumn("pl", prior_full(F.min("low"), w)).withColumn("move", F.col("close") / shift("close", n) - 1)
    long = (F.col("close") > F.col("ph") * (1 + buffer)) & (F.col("move") >= least)
    return signal(rows, long, (F.col("close") < F.col("pl") * (1 - buffer)) & (F.col("move") <= -least), F.lit(0.8))


def selective_breakout(rows: DataFrame, w: int = 720, buffer: float = 0.002, trend: int = 1440, least: float = 0.01, cooldown: int = 240) -> DataFrame:
    """A breakout along a long trend; bars must have moved on in time over the last ``cooldown`` of them."""
    rows = rows.withColumn("ph", prior_full(F.max("high"), w)).withColumn("pl", prior_full(F.min("low"), w)).withColumn("gain", F.col("close") / shift("close", trend) - 1)
    cool = F.coalesce(F.col("opened_at") > shift("opened_at", cooldown), F.lit(True))
    long = cool & (F.col("gain") >= least) & (F.col("close") > F.col("ph") * (1 + buffer))
    return signal(rows, long, cool & (F.col("gain") <= -least) & (F.col("close") < F.col("pl") * (1 - buffer)), F.lit(1.0))


def swing_retest(rows: DataFrame, trend: int = 4320, pullback: int = 720, least: float = 0.03, depth: float = 0.01, reclaim: float = 0.003) -> DataFrame:
    """In a long trend, a previous close well off the extreme of the bars before, and a close that takes it back."""
    rows = waited(rows, max(trend, pullback) + 2).withColumn("gain", F.col("close") / shift("close", trend) - 1).withColumn("c1", shift("close", 1))
    rows = rows.withColumn("ph", prior_full(F.max("high"), pullback)).withColumn("pl", prior_full(F.min("low"), pullback))
    long = F.col("warm") & (F.col("gain") >= least) & (F.col("ph") > 0) & ((F.col("ph") - F.col("c1")) / F.col("ph") >= depth) & (F.col("close") >= F.col("c1") * (1 + reclaim))
    short = F.col("warm") & (F.col("gain") <= -least) & (F.col("c1") > 0) & ((F.col("c1") - F.col("pl")) / F.col("c1") >= depth) & (F.col("close") <= F.col("c1") * (1 - reclaim))
    return signal(rows, long, short, F.lit(1.0))


def exhaustion_reversal(rows: DataFrame, move: int = 240, extreme: float = 0.02, turn: int = 20, reclaim: float = 0.002, w: int = 720, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """A far move that has begun to turn while the close is still in the outer part of the range, this bar included."""
    rows = waited(rows, max(move, turn, w) + 1).withColumn("gain", F.col("close") / shift("close", move) - 1).withColumn("back", F.col("close") / shift("close", turn) - 1)
    rows = rows.withColumn("rh", full(F.max("high"), w)).withColumn("rl", full(F.min("low"), w))
    place = F.try_divide(F.col("close") - F.col("rl"), F.col("rh") - F.col("rl"))
    long = F.col("warm") & (F.col("gain") <= -extreme) & (F.col("back") >= reclaim) & (place <= low)
    return signal(rows, long, F.col("warm") & (F.col("gain") >= extreme) & (F.col("back") <= -reclaim) & (place >= high), F.lit(1.0))


#: Levels of the regime entry and exit, and what their confidence is made of.
ENTRY = {"short_adx": 20.0, "long_adx": 22.0, "atr_ratio": 0.004, "short_rsi": 57.0, "long_rsi": 43.0}
EXIT_LOW, EXIT_HIGH, EXIT_CONFIDENCE = 45.0, 55.0, 0.70


def regime_entry(rows: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Against a close beyond a band that goes with the averages: short above the upper one in a fall, long below the lower one in a rise.

    ``rows`` are of ``indicators.together``. Needs all indicators, a positive close and volume, a strong and wide enough market. Short is asked first; confidence grows with ADX and ATR.
    """
    k = ENTRY | (limits or {})
    ratio = F.try_divide(F.col("atr"), F.col("close"))
    known = F.col("ema_fast").isNotNull() & F.col("ema_slow").isNotNull() & F.col("rsi").isNotNull() & F.col("upper").isNotNull() & (F.col("close") > 0) & (F.col("volume") > 0)
    wide = known & (ratio > k["atr_ratio"])
    short = wide & (F.col("ema_fast") < F.col("ema_slow")) & (F.col("adx") > k["short_adx"]) & (F.col("close") > F.col("upper")) & (F.col("rsi") > k["short_rsi"])
    long = wide & (F.col("ema_fast") > F.col("ema_slow")) & (F.col("adx") > k["long_adx"]) & (F.col("close") < F.col("lower")) & (F.col("rsi") < k["long_rsi"])
    part = lambda x, low, span: F.least(F.greatest((x - low) / span, F.lit(0.0)), F.lit(1.0))
    sure = F.least(0.55 + 0.25 * part(F.col("adx"), 20.0, 20.0) + 0.20 * part(ratio, 0.004, 0.008), F.lit(0.98))
    return signal(rows, long & ~F.coalesce(short, F.lit(False)), short, sure)


def regime_exit(rows: DataFrame, close: str = "c_close") -> DataFrame:
    """Which side to leave: ``leave`` is long (asked first), short or keep, with confidence and reason.

    The close is read from a column of its own (``c_close``); where that is missing nothing is left.
    """
    price = F.col(close) if close in rows.columns else F.lit(None).cast("double")
    known = F.col("ema_slow").isNotNull() & F.col("rsi").isNotNull() & price.isNotNull()
    down, up = known & ((price < F.col("ema_slow")) | (F.col("rsi") < EXIT_LOW)), known & ((price > F.col("ema_slow")) | (F.col("rsi") > EXIT_HIGH))
    leave = F.when(down, "long").when(up, "short").otherwise("keep")
    reason = F.when(~known, "missing_required_fields").when(down, "exit_long_signal").when(up, "exit_short_signal").otherwise("keep_position")
    return rows.withColumn("leave", leave).withColumn("reason", reason).withColumn("confidence", F.when(F.col("leave") == "keep", 0.0).otherwise(EXIT_CONFIDENCE))
