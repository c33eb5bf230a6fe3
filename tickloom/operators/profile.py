"""Volume profiles: each bar's volume spread over its price bins, the fullest bin, and the value area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def volume_profile(bars: DataFrame, width: float, keys: list[str]) -> DataFrame:
    """keys, bin, volume: a bar gives each bin from floor(low/width) to floor(high/width) the same share."""
    lo, hi = F.floor(F.col("low") / width), F.floor(F.col("high") / width)
    rows = bars.select(*keys, (F.col("volume") / (hi - lo + 1)).alias("v"), F.explode(F.sequence(lo, hi)).alias("bin"))
    return rows.groupBy(*keys, "bin").agg(F.sum("v").alias("volume"))


def control_point(profile: DataFrame, keys: list[str]) -> DataFrame:
    """The bin of most volume, the lowest one of a tie."""
    return profile.groupBy(*keys).agg(F.max_by("bin", F.struct(F.round("volume", 9), -F.col("bin"))).alias("poc"), F.sum("volume").alias("total"))


def value_area(profile: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """keys, poc, area_low, area_high: grown from the control point to the heavier neighbour, the lower on a tie.

    Neighbours are the next bins that hold volume. The bins of one profile (a bounded price range) are
    folded in an array.
    """
    point = control_point(profile, keys)
    whole = profile.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "volume"))).alias("bins"))
    rows = whole.join(point, keys).withColumn("at", F.expr("array_position(transform(bins, b -> b.bin), poc)").cast("int"))
    grow = f"""aggregate(bins, named_struct('a', at, 'b', at, 'v', bins[at - 1].volume), (s, x) ->
      CASE WHEN s.v >= {share} * total - 1e-9 OR (s.a <= 1 AND s.b >= size(bins)) THEN s
           WHEN s.a > 1 AND (s.b >= size(bins) OR round(bins[s.a - 2].volume, 9) >= round(bins[s.b].volume, 9)) THEN named_struct('a', s.a - 1, 'b', s.b, 'v', s.v + bins[s.a - 2].volume)
           ELSE named_struct('a', s.a, 'b', s.b + 1, 'v', s.v + bins[s.b].volume) END)"""
    edge = lambda x: F.expr(f"bins[g.{x} - 1].bin")
    return rows.withColumn("g", F.expr(grow)).select(*keys, "poc", edge("a").alias("area_low"), edge("b").alias("area_high"), F.col("g.v").alias("area_volume"), "total")


def session_signals(bars: DataFrame, width: float, keys: list[str], share: float = 0.7, least_bars: int = 3, volume_factor: float = 1.2, wick: float = 0.4) -> DataFrame:
    """keys, opened_at, direction, decision, reason, confidence of each session's last bar against its profile.

    Exactly one of four triggers gives a signal: a rejection below or above the value area (a long wick,
    close back inside) or a close beyond it on volume; two at once, and a bar over the whole area, wait.
    """
    area = value_area(volume_profile(bars, width, keys), keys, share)
    last = bars.groupBy(*keys).agg(F.max_by(F.struct("opened_at", "open", "high", "low", "close", "volume"), "opened_at").alias("x"), F.count(F.lit(1)).alias("n"))
    rows = last.join(area, keys).select(*keys, "n", "total", "x.*", *((F.col(c) * width).alias(name) for c, name in (("poc", "point"), ("area_low", "bottom"), ("area_high", "top"))))
    return rows.select(*keys, "opened_at", *decided(width, least_bars, volume_factor, wick))


def decided(width: float, least_bars: int, volume_factor: float, wick: float) -> list[Column]:
    low, high, close, top, bottom, n = (F.col(c) for c in ("low", "high", "close", "top", "bottom", "n"))
    span = high - low
    wick_of = lambda part: F.when(span > 0, part / span).otherwise(0.0)
    usual = F.col("total") / n
    loud = F.col("volume") >= usual * volume_factor
    triggers = {
        "lower_rejection": (low < bottom) & (close >= bottom) & (wick_of(F.least("open", "close") - low) >= wick),
        "upper_rejection": (high > top) & (close <= top) & (wick_of(high - F.greatest("open", "close")) >= wick),
        "upper_breakout": (close >= top) & loud,
        "lower_breakout": (close <= bottom) & loud,
    }
    count = sum(t.cast("int") for t in triggers.values())
    kind = F.coalesce(*(F.when(t, F.lit(name)) for name, t in triggers.items()))
    waits = F.when(n < least_bars, "insufficient_bars").when(F.col("total") == 0, "empty_profile").when((low < bottom) & (high > top), "ambiguous_overlap").when(count > 1, "conflicting_signals")
    signal = waits.isNull() & (count == 1)
    calm = F.when((close > top) | (close < bottom), "unconfirmed_breakout").when(F.abs(close - F.col("point")) <= width, "balanced_near_point").otherwise("no_signal")
    distance = F.when(close > top, close - top).when(close < bottom, bottom - close).otherwise(F.least(F.abs(close - top), F.abs(close - bottom)))
    base = F.when(kind.endswith("rejection"), 0.45).otherwise(0.5)
    sure = base + F.least(F.lit(0.25), distance / width * 0.05) + F.least(F.lit(0.2), F.when(usual > 0, F.col("volume") / usual).otherwise(0.0) * 0.05)
    return [
        F.when(signal, F.when(kind.isin("lower_rejection", "upper_breakout"), 1).otherwise(-1)).otherwise(0).alias("direction"),
        F.when(signal, kind).otherwise("wait").alias("decision"),
        F.when(signal, kind).otherwise(F.coalesce(waits, calm)).alias("reason"),
        F.when(signal, F.least(F.lit(1.0), F.greatest(F.lit(0.1), sure))).otherwise(0.0).alias("confidence"),
    ]
