"""Technical indicators over bars, with the conventions users of the older engine rely on.

RSI is 0 where there were no losses; the MACD signal is the mean of the close, not of the line; CCI uses
the mean of the close; MFI is 50 without negative flow; OBV and MFI use quote volume (close times
volume).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recursive import ema_alpha, smooth
from .windows import by_time, full, running, shift, true_range


def with_quote(bars: DataFrame) -> DataFrame:
    return bars.withColumn("quote", F.col("close") * F.col("volume"))


def bollinger(bars: DataFrame, w: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = full(F.avg("close"), w), full(F.stddev_pop("close"), w)
    rows = bars.withColumn("mid", mid).withColumn("dev", dev)
    rows = rows.withColumn("upper", F.col("mid") + k * F.col("dev")).withColumn("lower", F.col("mid") - k * F.col("dev"))
    return rows.withColumn("width", F.try_divide(F.col("upper") - F.col("lower"), F.col("mid"))).drop("dev")


def donchian(bars: DataFrame, w: int = 20) -> DataFrame:
    return bars.withColumn("top", full(F.max("high"), w)).withColumn("bottom", full(F.min("low"), w))


def stochastic(bars: DataFrame, w: int = 14, d: int = 3) -> DataFrame:
    hi, lo = full(F.max("high"), w), full(F.min("low"), w)
    rows = bars.withColumn("raw_k", F.try_divide((F.col("close") - lo) * 100, hi - lo))
    rows = rows.withColumn("raw_d", full(F.avg("raw_k"), d, "raw_k"))
    return rows.withColumn("k", F.coalesce("raw_k", F.lit(0.0))).withColumn("d", F.coalesce("raw_d", F.lit(0.0))).drop("raw_k", "raw_d")


def ema(bars: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    rows = smooth(bars, {"ema_fast": ("close", ema_alpha(fast), fast), "ema_slow": ("close", ema_alpha(slow), slow)})
    return rows.withColumn("gap", F.col("ema_fast") - F.col("ema_slow")).withColumn("gap_ratio", F.try_divide("gap", "close"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    rows = smooth(bars, {"ema_fast": ("close", ema_alpha(fast), fast), "ema_slow": ("close", ema_alpha(slow), slow), "signal": ("close", ema_alpha(signal), signal)})
    return rows.withColumn("macd", F.col("ema_fast") - F.col("ema_slow")).withColumn("hist", F.col("macd") - F.col("signal"))


def rsi(bars: DataFrame, w: int = 14) -> DataFrame:
    rows = with_rsi(smooth(with_steps(bars), {"avg_gain": ("gain", 1 / w, w), "avg_loss": ("loss", 1 / w, w)}))
    return rows.drop("gain", "loss", "avg_gain", "avg_loss")


def with_steps(bars: DataFrame) -> DataFrame:
    """Adds gain and loss of the close."""
    step = F.coalesce(F.col("close") - shift("close", 1), F.lit(0.0))
    return bars.withColumn("gain", F.greatest(step, F.lit(0.0))).withColumn("loss", F.greatest(-step, F.lit(0.0)))


def with_rsi(rows: DataFrame) -> DataFrame:
    """Adds rsi from the means of gain and loss."""
    value = 100 - 100 / (1 + F.try_divide("avg_gain", "avg_loss"))
    return rows.withColumn("rsi", F.when(F.col("avg_loss") > 0, value).otherwise(0.0))


def atr(bars: DataFrame, w: int = 14) -> DataFrame:
    return smooth(bars.withColumn("tr", true_range()), {"atr": ("tr", 1 / w, w)})


def keltner(bars: DataFrame, w: int = 20, atr_w: int = 14, k: float = 2.0) -> DataFrame:
    rows = smooth(bars.withColumn("tr", true_range()), {"atr": ("tr", 1 / atr_w, atr_w), "mid": ("close", ema_alpha(w), w)})
    return rows.withColumn("upper", F.col("mid") + k * F.col("atr")).withColumn("lower", F.col("mid") - k * F.col("atr"))


def dmi(bars: DataFrame, w: int = 14) -> DataFrame:
    rows = smooth(with_moves(bars), {"atr": ("tr", 1 / w, w), "sp": ("plus_dm", 1 / w, w), "sm": ("minus_dm", 1 / w, w)})
    return with_adx(rows, w).select(*bars.columns, "plus_di", "minus_di", "adx")


def with_moves(bars: DataFrame) -> DataFrame:
    """Adds the true range and the directional moves."""
    up, down = F.col("high") - shift("high", 1), shift("low", 1) - F.col("low")
    rows = bars.withColumn("tr", true_range()).withColumn("plus_dm", F.when((up > down) & (up > 0), up).otherwise(0.0))
    return rows.withColumn("minus_dm", F.when((down > up) & (down > 0), down).otherwise(0.0))


def with_adx(rows: DataFrame, w: int) -> DataFrame:
    """Adds plus_di, minus_di and adx from the means atr, sp and sm."""
    rows = rows.withColumn("p", F.try_divide(F.col("sp") * 100, "atr")).withColumn("m", F.try_divide(F.col("sm") * 100, "atr"))
    rows = rows.withColumn("dx", F.try_divide(F.abs(F.col("p") - F.col("m")) * 100, F.col("p") + F.col("m")))
    rows = smooth(rows, {"raw_adx": ("dx", 1 / w, w)})
    return rows.withColumns({"plus_di": F.coalesce("p", F.lit(0.0)), "minus_di": F.coalesce("m", F.lit(0.0)), "adx": F.coalesce("raw_adx", F.lit(0.0))})


def together(bars: DataFrame, fast: int = 12, slow: int = 26, w: int = 14, band: int = 20) -> DataFrame:
    """Bars with ema_fast, ema_slow, adx, atr, rsi and the Bollinger bands upper and lower; all means but ADX's in one pass."""
    means = {n: (c, 1 / w, w) for n, c in (("avg_gain", "gain"), ("avg_loss", "loss"), ("atr", "tr"), ("sp", "plus_dm"), ("sm", "minus_dm"))}
    means |= {"ema_fast": ("close", ema_alpha(fast), fast), "ema_slow": ("close", ema_alpha(slow), slow)}
    rows = with_adx(with_rsi(smooth(with_steps(with_moves(bars)), means)), w)
    return bollinger(rows, band).select(*bars.columns, "ema_fast", "ema_slow", "adx", "atr", "rsi", "upper", "lower")


def cci(bars: DataFrame, w: int = 20) -> DataFrame:
    rows = bars.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    rows = rows.withColumn("sma", full(F.avg("close"), w)).withColumn("dev", F.abs(F.col("tp") - F.col("sma")))
    rows = rows.withColumn("mad", full(F.avg("dev"), w, "dev"))
    return rows.withColumn("cci", F.coalesce(F.try_divide(F.col("tp") - F.col("sma"), F.col("mad") * 0.015), F.lit(0.0))).drop("tp", "sma", "dev", "mad")


def roc_momentum(bars: DataFrame, n: int = 10) -> DataFrame:
    old = shift("close", n)
    return bars.withColumn("roc", F.try_divide((F.col("close") - old) * 100, old)).withColumn("momentum", F.col("close") - old)


def obv(bars: DataFrame) -> DataFrame:
    rows = with_quote(bars)
    side = F.coalesce(F.signum(F.col("close") - shift("close", 1)), F.lit(0.0))
    return rows.withColumn("signed", side * F.col("quote")).withColumn("obv", running(F.sum("signed"))).drop("signed", "quote")


def mfi(bars: DataFrame, w: int = 14) -> DataFrame:
    rows = with_quote(bars).withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    flow, before = F.col("tp") * F.col("quote"), shift("tp", 1)
    rows = rows.withColumn("pos", F.when(F.col("tp") > before, flow).otherwise(0.0)).withColumn("neg", F.when(F.col("tp") < before, flow).otherwise(0.0))
    rows = rows.withColumn("p", full(F.sum("pos"), w)).withColumn("n", full(F.sum("neg"), w))
    return rows.withColumn("mfi", F.coalesce(F.when(F.col("n") > 0, 100 - 100 / (1 + F.col("p") / F.col("n"))), F.lit(50.0))).drop("tp", "pos", "neg", "p", "n", "quote")


def vwap(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("tpv", (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    return rows.withColumn("vwap", F.try_divide(running(F.sum("tpv")), running(F.sum("volume")))).drop("tpv")


def slope(bars: DataFrame, w: int = 50) -> DataFrame:
    """Least-squares slopes of highs and lows over the row number, and the common direction.

    Positions count from the middle of the window, so the sums keep their digits however long the series is; the direction is that
    of the slopes to nine digits, as a flat window's slope is a few last bits around 0.
    """
    frame = by_time().rowsBetween(1 - w, 0)
    weigh = lambda v, i: v * (i.cast("double") - (w - 1) / 2)
    fit = lambda c: F.aggregate(F.transform(c, weigh), F.lit(0.0), lambda s, v: s + v) / (w * (w * w - 1) / 12)
    rows = bars.withColumns({f"slope_{c}": F.collect_list(c).over(frame) for c in ("high", "low")})  # w numbers a row
    for c in ("high", "low"):
        rows = rows.withColumn(f"slope_{c}", F.when(F.size(f"slope_{c}") == w, F.round(fit(F.col(f"slope_{c}")), 9)))
    up, down = (F.col("slope_high") > 0) & (F.col("slope_low") > 0), (F.col("slope_high") < 0) & (F.col("slope_low") < 0)
    return rows.withColumn("direction", F.when(up, 1).when(down, -1).otherwise(0))
