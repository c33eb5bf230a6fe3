"""The seven-day chart registry at four-hour anchors, from mergeable summaries of four-hour blocks.

A path of closes is a segment; two segments that follow each other merge to one, by the step between them: sums of
returns, of their squares and of products of neighbours, sign changes, path length, extremes, drawdown and
run-up all merge. Bars of 15 minutes are folded to the segment of their block once. A window is its first open, a
segment of one point, merged with its blocks: 42 for seven days, 6 for a day, one for four hours. So an anchor costs as
many merges as its window has blocks, not as many rows as it has bars.

A window that has a gap, or a feature with a zero denominator, has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAR_S, BLOCK_S, DAY_BLOCKS, WEEK_BLOCKS, HOURS_BEFORE = 900, 14400, 6, 42, 24
NAMES = (
    "return_4h", "return_12h", "return_1d", "return_3d", "return_7d", "rv_4h", "rv_1d", "rv_7d", "rv_ratio_1d_7d", "atr_ratio_1d", "atr_ratio_7d", "range_ratio_7d",
    "close_location_7d", "directional_efficiency_1d", "directional_efficiency_7d", "sign_change_rate_1d", "sign_change_rate_7d", "return_autocorr_1d", "return_autocorr_7d",
    "max_drawdown_7d", "max_runup_7d", "breakout_rate_7d", "mean_body_ratio_7d", "mean_upper_wick_ratio_7d", "mean_lower_wick_ratio_7d", "volume_cv_7d", "top_decile_volume_share_7d", "volume_ratio_1d_7d",
)
#: A segment: its first and last close, extremes, worst drawdown and best run-up, number of returns m, sums of log returns
#: and their squares, of simple returns and their squares, of products of neighbours, first and last simple return,
#: pairs without zero and with unlike signs, and length of the path.
_SEGMENT = ("first", "last", "peak", "trough", "drawdown", "runup", "m", "lr", "lr2", "x", "x2", "xx", "x_first", "x_last", "pairs", "turns", "length")


def point(price: Column) -> Column:
    """A segment of one close."""
    zero, none = F.lit(0.0), F.lit(None).cast("double")
    values = dict.fromkeys(_SEGMENT, zero) | {k: price for k in ("first", "last", "peak", "trough")} | {"x_first": none, "x_last": none}
    return F.struct(*(values[k].alias(k) for k in _SEGMENT))


def merged(a: Column, b: Column) -> Column:
    """The segment of ``a`` followed by ``b``."""
    x, lr = b["first"] / a["last"] - 1, F.log(b["first"] / a["last"])
    both = lambda p, q: (p.isNotNull() & q.isNotNull() & (p != 0) & (q != 0)).cast("double")
    unlike = lambda p, q: F.coalesce((p * q < 0).cast("double"), F.lit(0.0))
    product = lambda p, q: F.coalesce(p * q, F.lit(0.0))
    left, right = (a["x_last"], x), (x, b["x_first"])
    values = {
        "first": a["first"], "last": b["last"], "peak": F.greatest(a["peak"], b["peak"]), "trough": F.least(a["trough"], b["trough"]),
        "drawdown": F.least(a["drawdown"], b["drawdown"], b["trough"] / a["peak"] - 1), "runup": F.greatest(a["runup"], b["runup"], b["peak"] / a["trough"] - 1),
        "m": a["m"] + b["m"] + 1, "lr": a["lr"] + b["lr"] + lr, "lr2": a["lr2"] + b["lr2"] + lr * lr, "x": a["x"] + b["x"] + x, "x2": a["x2"] + b["x2"] + x * x,
        "xx": a["xx"] + b["xx"] + product(*left) + product(*right), "x_first": F.coalesce(a["x_first"], x), "x_last": F.coalesce(b["x_last"], x),
        "pairs": a["pairs"] + b["pairs"] + both(*left) + both(*right), "turns": a["turns"] + b["turns"] + unlike(*left) + unlike(*right), "length": a["length"] + b["length"] + F.abs(b["first"] - a["last"]),
    }
    return F.struct(*(values[k].alias(k) for k in _SEGMENT))


def block_summaries(bars: DataFrame) -> DataFrame:
    """symbol, block, segment of closes, first open, and of its hours: extremes, true ranges, breakouts, shapes and volumes."""
    at = lambda seconds: F.timestamp_seconds(F.floor(F.unix_timestamp("opened_at") / seconds) * seconds)
    closes = F.transform(F.sort_array(F.collect_list(F.struct("opened_at", "close"))), lambda r: r["close"])
    paths = bars.groupBy("symbol", at(BLOCK_S).alias("block")).agg(closes.alias("closes"), F.min_by("open", "opened_at").alias("open"))
    rest = F.slice("closes", 2, BLOCK_S // BAR_S)
    paths = paths.where(F.size("closes") == BLOCK_S // BAR_S)
    paths = paths.withColumn("segment", F.aggregate(rest, point(F.get("closes", F.lit(0))), lambda s, c: merged(s, point(c)))).drop("closes")
    hours = bars.groupBy("symbol", at(3600).alias("hour")).agg(
        F.min_by("open", "opened_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "opened_at").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n")
    )
    by = Window.partitionBy("symbol").orderBy("hour")
    prior = by.rowsBetween(-HOURS_BEFORE, -1)
    spread = lambda before: F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    hours = hours.where(F.col("n") == 3600 // BAR_S).withColumn("tr", spread(F.lag("close").over(by))).withColumn("tr_open", spread(F.col("open")))
    hours = hours.withColumn("broke", ((F.col("close") > F.max("high").over(prior)) | (F.col("close") < F.min("low").over(prior))).cast("double"))
    width = F.col("high") - F.col("low")
    shape = lambda x: F.sum(F.coalesce(F.try_divide(x, width), F.lit(0.0)))
    block = F.timestamp_seconds(F.floor(F.unix_timestamp("hour") / BLOCK_S) * BLOCK_S)
    sums = hours.groupBy("symbol", block.alias("block")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.sum("tr").alias("tr"), F.min_by("tr", "hour").alias("tr_first"), F.min_by("tr_open", "hour").alias("tr_open"), F.sum("broke").alias("broke"),
        shape(F.abs(F.col("close") - F.col("open"))).alias("body"), shape(F.col("high") - F.greatest("open", "close")).alias("upper"), shape(F.least("open", "close") - F.col("low")).alias("lower"),
        F.collect_list("volume").alias("volumes"),
    )
    return paths.join(sums, ["symbol", "block"])


def _spread(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from sums."""
    mean = F.try_divide(total, n)
    return F.sqrt(F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0)))


def _path_features(s: Column) -> dict[str, Column]:
    left, right, pairs = s["x"] - s["x_last"], s["x"] - s["x_first"], s["m"] - 1
    left2, right2 = s["x2"] - s["x_last"] * s["x_last"], s["x2"] - s["x_first"] * s["x_first"]
    over = lambda v: F.try_divide(v, pairs)
    covariance = over(s["xx"]) - over(left) * over(right)
    spread = F.sqrt(F.greatest((over(left2) - over(left) * over(left)) * (over(right2) - over(right) * over(right)), F.lit(0.0)))
    return {
        "rv": _spread(s["m"], s["lr"], s["lr2"]), "efficiency": F.try_divide(F.abs(s["last"] - s["first"]), s["length"]), "turns": F.try_divide(s["turns"], s["pairs"]), "autocorr": F.try_divide(covariance, spread)
    }


def weekly_registry(bars: DataFrame) -> DataFrame:
    """symbol, anchor_at and NAMES at every four-hour anchor with seven whole days before it; bars of 15 minutes without gaps."""
    by = Window.partitionBy("symbol").orderBy("block")
    held = F.struct("segment", "open", "high", "low", "tr", "tr_first", "tr_open", "broke", "body", "upper", "lower", "volumes")
    rows = block_summaries(bars).select("symbol", "block", held.alias("b"))
    rows = rows.withColumn("w", F.collect_list("b").over(by.rowsBetween(1 - WEEK_BLOCKS, 0))).withColumn("since", F.lag("block", WEEK_BLOCKS - 1).over(by))
    whole = F.unix_timestamp("block") - F.unix_timestamp("since") == (WEEK_BLOCKS - 1) * BLOCK_S
    rows = rows.where(whole).select("symbol", F.timestamp_seconds(F.unix_timestamp("block") + BLOCK_S).alias("anchor_at"), "w")
    block = lambda k: F.get("w", F.lit(WEEK_BLOCKS - k))  # noqa: E731  the k-th block from the end
    last = lambda k: F.slice("w", WEEK_BLOCKS - k + 1, k)
    path = lambda k: F.aggregate(last(k), point(block(k)["open"]), lambda s, b: merged(s, b["segment"]))
    for name, k in (("h4", 1), ("d1", DAY_BLOCKS), ("d7", WEEK_BLOCKS)):
        rows = rows.withColumn(name, path(k))
    total = lambda blocks, name: F.aggregate(blocks, F.lit(0.0), lambda s, b: s + b[name])
    rows = rows.withColumn("high", F.array_max(F.transform("w", lambda b: b["high"]))).withColumn("low", F.array_min(F.transform("w", lambda b: b["low"])))
    rows = rows.withColumn("volumes", F.sort_array(F.flatten(F.transform("w", lambda b: b["volumes"])), asc=False)).withColumn("day_volumes", F.flatten(F.transform(last(DAY_BLOCKS), lambda b: b["volumes"])))
    close, hours, day_hours = F.col("d7")["last"], WEEK_BLOCKS * 4, DAY_BLOCKS * 4
    d1, d7, h4 = _path_features(F.col("d1")), _path_features(F.col("d7")), _path_features(F.col("h4"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    volume, squares = add("volumes"), F.aggregate("volumes", F.lit(0.0), lambda s, v: s + v * v)
    week_tr = total(F.col("w"), "tr") - F.coalesce(block(WEEK_BLOCKS)["tr_first"], F.lit(0.0)) + block(WEEK_BLOCKS)["tr_open"]
    values = {
        **{f"return_{n}": close / block(k)["open"] - 1 for n, k in (("4h", 1), ("12h", 3), ("1d", 6), ("3d", 18), ("7d", 42))},
        "rv_4h": h4["rv"], "rv_1d": d1["rv"], "rv_7d": d7["rv"], "rv_ratio_1d_7d": F.try_divide(d1["rv"], d7["rv"]),
        "atr_ratio_1d": total(last(DAY_BLOCKS), "tr") / day_hours / close, "atr_ratio_7d": week_tr / hours / close,
        "range_ratio_7d": (F.col("high") - F.col("low")) / close, "close_location_7d": F.try_divide(close - F.col("low"), F.col("high") - F.col("low")),
        "directional_efficiency_1d": d1["efficiency"], "directional_efficiency_7d": d7["efficiency"], "sign_change_rate_1d": d1["turns"], "sign_change_rate_7d": d7["turns"],
        "return_autocorr_1d": d1["autocorr"], "return_autocorr_7d": d7["autocorr"], "max_drawdown_7d": F.col("d7")["drawdown"], "max_runup_7d": F.col("d7")["runup"],
        "breakout_rate_7d": total(last(WEEK_BLOCKS - DAY_BLOCKS), "broke") / (hours - HOURS_BEFORE),
        "mean_body_ratio_7d": total(F.col("w"), "body") / hours, "mean_upper_wick_ratio_7d": total(F.col("w"), "upper") / hours, "mean_lower_wick_ratio_7d": total(F.col("w"), "lower") / hours,
        "volume_cv_7d": F.try_divide(_spread(F.lit(hours), volume, squares), volume / hours), "top_decile_volume_share_7d": F.try_divide(add(F.slice("volumes", 1, -(-hours // 10))), volume),
        "volume_ratio_1d_7d": F.try_divide(add("day_volumes") / day_hours, volume / hours),
    }
    return rows.select("symbol", "anchor_at", *(values[n].alias(n) for n in NAMES)).dropna(subset=list(NAMES))
