"""Chart patterns over the pivots of a moving window: twelve shapes, what breaks them, and how sure a break is.

A pivot is a high (low) that none of ``k`` bars on both sides passes, so it is known ``k`` bars later. Each bar sees the
pivots of its ``lookback`` bars; of those at most ``k`` bars apart the more extreme stays, the first on ties. Shapes look
at the last two to four highs and lows, lines go through the last two. A close beyond a shape's level by
``buffer`` is a break. Of a bar's shapes broken downwards go before those broken upwards, these before unbroken ones; then the
surer, then the first in the order of ``SHAPES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import by_time, shift

#: Shapes in the order in which they are looked for, and what adds to (takes from) confidence.
SHAPES = (
    "descending_triangle", "double_top", "triple_top", "head_and_shoulders", "rising_wedge", "ascending_triangle",
    "double_bottom", "triple_bottom", "inverse_head_and_shoulders", "falling_wedge", "symmetrical_triangle", "box_range",
)
BASE, BROKEN, LOUD, QUIET, WITH_TREND, MANY_PIVOTS, NARROW, WILD = 0.65, 0.15, 0.15, -0.1, 0.1, 0.05, -0.1, -0.1
WILD_RANGE = 0.08


def _kept(k: int, better):
    """A fold over pivots in order: of those at most ``k`` bars apart the better one stays."""

    def taken(acc, x):
        last, one = F.get(acc, F.size(acc) - 1), F.array(x)
        far = (F.size(acc) == 0) | (x["i"] - last["i"] > k)
        return F.when(far, F.concat(acc, one)).when(better(x["p"], last["p"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), one)).otherwise(acc)

    return taken


def pivots_seen(bars: DataFrame, k: int, lookback: int) -> DataFrame:
    """Adds rn and for each bar highs and lows: arrays of (i, p) of the pivots it sees, in order."""
    around, seen = by_time().rowsBetween(-k, k), by_time().rowsBetween(k + 1 - lookback, -k)
    rows = bars.withColumn("rn", F.row_number().over(by_time()).cast("long")).withColumn("whole", F.count(F.lit(1)).over(around) == 2 * k + 1)
    for name, column, extreme in (("highs", "high", F.max), ("lows", "low", F.min)):
        is_pivot = F.col("whole") & (F.col(column) == extreme(column).over(around))
        rows = rows.withColumn(f"own_{name}", F.when(is_pivot, F.struct(F.col("rn").alias("i"), F.col(column).alias("p"))))
    for name, better in (("highs", lambda p, q: p > q), ("lows", lambda p, q: p < q)):
        rows = rows.withColumn(name, F.aggregate(F.collect_list(f"own_{name}").over(seen), F.array().cast("array<struct<i:bigint,p:double>>"), _kept(k, better)))
    return rows.drop("whole", "own_highs", "own_lows")


def _last(a: str, n: int) -> Column:
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def _prices(a: Column) -> Column:
    return F.transform(a, lambda x: x["p"])


def _mean(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x["p"]), F.size(a))


def _alike(low: Column, high: Column, near: float) -> Column:
    return (low > 0) & (F.try_divide(high, low) - 1 <= near)


def _moves(a: Column, right) -> Column:
    """Whether ``right`` holds for every two neighbours."""
    n = F.size(a)
    return F.forall(F.zip_with(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(a, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: right(p["p"], q["p"])), lambda x: x)


def _slope(a: Column) -> Column:
    first, last = F.get(a, F.lit(0)), F.get(a, F.size(a) - 1)
    return F.coalesce(F.try_divide(last["p"] - first["p"], last["i"] - first["i"]), F.lit(0.0))


def _line(a: str) -> Column:
    """The line through the last two pivots, at the present bar."""
    last = F.get(a, F.size(a) - 1)
    return last["p"] + _slope(_last(a, 2)) * (F.col("rn") - last["i"])


def shapes(near: float) -> dict[str, tuple[Column, Column | None, Column | None, Column, Column]]:
    """Of each shape: whether it is there, the level above which it breaks upwards, that below which downwards, its stop, its pivots."""
    h3, l3, h2, l2, h4, l4 = _last("highs", 3), _last("lows", 3), _last("highs", 2), _last("lows", 2), _last("highs", 4), _last("lows", 4)
    end = lambda a: F.get(a, F.size(a) - 1)["p"]
    top, bottom = lambda a: F.array_max(_prices(a)), lambda a: F.array_min(_prices(a))
    flat = lambda a: _alike(bottom(a), top(a), near)
    up, down = lambda a: _moves(a, lambda p, q: q > p), lambda a: _moves(a, lambda p, q: q < p)
    two = (F.size("highs") >= 2) & (F.size("lows") >= 2)
    gap = lambda k: F.get(h3, k(h3))["p"] - F.get(l3, k(l3))["p"]
    first, last = lambda a: F.lit(0), lambda a: F.size(a) - 1
    closing = (gap(first) > 0) & (gap(last) > 0) & (gap(last) < gap(first))
    inside = lambda a, of: F.filter(a, lambda x: (x["i"] > F.get(of, F.lit(0))["i"]) & (x["i"] < F.get(of, F.size(of) - 1)["i"]))
    both = F.size(h3) + F.size(l3)

    def repeated(own, other, n, extreme, level):
        """n like pivots with at least n - 1 of the other kind between; (there, neckline, stop, pivots)."""
        between = inside(other, own)
        return (F.size(own) == n) & flat(own) & (F.size(between) >= n - 1), level(between), extreme(own), F.size(own) + F.size(between)

    def head(own, other, above):
        a, b, c = (F.get(own, F.lit(k))["p"] for k in range(3))
        between = inside(other, own)
        outside = ((b > a) & (b > c)) if above else ((b < a) & (b < c))
        return (F.size(own) == 3) & outside & _alike(F.least(a, c), F.greatest(a, c), near) & (F.size(between) >= 2), _mean(between), c, F.size(own) + F.size(between)

    out = {
        "ascending_triangle": (two & flat(h3) & up(l3), _mean(h3), None, end(l3), both), "descending_triangle": (two & flat(l3) & down(h3), None, _mean(l3), end(h3), both),
        "symmetrical_triangle": (two & down(h3) & up(l3) & closing, _line("highs"), _line("lows"), end(l3), both),
        "box_range": (two & flat(h4) & flat(l4), _mean(h4), _mean(l4), end(l4), F.size(h4) + F.size(l4)),
        "falling_wedge": (two & down(h3) & down(l3) & (_slope(h3) < _slope(l3)) & closing, _line("highs"), None, end(l3), both),
        "rising_wedge": (two & up(h3) & up(l3) & (_slope(l3) > _slope(h3)) & closing, None, _line("lows"), end(h3), both),
    }
    for name, own, n in (("double_top", h2, 2), ("triple_top", h3, 3)):
        there, level, stop, many = repeated(own, "lows", n, top, bottom)
        out[name] = (there, None, level, stop, many)
    for name, own, n in (("double_bottom", l2, 2), ("triple_bottom", l3, 3)):
        there, level, stop, many = repeated(own, "highs", n, bottom, top)
        out[name] = (there, level, None, stop, many)
    there, level, stop, many = head(h3, "lows", True)
    out["head_and_shoulders"] = (there, None, level, stop, many)
    there, level, stop, many = head(l3, "highs", False)
    out["inverse_head_and_shoulders"] = (there, level, None, stop, many)
    return out


def chart_patterns(bars: DataFrame, k: int = 3, lookback: int = 120, near: float = 0.01, buffer: float = 0.003, volume_bars: int = 20, loud: float = 1.3, least: float = 0.6, reward: float = 2.0) -> DataFrame:
    """symbol, opened_at, pattern, signal (long, short, wait), confidence, entry, stop_loss, take_profit of bars with a shape.

    A break whose confidence is below ``least`` waits. Parameters' defaults are fixed values.
    """
    look, recent = by_time().rowsBetween(1 - lookback, 0), by_time().rowsBetween(1 - volume_bars, 0)
    rows = pivots_seen(bars, k, lookback)
    rows = rows.withColumn("loud", (F.count(F.lit(1)).over(recent) == volume_bars) & (F.col("volume") > F.avg("volume").over(recent) * loud))
    rows = rows.withColumn("width", F.coalesce(F.try_divide(F.max("high").over(look) - F.min("low").over(look), F.max("high").over(look)), F.lit(0.0)))
    spans = F.avg(F.when(F.col("close") > 0, F.try_divide(F.col("high") - F.col("low"), "close"))).over(by_time().rowsBetween(-19, 0))
    rows = rows.withColumn("wild", F.coalesce(spans, F.lit(0.0)) > WILD_RANGE).withColumn("c4", shift("close", 4)).where(F.col("rn") >= 2 * k + 3)
    close, found = F.col("close"), []
    every = shapes(near)
    for place, name in enumerate(SHAPES):
        there, above, below, stop, many = every[name]
        falls = F.coalesce(close < below * (1 - buffer), F.lit(False)) if below is not None else F.lit(False)
        rises = F.coalesce(close > above * (1 + buffer), F.lit(False)) & ~falls if above is not None else F.lit(False)
        side = F.when(falls, 2).when(rises, 1).otherwise(0)
        found.append(F.when(there, F.struct(side.alias("side"), (many >= 4).alias("many"), F.lit(-place).alias("place"), stop.alias("stop"), F.lit(name).alias("pattern"))))
    rows = rows.withColumn("found", F.array_compact(F.array(*found))).where(F.size("found") > 0)

    def sure(x):
        with_trend = F.coalesce(((x["side"] == 1) & (close >= F.col("c4"))) | ((x["side"] == 2) & (close <= F.col("c4"))), F.lit(False))
        terms = ((x["side"] > 0, BROKEN), (with_trend, WITH_TREND), (x["many"], MANY_PIVOTS), (F.col("width") < buffer, NARROW), (F.col("wild"), WILD))
        total = F.lit(BASE) + F.when(F.col("loud"), LOUD).otherwise(QUIET)
        for test, points in terms:
            total = total + F.when(test, points).otherwise(0.0)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)

    best = F.array_max(F.transform("found", lambda x: F.struct(x["side"].alias("side"), sure(x).alias("confidence"), x["place"].alias("place"), x["stop"].alias("stop"), x["pattern"].alias("pattern"))))
    rows = rows.withColumn("b", best)
    side = F.when(F.col("b.confidence") >= least, F.col("b.side")).otherwise(0)
    stop = F.when(side == 1, F.least("b.stop", "close") * (1 - buffer)).when(side == 2, F.greatest("b.stop", "close") * (1 + buffer))
    target = F.when(side == 1, close + (close - stop) * reward).when(side == 2, close - (stop - close) * reward)
    signal = F.when(side == 1, "long").when(side == 2, "short").otherwise("wait")
    return rows.select("symbol", "opened_at", "b.pattern", signal.alias("signal"), "b.confidence", F.when(side > 0, close).alias("entry"), stop.alias("stop_loss"), target.alias("take_profit"))
