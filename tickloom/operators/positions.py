"""The position that fills leave, folded without Python and without one task a symbol.

The signed quantity after a fill is a running sum, so it is known before any price is looked at; sums of days carry it
over. Given it, a fill changes entry e and realized profit r by fixed numbers: e becomes a e + b (adding averages, reducing
keeps, flat is 0, crossing zero opens at the fill's price), and r becomes r + c + d e. Such steps compose, so each day of a symbol is
folded to four numbers where its fills are, and only days come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "DAY"
FLAT = 1e-12


def _then(first: Column, a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """The numbers of a step (a, b, c, d) after those of ``first``."""
    return [(a * first["a"]).alias("a"), (a * first["b"] + b).alias("b"), (first["c"] + c + d * first["b"]).alias("c"), (first["d"] + d * first["a"]).alias("d")]


def _step(s: Column, fill: Column) -> Column:
    q, x, p, zero = s["q"], fill["change"], fill["price"], F.lit(0.0)
    after = F.when(F.abs(q + x) < FLAT, 0.0).otherwise(q + x)
    adds = (q == 0) | ((q > 0) == (x > 0))
    whole, side = F.abs(q) + F.abs(x), F.signum(q)
    closed = F.least(F.abs(x), F.abs(q))
    crossed = (after != 0) & ((after > 0) == (x > 0))
    a = F.when(adds, F.coalesce(F.try_divide(F.abs(q), whole), zero)).when((after == 0) | crossed, 0.0).otherwise(1.0)
    b = F.when(adds, F.coalesce(F.try_divide(F.abs(x) * p, whole), zero)).when(crossed, p).otherwise(0.0)
    c, d = F.when(adds, 0.0).otherwise(closed * p * side), F.when(adds, 0.0).otherwise(-closed * side)
    return F.struct(after.alias("q"), *_then(s, a, b, c, d))


def folded(fills: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """symbol, fills, quantity (signed), entry, realized, last_at after the fills (symbol, ts, trade_id, price, qty, buy) in order of (ts, trade_id).

    ``before`` has the same columns; symbols without a new fill are not returned.
    """
    change = F.when(F.col("buy"), F.col("qty")).otherwise(-F.col("qty"))
    fill = F.struct("ts", "trade_id", F.col("price").cast("double").alias("price"), change.cast("double").alias("change"))
    days = fills.groupBy("symbol", F.date_trunc(BLOCK, "ts").alias("day")).agg(F.sort_array(F.collect_list(fill)).alias("rows"), F.sum(change.cast("double")).alias("moved"))
    earlier = F.coalesce(F.sum("moved").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    days = days.withColumn("earlier", earlier)
    if before is None:
        days = days.select("*", F.lit(0.0).alias("q0"), F.lit(0.0).alias("e0"), F.lit(0.0).alias("r0"), F.lit(0).cast("long").alias("n0"))
    else:
        held = before.select("symbol", F.col("quantity").alias("q0"), F.col("entry").alias("e0"), F.col("realized").alias("r0"), F.col("fills").alias("n0"))
        days = days.join(held, "symbol", "left").na.fill(0, ["q0", "e0", "r0", "n0"])
    start = F.struct((F.col("q0") + F.col("earlier")).alias("q"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    days = days.withColumn("m", F.aggregate("rows", start, _step))
    own = F.struct("day", "m", F.size("rows").cast("long").alias("n"), F.get("rows", F.size("rows") - 1)["ts"].alias("last_at"))
    rows = days.groupBy("symbol").agg(F.sort_array(F.collect_list(own)).alias("days"), *(F.max(c).alias(c) for c in ("e0", "r0", "n0")))
    one = F.struct(F.lit(0.0).alias("q"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(0.0).alias("d"))
    step = lambda s, x: F.struct(x["m"]["q"].alias("q"), *_then(s, *(x["m"][k] for k in "abcd")))
    rows = rows.withColumn("t", F.aggregate("days", one, step)).withColumn("n", F.aggregate("days", F.lit(0).cast("long"), lambda s, x: s + x["n"]))
    entry = F.when(F.col("t.q") == 0, 0.0).otherwise(F.col("t.a") * F.col("e0") + F.col("t.b"))
    last = F.get("days", F.size("days") - 1)["last_at"]
    return rows.select("symbol", (F.col("n0") + F.col("n")).alias("fills"), F.col("t.q").alias("quantity"), entry.alias("entry"), (F.col("r0") + F.col("t.c") + F.col("t.d") * F.col("e0")).alias("realized"), last.alias("last_at"))
