"""Bars from ticks, coarser bars from bars, gap filling and trade flow.

All groupings are by (symbol, bucket), so work spreads over symbols and time; the first and last price
of a bucket are chosen by (time, trade id), which makes ties certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tick_order() -> Column:
    """(time, trade id) as one whole number: aggregates ordered by it can be hashed, by a struct they must sort."""
    micros = F.unix_micros("ts").cast("decimal(18,0)") * F.lit("10000000000000000000").cast("decimal(20,0)")
    return (micros + F.col("trade_id").cast("decimal(19,0)")).cast("decimal(38,0)")


def bars_of(ticks: DataFrame, every: str) -> DataFrame:
    """symbol, opened_at, closed_at, open, high, low, close, volume, trades of the ticks of each bucket."""
    order = tick_order()
    rows = ticks.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    return rows.select("symbol", F.col("w.start").alias("opened_at"), F.col("w.end").alias("closed_at"), "open", "high", "low", "close", "volume", "trades")


def coarser(bars: DataFrame, every: str, need: int | None = None, as_of: str | None = None, last: int | None = None) -> DataFrame:
    """Bars of longer buckets. With ``need`` only buckets of that many bars; closed by ``as_of``; the last ones of a symbol.

    The strict form of the operator is ``need`` with a check of ``incomplete``.
    """
    rows = bars.groupBy("symbol", F.window("opened_at", every).alias("w")).agg(
        F.min_by("open", "opened_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "opened_at").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("bars"),
    )
    rows = rows.select("symbol", F.col("w.start").alias("opened_at"), F.col("w.end").alias("closed_at"), "open", "high", "low", "close", "volume", "bars")
    if need is not None:
        rows = rows.where(F.col("bars") == need)
    if as_of is not None:
        rows = rows.where(F.col("closed_at") <= F.lit(as_of).cast("timestamp"))
    if last is not None:
        recent = Window.partitionBy("symbol").orderBy(F.desc("opened_at"))
        rows = rows.withColumn("rn", F.row_number().over(recent)).where(F.col("rn") <= last).drop("rn")
    return rows


def incomplete(bars: DataFrame, every: str, need: int) -> DataFrame:
    """Buckets that a strict aggregation rejects."""
    return coarser(bars, every).where(F.col("bars") != need).select("symbol", "opened_at", "bars")


def dense_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """A bar in every bucket between a symbol's first and last; empty ones carry the close at volume 0."""
    ends = bars.groupBy("symbol").agg(F.min("opened_at").alias("a"), F.max("opened_at").alias("b"))
    step = F.expr(f"interval {seconds} seconds")
    spine = ends.select("symbol", F.explode(F.sequence("a", "b", step)).alias("opened_at"))
    rows = spine.join(bars.drop("closed_at"), ["symbol", "opened_at"], "left")
    carried = F.last("close", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("opened_at").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("carried", carried)
    price = lambda c: F.coalesce(c, "carried").alias(c)
    return rows.select("symbol", "opened_at", (F.col("opened_at") + step).alias("closed_at"), *(price(c) for c in ("open", "high", "low", "close")), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def trade_flow(ticks: DataFrame, every: str) -> DataFrame:
    """Buy and sell base and quote volume, signed flow and vwap; a buyer that is maker means a sell."""
    sell = F.col("buyer_maker")
    quote = F.col("price") * F.col("qty")
    on = lambda cond, x: F.sum(F.when(cond, x).otherwise(0.0))
    rows = ticks.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        on(~sell, F.col("qty")).alias("buy_base"),
        on(sell, F.col("qty")).alias("sell_base"),
        on(~sell, quote).alias("buy_quote"),
        on(sell, quote).alias("sell_quote"),
        F.count(F.lit(1)).alias("trades"),
        (F.max("trade_id") - F.min("trade_id") + 1).alias("id_span"),
    )
    rows = rows.withColumn("flow_delta", F.col("buy_base") - F.col("sell_base"))
    rows = rows.withColumn("vwap", (F.col("buy_quote") + F.col("sell_quote")) / (F.col("buy_base") + F.col("sell_base")))
    return rows.select("symbol", F.col("w.start").alias("opened_at"), *rows.columns[2:])


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Per symbol: bars, gaps, repeated and reversed openings. All zero means a contiguous series."""
    before = F.lag("opened_at").over(Window.partitionBy("symbol").orderBy("opened_at"))
    step = F.unix_timestamp("opened_at") - F.unix_timestamp("before")
    rows = bars.withColumn("before", before).withColumn("step", step)
    count = lambda cond: F.count(F.when(cond, 1))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        count(F.col("step") > seconds).alias("gaps"),
        count(F.col("step") == 0).alias("repeats"),
        F.coalesce(F.sum(F.when(F.col("step") > seconds, F.col("step") / seconds - 1)), F.lit(0.0)).cast("long").alias("missing"),
    )
