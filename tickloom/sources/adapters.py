"""Market tables derived from the star schema.

``ticks`` come from events; bars, funding and metrics from ticks; the trade ledger from lineitem and
orders; vectors from embeddings. Timestamps are UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import bars_of, dense_bars


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, trade_id, price, qty, buyer_maker."""
    return (
        read(spark, sf_dir, "events")
        .where("value > 0")
        .select(
            F.col("event_type").alias("symbol"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id").alias("trade_id"),
            F.col("value").alias("price"),
            (F.get_json_object("props", "$.k").cast("double") + 1).alias("qty"),
            F.col("event_type").isin("error", "view").alias("buyer_maker"),
        )
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(ticks(spark, sf_dir), "1 hour")


def bars_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gapless bars of all symbols together: the last close is carried into empty buckets."""
    return dense_bars(bars_of(ticks(spark, sf_dir).withColumn("symbol", F.lit("ALL")), "15 minutes"), 900)


def order_bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by priority: a long history."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("trade_id"),
        F.col("o_totalprice").alias("price"),
        F.lit(1.0).alias("qty"),
    )
    return bars_of(orders, "1 day")


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, funding_at, rate: the first tick of every eight hours."""
    first = F.min(F.struct("ts", "trade_id", "price")).alias("f")
    rows = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "8 hours").alias("w")).agg(first)
    return rows.select("symbol", F.col("f.ts").alias("funding_at"), ((F.col("f.price") - 50) / 10000).alias("rate"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, metric_at, open_interest, ratio on a five-minute grid."""
    rows = ticks(spark, sf_dir).groupBy("symbol", F.window("ts", "5 minutes").alias("w"))
    rows = rows.agg(F.sum("qty").alias("open_interest"), F.avg("price").alias("ratio"))
    return rows.select("symbol", F.col("w.end").alias("metric_at"), "open_interest", "ratio")


def ledger(spark: SparkSession, sf_dir: str, candidates: int = 10, parts: int = 1) -> DataFrame:
    """Closed trades: candidate_id, trade_id, entry_ts, exit_ts, notional, fee, pnl, ret, confidence.

    With more than one of ``parts`` both tables are dealt into so many by order, and rows stay so.
    """
    line = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    if parts > 1:
        line, orders = line.repartition(parts, "l_orderkey"), orders.repartition(parts, "o_orderkey")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    pnl = (F.col("l_discount") - 0.05) * F.col("l_extendedprice")
    return rows.select(
        (F.col("l_suppkey") % candidates).alias("candidate_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").cast("timestamp").alias("entry_ts"),
        F.col("l_shipdate").cast("timestamp").alias("exit_ts"),
        F.col("l_extendedprice").alias("notional"),
        (F.col("l_extendedprice") * 0.0004).alias("fee"),
        pnl.alias("pnl"),
        (F.col("l_discount") - 0.05).alias("ret"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_quantity").alias("qty"),
        F.col("o_orderstatus").alias("status"),
        F.col("l_linestatus").alias("side"),
        F.col("l_returnflag").alias("flag"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, dim, x: all components as long rows."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x"))
    return rows.withColumn("x", F.col("x").cast("double"))
