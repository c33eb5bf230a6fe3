"""Structured Streaming: bars from a tick stream, and a position folded from fill events.

Out-of-order ticks later than the watermark are dropped (an extension: a batch source would treat them as
an error). Both jobs run to the end of what is there (``availableNow``) and can be resumed from their
checkpoint.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import folded

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def folder(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; without the setting local masters get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tickloom-shared"
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def tick_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Ticks of an events table; ``path`` is a pattern, as a stream may not start at a single file."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    qty = F.get_json_object("props", "$.k").cast("double") + 1
    return rows.where("value > 0").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"), qty.alias("qty"))


def stream_bars(ticks: DataFrame, every: str, late: str, slide: str | None = None) -> DataFrame:
    """Bars of closed windows, each emitted once the watermark has passed its end.

    With ``slide`` windows overlap: one begins every ``slide``, and a tick belongs to several.
    """
    order = F.struct("ts", "trade_id")
    rows = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", every, slide).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    return rows.select("symbol", F.col("w.start").alias("opened_at"), F.col("w.end").alias("closed_at"), "open", "high", "low", "close", "volume", "trades")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over all its input into a table of the shared folder and reads it."""
    spark = stream.sparkSession
    path = folder(spark)
    job = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


STATE = "symbol string, fills long, quantity double, entry double, realized double, last_at timestamp"


def newest_states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest state of every symbol under ``path``, of the batches before ``before``."""
    rows = spark.read.schema(f"{STATE}, batch int").parquet(path)
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    columns = [c.split()[0] for c in STATE.split(", ")[1:]]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*columns), "batch").alias("m")).select("symbol", "m.*")


def run_positions(fills: DataFrame, path: str) -> None:
    """Folds a stream of fills (symbol, ts, trade_id, price, qty, buy) to positions under ``path``, to the end of what is there.

    A batch starts from the states of the batches before it and is written under its number. A batch that is run
    again after a restart replaces its own folder and reads the same earlier ones, so every fill counts once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = newest_states(spark, f"{path}/out", number) if number else None
        folded(batch, before).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    job = fills.writeStream.option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    job.awaitTermination()


def positions(spark: SparkSession, path: str) -> DataFrame:
    """symbol, fills, side, quantity, entry, realized, last_at as of the last batch under ``path``."""
    q = F.col("quantity")
    side = F.when(q > 0, "long").when(q < 0, "short").otherwise("flat")
    return newest_states(spark, f"{path}/out").select("symbol", "fills", side.alias("side"), F.abs(q).alias("quantity"), "entry", "realized", "last_at")
