"""Sinks: a partitioned feature cache, and an append-only keyed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_cache(rows: DataFrame, path: str, by: str) -> DataFrame:
    """Writes rows partitioned by ``by`` and returns the stored table."""
    rows.write.partitionBy(by).parquet(f"{path}/cache")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/cache")


def append_new(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Appends the rows whose keys the table does not hold yet, so a repeated run adds nothing."""
    rows = rows.dropDuplicates(list(keys))
    try:
        held = rows.sparkSession.read.schema(rows.schema).parquet(path).select(*keys)
        rows = rows.join(held, list(keys), "left_anti")
    except AnalysisException:
        pass  # the table does not exist yet
    rows.write.mode("append").parquet(path)


def conflicts(rows: DataFrame, held: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that both tables hold with different values."""
    a, b = rows.select(*keys, F.struct(*values).alias("new")), held.select(*keys, F.struct(*values).alias("old"))
    return a.join(b, list(keys)).where(~F.col("new").eqNullSafe(F.col("old")))


def merged_shards(one: DataFrame, two: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Full outer merge of two shards: value, and whether both hold different ones."""
    a, b = one.select(*keys, F.col(value).alias("v1")), two.select(*keys, F.col(value).alias("v2"))
    rows = a.join(b, list(keys), "full")
    return rows.select(*keys, F.coalesce("v1", "v2").alias(value), (F.col("v1").isNotNull() & F.col("v2").isNotNull() & (F.col("v1") != F.col("v2"))).alias("conflict"))
