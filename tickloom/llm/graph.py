"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every node of ``links`` (a, b); comp is the smallest node reachable.

    Labels are lowered over the links and then over the labels' own labels (pointer jumping), so the
    rounds follow the logarithm of a component's diameter. Every round is written to the shared
    folder; a node with very many links is reduced before the shuffle and its join can be split.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("comp").alias("near"))
        lower = written(labels.join(near, F.col("v") == F.col("a")).select("v", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")))
        jump = lower.select(F.col("v").alias("root"), F.col("comp").alias("far"))
        lower = written(lower.join(jump, F.col("comp") == F.col("root"), "left").select("v", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")))
        if lower.where("was <> comp").isEmpty():
            return lower.select("v", "comp")
        labels = lower.select("v", "comp")
