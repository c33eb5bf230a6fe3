"""As-of joins without a shuffle on time ranges and without one task a key.

Both sides are cut into time blocks. Inside a block the latest right row at or before each left row is a
window over the union of both sides; what a block cannot see is the last right row of earlier blocks,
which comes from one row a block. So a key holding a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, tolerance_s: int | None = None, block: str = "DAY") -> DataFrame:
    """Left rows with the columns of the latest right row at or before them; null when older than the tolerance (inclusive)."""
    by = list(by)
    extra = [c for c in right.columns if c not in by]
    held = F.struct(*extra)
    one = right.select(*by, F.col(right_ts).alias("__t"), held.alias("__r"), F.lit(0).alias("__side"))
    two = left.select(*by, F.col(left_ts).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(1).alias("__side"))
    both = one.unionByName(two, allowMissingColumns=True).withColumn("__b", F.date_trunc(block, "__t"))
    inside = Window.partitionBy(*by, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__own", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1")
    ends = both.groupBy(*by, "__b").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    rows = rows.join(ends, [*by, "__b"], "left").withColumn("__r", F.coalesce("__own", "__carry"))
    if tolerance_s is not None:
        fresh = F.col("__t") <= F.col(f"__r.{right_ts}") + F.expr(f"interval {tolerance_s} seconds")
        rows = rows.withColumn("__r", F.when(fresh, F.col("__r")))
    return rows.select("__l.*", *(F.col(f"__r.{c}").alias(c) for c in extra))


def at_offset(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str, seconds: int, columns: dict[str, str], same_month: bool = False) -> DataFrame:
    """Values exactly ``seconds`` away (negative: in the past); null when that row is missing.

    ``same_month`` purges values that cross into another calendar month.
    """
    moved = right.select(*by, (F.col(ts) - F.expr(f"interval {seconds} seconds")).alias(ts), *(F.col(c).alias(a) for c, a in columns.items()))
    rows = left.join(moved, [*by, ts], "left")
    if same_month:
        there = F.date_format(F.col(ts) + F.expr(f"interval {seconds} seconds"), "yyyy-MM")
        for a in columns.values():
            rows = rows.withColumn(a, F.when(F.date_format(ts, "yyyy-MM") == there, F.col(a)))
    return rows


def session_of(ts: str, opens: dict[str, int]):
    """The latest session open at or before ``ts``: (name, opened_at); opens in minutes of the UTC day."""
    day = F.date_trunc("DAY", ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    names = sorted(opens, key=lambda n: -opens[n])
    last = names[0]
    name, start = F.lit(last), day - F.expr(f"interval {1440 - opens[last]} minutes")
    for n in sorted(opens, key=lambda n: opens[n]):
        name = F.when(minute >= opens[n], n).otherwise(name)
        start = F.when(minute >= opens[n], day + F.expr(f"interval {opens[n]} minutes")).otherwise(start)
    return name, start
