"""Bootstrap bounds, selection states and pivots: per-group numpy where order or random draws matter.

Groups are series of periods (days, weeks or bars of one candidate or symbol), never raw rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260714


def block_index(n: int, block: int, rng: np.random.Generator, draws: int) -> np.ndarray:
    """draws x n positions of a circular moving-block bootstrap."""
    starts = rng.integers(0, n, (draws, -(-n // block)))
    return ((starts[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]


def family_bounds(returns: DataFrame, family: str, candidate: str, order: str, value: str, block: int = 7, draws: int = 5000, level: float = 0.95, most_redraws: int = 100) -> DataFrame:
    """Lower confidence bounds of mean returns, corrected for the family by the largest studentised deviation.

    All candidates of a family are resampled with the same blocks of periods (aligned), so their
    dependence is kept; draws in which a candidate has no spread are drawn again. Candidates must cover
    the same periods; missing ones count as zero.
    """

    def run(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        table = part.pivot_table(index=order, columns=candidate, values=value, aggfunc="sum", fill_value=0.0).sort_index()
        x, names = table.to_numpy(), [str(c) for c in table.columns]
        n = len(x)
        columns = [family, candidate, "mean", "bound", "periods"]
        if n < 2:
            return pd.DataFrame([(k[0], c, float(m), None, n) for c, m in zip(names, x.mean(0), strict=True)], columns=columns)
        mean, error = x.mean(0), x.std(0, ddof=1) / np.sqrt(n)
        good = error > 0
        rng = np.random.default_rng(SEED)
        tops, tries = [], 0
        while len(tops) < draws and tries < most_redraws and good.any():
            tries += 1
            for index in block_index(n, block, rng, min(256, draws - len(tops))):
                y = x[index][:, good]
                e = y.std(0, ddof=1) / np.sqrt(n)
                if (e > 0).all():
                    tops.append(float(((y.mean(0) - mean[good]) / e).max()))
        critical = float(np.quantile(tops, level)) if tops else float("nan")
        bound = np.where(good, mean - max(critical, 0.0) * error, mean)
        return pd.DataFrame([(k[0], c, float(m), float(b), n) for c, m, b in zip(names, mean, bound, strict=True)], columns=columns)

    rows = returns.select(F.col(family).cast("string").alias(family), F.col(candidate).cast("string").alias(candidate), order, value)
    return rows.groupBy(family).applyInPandas(run, f"{family} string, {candidate} string, mean double, bound double, periods int")


def selection_states(rows: DataFrame, key: str, order: str, cluster: str, confident: str, need: int = 2, lows: int = 2) -> DataFrame:
    """The cluster in force after each assessment; null is cash.

    The first confident one is taken at once. A different confident one must come ``need`` times in a
    row; ``lows`` assessments without confidence in a row lead to cash.
    """
    kind = dict(rows.dtypes)

    def run(k: tuple, part: pd.DataFrame) -> pd.DataFrame:
        current, pending, count, low, out = None, None, 0, 0, []
        for at, c, sure in part.sort_values(order, kind="stable")[[order, cluster, confident]].itertuples(index=False):
            if not sure:
                low, pending, count = low + 1, None, 0
                if low >= lows:
                    current = None
            else:
                low = 0
                if current is None or c == current:
                    current, pending, count = c, None, 0
                else:
                    pending, count = (c, count + 1) if c == pending else (c, 1)
                    if count >= need:
                        current, pending, count = c, None, 0
            out.append((k[0], at, current, pending, count, low))
        frame = pd.DataFrame(out, columns=[key, order, "current", "pending", "confirmed", "lows"])
        return frame.astype({"confirmed": "int32", "lows": "int32"})

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {order} {kind[order]}, current {kind[cluster]}, pending {kind[cluster]}, confirmed int, lows int")


def pivots(bars: DataFrame, k: int = 3) -> DataFrame:
    """Rows whose high (low) is not passed by k neighbours on both sides: adds pivot_high, pivot_low."""
    order = Window.partitionBy("symbol").orderBy("opened_at")
    frame = order.rowsBetween(-k, k)
    whole = F.count(F.lit(1)).over(frame) == 2 * k + 1
    rows = bars.withColumn("pivot_high", whole & (F.col("high") == F.max("high").over(frame)))
    return rows.withColumn("pivot_low", whole & (F.col("low") == F.min("low").over(frame))).withColumn("rn", F.row_number().over(order))


def separate_pivots(bars: DataFrame, k: int = 3) -> DataFrame:
    """symbol, kind, opened_at, rn, price: of pivots at most k rows apart the more extreme stays, the first on ties."""
    found = pivots(bars, k)
    high = found.where("pivot_high").select("symbol", F.lit("high").alias("kind"), "opened_at", "rn", F.col("high").alias("price"))
    low = found.where("pivot_low").select("symbol", F.lit("low").alias("kind"), "opened_at", "rn", F.col("low").alias("price"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in part.sort_values("rn").itertuples(index=False):
            if kept and r.rn - kept[-1].rn <= k:
                better = r.price > kept[-1].price if key[1] == "high" else r.price < kept[-1].price
                if better:
                    kept[-1] = r
            else:
                kept.append(r)
        return pd.DataFrame(kept, columns=part.columns)

    both = high.unionByName(low)
    return both.groupBy("symbol", "kind").applyInPandas(run, both.schema)
