"""Trade statistics, equity paths, rankings and walk-forward tables over a trade ledger.

Ledger columns: candidate_id, trade_id, entry_ts, exit_ts, notional, fee, pnl, ret, confidence, qty.
Paths and ranks run per candidate (or candidate and month) over daily sums where a candidate's trades
could be very many; ties always end with a unique id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CASH = 1_000_000.0


def summary(trades: DataFrame, by: list[str]) -> DataFrame:
    """net, wins, win_rate, gains, losses, both profit factors, mean return, downside deviation."""
    pnl = F.col("pnl")
    rows = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("pnl").alias("net"),
        F.count(F.when(pnl > 0, 1)).alias("wins"),
        F.sum(F.when(pnl > 0, pnl).otherwise(0.0)).alias("gains"),
        F.sum(F.when(pnl < 0, -pnl).otherwise(0.0)).alias("losses"),
        F.avg("ret").alias("mean_return"),
        F.stddev_pop("ret").alias("deviation"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2))).alias("downside"),
        F.sum("fee").alias("fees"),
    )
    rows = rows.withColumn("win_rate", F.col("wins") / F.col("trades"))
    ratio = F.when(F.col("losses") > 0, F.col("gains") / F.col("losses"))
    # Only gains: infinite by one convention (shown as null here), 0 by the other.
    return rows.withColumn("profit_factor", ratio).withColumn("profit_factor_zero", F.coalesce(ratio, F.lit(0.0)))


def daily(trades: DataFrame, by: str = "candidate_id") -> DataFrame:
    """candidate, day, pnl, trades: what paths run over."""
    return trades.groupBy(by, F.to_date("exit_ts").alias("day")).agg(F.sum("pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"))


def equity(days: DataFrame, by: str = "candidate_id", cash: float = CASH) -> DataFrame:
    upto = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = days.withColumn("equity", cash + F.sum("pnl").over(upto))
    rows = rows.withColumn("peak", F.greatest(F.lit(cash), F.max("equity").over(upto)))
    return rows.withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))


def drawdown(days: DataFrame, by: str = "candidate_id") -> DataFrame:
    rows = equity(days, by).groupBy(by)
    return rows.agg(F.max("drawdown").alias("max_drawdown"), F.max_by("equity", "day").alias("final_equity"))


def sampled_equity(days: DataFrame, points: int, by: str = "candidate_id") -> DataFrame:
    """At most about ``points`` days of a path: every n-th, and the last."""
    order = Window.partitionBy(by).orderBy("day")
    rows = equity(days, by).withColumn("rn", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / points))
    return rows.where(((F.col("rn") - 1) % step == 0) | (F.col("rn") == F.col("n"))).select(by, "day", "equity")


def monthly(trades: DataFrame, cash: float = CASH) -> DataFrame:
    """candidate_id, month, return_ratio, trades, expectancy, max_drawdown (of the month's days)."""
    rows = daily(trades).withColumn("month", F.date_format("day", "yyyy-MM"))
    upto = Window.partitionBy("candidate_id", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("equity", cash + F.sum("pnl").over(upto))
    rows = rows.withColumn("peak", F.greatest(F.lit(cash), F.max("equity").over(upto)))
    rows = rows.groupBy("candidate_id", "month").agg(
        (F.sum("pnl") / cash).alias("return_ratio"),
        F.sum("trades").alias("trades"),
        (F.sum("pnl") / F.sum("trades")).alias("expectancy"),
        F.max((F.col("peak") - F.col("equity")) / F.col("peak")).alias("max_drawdown"),
    )
    return rows


def compounded(column: Column) -> Column:
    """Product of (1 + r) minus 1; -1 once an r is -1 or less, as nothing is left then."""
    return F.when(F.min(column) <= -1, -1.0).otherwise(F.exp(F.sum(F.log1p(F.when(column > -1, column)))) - 1)


def tail_stats(months: DataFrame, by: str = "candidate_id", value: str = "return_ratio", at: str = "month") -> DataFrame:
    """Expected shortfall of the worst tenth, nearest-rank tenth percentile, result without the best."""
    worst = Window.partitionBy(by).orderBy(value, at)
    best = Window.partitionBy(by).orderBy(F.desc(value), at)
    rows = months.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(by))).withColumn("low", F.row_number().over(worst)).withColumn("top", F.row_number().over(best))
    tenth = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))
    return rows.groupBy(by).agg(
        F.avg(F.when(F.col("low") <= tenth, F.col(value))).alias("shortfall"),
        F.max(F.when(F.col("low") == tenth, F.col(value))).alias("tenth_percentile"),
        F.coalesce(compounded(F.when(F.col("top") > 1, F.col(value))), F.lit(0.0)).alias("without_best"),
        compounded(F.col(value)).alias("compounded"),
        F.median(value).alias("median"),
    )


def concentration(trades: DataFrame, by: str = "candidate_id", top: int = 5) -> DataFrame:
    """Share of the positive result that the best trade and the best ``top`` trades bring."""
    order = Window.partitionBy(by).orderBy(F.desc("pnl"), "trade_id")
    rows = trades.where("pnl > 0").withColumn("rn", F.row_number().over(order)).withColumn("all", F.sum("pnl").over(Window.partitionBy(by)))
    return rows.where(F.col("rn") <= top).groupBy(by).agg(
        (F.max(F.when(F.col("rn") == 1, F.col("pnl"))) / F.first("all")).alias("top_1"),
        (F.sum("pnl") / F.first("all")).alias(f"top_{top}"),
    )


def worst_block(days: DataFrame, n: int, cash: float = CASH, by: str = "candidate_id") -> DataFrame:
    """The worst compounded return of ``n`` days in a row that all have trades (complete calendar blocks); -1 with a day that loses all."""
    order = Window.partitionBy(by).orderBy("day")
    rows = days.withColumn("first", F.lag("day", n - 1).over(order)).withColumn("r", F.col("pnl") / cash)
    block = order.rowsBetween(1 - n, 0)
    left = F.exp(F.sum(F.log1p(F.when(F.col("r") > -1, F.col("r")))).over(block)) - 1
    rows = rows.withColumn("block", F.when(F.min("r").over(block) <= -1, -1.0).otherwise(left))
    return rows.where(F.datediff("day", "first") == n - 1).groupBy(by).agg(F.min("block").alias("worst"), F.count(F.lit(1)).alias("blocks"))


def calibration(trades: DataFrame, bins: int = 10) -> DataFrame:
    """Result by confidence bin [i/bins, (i+1)/bins), empty bins included; confidence 1 falls in none."""
    spine = trades.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    binned = trades.where((F.col("confidence") >= 0) & (F.col("confidence") < 1)).withColumn("bin", F.floor(F.round(F.col("confidence") * bins, 9)).cast("int"))
    stats = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("pnl").alias("expected"))
    rows = F.broadcast(spine).join(stats, "bin", "left")
    return rows.select("bin", (F.col("bin") / bins).alias("bin_from"), F.coalesce("trades", F.lit(0)).alias("trades"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("net", "win_rate", "expected")))


def loss_streak(trades: DataFrame, recent: int, by: str = "candidate_id") -> DataFrame:
    """Losses in a row among the most recent trades."""
    order = Window.partitionBy(by).orderBy(F.desc("exit_ts"), F.desc("trade_id"))
    rows = trades.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= recent)
    first = F.min(F.when(F.col("pnl") >= 0, F.col("rn")))
    return rows.groupBy(by).agg(F.coalesce(first - 1, F.count(F.lit(1))).alias("streak"))


def train_score(months: DataFrame) -> DataFrame:
    """(compounded * share of positive months + weighted expectancy) / (1 + worst drawdown)."""
    rows = months.groupBy("candidate_id").agg(
        compounded(F.col("return_ratio")).alias("total"),
        F.avg((F.col("return_ratio") > 0).cast("double")).alias("positive"),
        (F.sum(F.col("expectancy") / CASH * F.col("trades")) / F.sum("trades")).alias("expectancy"),
        F.max("max_drawdown").alias("worst_drawdown"),
        F.sum("trades").alias("trades"),
        F.count(F.lit(1)).alias("months"),
    )
    return rows.withColumn("score", (F.col("total") * F.col("positive") + F.col("expectancy")) / (1 + F.col("worst_drawdown")))


def walk_forward(months: DataFrame, train_months: int = 6, top: int = 3) -> DataFrame:
    """Each test month with the ``top`` candidates by mean return of the months before; strictly earlier ones only.

    Months are numbered on the calendar, so a candidate's missing month counts as none.
    """
    number = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 6, 2).cast("int")).alias("m")
    rows = months.select("candidate_id", "month", "return_ratio", "trades", number)
    before = Window.partitionBy("candidate_id").orderBy("m").rangeBetween(-train_months, -1)
    rows = rows.withColumn("train_mean", F.avg("return_ratio").over(before)).withColumn("train_n", F.count("return_ratio").over(before))
    order = Window.partitionBy("month").orderBy(F.desc("train_mean"), "candidate_id")
    rows = rows.where(F.col("train_n") == train_months).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return rows.select("month", "candidate_id", "place", "train_mean", F.col("return_ratio").alias("test_return"), F.col("trades").alias("test_trades"))


def exposure(trades: DataFrame, limit: float, odd: float, by: str = "candidate_id", cash: float = CASH) -> DataFrame:
    """Worst day's loss and largest day's notional against the equity before it, days over ``limit``, share of odd trades."""
    rows = trades.groupBy(by, F.to_date("exit_ts").alias("day")).agg(
        F.sum("pnl").alias("pnl"), F.sum("notional").alias("notional"), F.count(F.lit(1)).alias("trades"), F.count(F.when(F.abs("ret") > odd, 1)).alias("odd")
    )
    earlier = Window.partitionBy(by).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", cash + F.coalesce(F.sum("pnl").over(earlier), F.lit(0.0)))
    used = F.col("notional") / F.col("before")
    return rows.groupBy(by).agg(
        F.max(F.greatest(F.lit(0.0), -F.col("pnl")) / F.col("before")).alias("worst_day_ratio"), F.max(used).alias("largest_exposure"),
        F.count(F.when(used > limit, 1)).alias("days_over_limit"), (F.sum("odd") / F.sum("trades")).alias("anomaly_rate"),
    )


def diagnostics(trades: DataFrame, by: str = "candidate_id") -> DataFrame:
    """Share of days without a trade, turnover (both legs), share of the five best trades in all gains, share of all trades."""
    best = Window.partitionBy(by).orderBy(F.desc("pnl"), "trade_id")
    gain = F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)
    day = F.to_date("exit_ts")
    rows = trades.withColumn("rn", F.row_number().over(best)).groupBy(by).agg(
        (1 - F.countDistinct(day) / (F.date_diff(F.max(day), F.min(day)) + 1)).alias("cash_share"), F.sum(2 * F.col("notional") + F.col("pnl")).alias("turnover"),
        F.try_divide(F.sum(F.when(F.col("rn") <= 5, gain)), F.sum(gain)).alias("top_5_share"), F.count(F.lit(1)).alias("own"),
    )
    total = rows.agg(F.sum("own").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("trade_share", F.col("own") / F.col("total")).drop("own", "total")  # one row
