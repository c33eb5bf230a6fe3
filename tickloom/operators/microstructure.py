"""Rules on order flow, open interest, positioning, premium and sessions, with all their conditions.

Input rows are bars with the features a rule names (null where a source has nothing); a rule whose feature
is missing, or whose window is not full yet, waits. Limits are parameters with their usual values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .signals import signal
from .windows import by_time, prior_full, shift


def flow_features(ticks: DataFrame, every: str = "1 hour") -> DataFrame:
    """Bars with taker_imbalance, cvd_delta, trade_intensity, taker_ratio, global_ratio, top_ratio, and their changes.

    ``ticks`` have ``buy``; ratios are of bought to sold quantity, trades and largest trades.
    """
    side = lambda fn, c, buy: fn(F.when(F.col("buy") == buy, F.col(c)))
    order = F.struct("ts", "trade_id")
    rows = ticks.groupBy("symbol", F.window("ts", every).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"),
        F.avg("price").alias("mean_price"), F.count(F.lit(1)).alias("trade_intensity"),
        F.coalesce(side(F.sum, "qty", True), F.lit(0.0)).alias("bought"), F.coalesce(side(F.sum, "qty", False), F.lit(0.0)).alias("sold"),
        side(F.count, "qty", True).alias("buys"), side(F.count, "qty", False).alias("sells"), side(F.max, "qty", True).alias("top_buy"), side(F.max, "qty", False).alias("top_sell"),
    )
    rows = rows.withColumn("opened_at", F.col("w.start")).withColumn("closed_at", F.col("w.end")).drop("w")
    rows = rows.withColumn("cvd_delta", F.col("bought") - F.col("sold")).withColumn("taker_imbalance", F.try_divide(F.col("cvd_delta"), F.col("volume")))
    for name, a, b in (("taker_ratio", "bought", "sold"), ("global_ratio", "buys", "sells"), ("top_ratio", "top_buy", "top_sell")):
        rows = rows.withColumn(name, F.try_divide(F.col(a), F.col(b)))
    rows = rows.withColumn("global_change", F.col("global_ratio") - shift("global_ratio", 1)).withColumn("interest_change", F.try_divide(F.col("volume"), shift("volume", 1)) - 1)
    return rows.withColumn("premium", F.try_divide(F.col("close"), F.col("mean_price")) - 1).withColumn("basis", F.try_divide(F.col("close"), F.col("open")) - 1)


def rejection() -> tuple[Column, Column]:
    """(lower, upper) wick as a share of the bar's range; 0 for a bar without one."""
    span = F.col("high") - F.col("low")
    share = lambda part: F.when(span > 0, part / span).otherwise(0.0)
    return share(F.least("open", "close") - F.col("low")), share(F.col("high") - F.greatest("open", "close"))


def _flow(imbalance: float, cvd: float, intensity: float | None = None) -> tuple[Column, Column]:
    """Flow that confirms a long and a short."""
    loud = F.lit(True) if intensity is None else F.col("trade_intensity") >= intensity
    up = (F.col("taker_imbalance") >= imbalance) & (F.col("cvd_delta") >= cvd) & loud
    return up, (F.col("taker_imbalance") <= -imbalance) & (F.col("cvd_delta") <= -cvd) & loud


def _edge(edge: float) -> tuple[Column, Column]:
    return F.col("taker_ratio") >= 1 + edge, F.col("taker_ratio") <= 1 - edge


def flow_confirmed_breakout(rows: DataFrame, w: int = 20, buffer: float = 0.0, imbalance: float = 0.2, cvd: float = 0.0, intensity: float = 100, confidence: float = 0.7) -> DataFrame:
    up, down = _flow(imbalance, cvd, intensity)
    high, low = prior_full(F.max("high"), w) * (1 + buffer), prior_full(F.min("low"), w) * (1 - buffer)
    return signal(rows.withColumn("ph", high).withColumn("pl", low), (F.col("close") > F.col("ph")) & up, (F.col("close") < F.col("pl")) & down, F.lit(confidence))


def flow_exhaustion_reversal(rows: DataFrame, w: int = 20, wick: float = 0.35, imbalance: float = 0.15, cvd: float = 0.0, confidence: float = 0.68) -> DataFrame:
    """A new extreme that is rejected while the flow turns."""
    (up, down), (lower, upper) = _flow(imbalance, cvd), rejection()
    rows = rows.withColumn("ph", prior_full(F.max("high"), w)).withColumn("pl", prior_full(F.min("low"), w))
    long = (F.col("low") < F.col("pl")) & (F.col("close") > F.col("open")) & (lower >= wick) & up
    return signal(rows, long, (F.col("high") > F.col("ph")) & (F.col("close") < F.col("open")) & (upper >= wick) & down, F.lit(confidence))


def interest_impulse(rows: DataFrame, n: int = 5, move: float = 0.002, grown: float = 0.002, edge: float = 0.1, confidence: float = 0.72) -> DataFrame:
    (bought, sold), more = _edge(edge), F.col("interest_change") >= grown
    rows = rows.withColumn("move", F.col("close") / shift("close", n) - 1)
    return signal(rows, (F.col("move") >= move) & more & bought, (F.col("move") <= -move) & more & sold, F.lit(confidence))


def interest_divergence(rows: DataFrame, n: int = 5, move: float = 0.002, shrunk: float = 0.002, edge: float = 0.1, confidence: float = 0.7) -> DataFrame:
    """A move on falling open interest, against which takers trade."""
    (bought, sold), less = _edge(edge), F.col("interest_change") <= -shrunk
    rows = rows.withColumn("move", F.col("close") / shift("close", n) - 1)
    return signal(rows, (F.col("move") <= -move) & less & bought, (F.col("move") >= move) & less & sold, F.lit(confidence))


def positioning_crowding(rows: DataFrame, crowded_short: float = 0.85, crowded_long: float = 1.25, edge: float = 0.1, wick: float = 0.35, confidence: float = 0.72) -> DataFrame:
    """Both positioning ratios on one side, takers and the bar on the other."""
    (bought, sold), (lower, upper) = _edge(edge), rejection()
    long = (F.col("top_ratio") <= crowded_short) & (F.col("global_ratio") <= crowded_short) & bought & (F.col("close") > F.col("open")) & (lower >= wick)
    short = (F.col("top_ratio") >= crowded_long) & (F.col("global_ratio") >= crowded_long) & sold & (F.col("close") < F.col("open")) & (upper >= wick)
    return signal(rows, long, short, F.lit(confidence))


def global_ratio_shock(rows: DataFrame, least: float = 0.05, shocks: str = "both", confidence: float = 0.74) -> DataFrame:
    """Against a jump of the positioning ratio; ``shocks`` are up, down or both."""
    up = (F.col("global_change") >= least) & F.lit(shocks in ("up", "both"))
    down = (F.col("global_change") <= -least) & F.lit(shocks in ("down", "both"))
    return signal(rows, down, up, F.lit(confidence))


def premium_funding(rows: DataFrame, premium: float = 0.0008, basis: float = 0.0008, funding: float = 0.0001, wick: float = 0.25, imbalance: float = 0.15, cvd: float = 0.0, confidence: float = 0.7, boost: float = 0.05) -> DataFrame:
    """Against an extreme premium (else basis) once bar and flow turn; funding of the same sign adds confidence."""
    (up, down), (lower, upper) = _flow(imbalance, cvd), rejection()
    far = F.when(F.abs("premium") >= premium, F.col("premium")).when(F.abs("basis") >= basis, F.col("basis"))
    rows = rows.withColumn("far", far)
    helped = F.coalesce((F.abs("rate") >= funding) & (F.col("rate") * F.col("far") > 0), F.lit(False))
    long = (F.col("far") < 0) & (F.col("close") > F.col("open")) & (lower >= wick) & up
    short = (F.col("far") > 0) & (F.col("close") < F.col("open")) & (upper >= wick) & down
    return signal(rows, long, short, F.lit(confidence) + F.when(helped, boost).otherwise(0.0))


#: Minutes of the UTC day at which sessions open.
SESSIONS = {"asia": 0, "europe": 7 * 60, "us": 13 * 60 + 30}


def session_opening_range(
    rows: DataFrame, minutes: int = 15, bar_minutes: int = 1, confirm: int = 5, buffer: float = 0.0, move: float = 0.0005, imbalance: float = 0.15, cvd: float = 0.0, intensity: float = 100, confidence: float = 0.69
) -> DataFrame:
    """Breaks of the range of a session's first ``minutes`` by bars of ``bar_minutes`` that open after them, in that session.

    The range needs every one of its bars. The move is against the close of the last whole ``confirm`` minutes on the
    clock that ended when the bar opened or before; where one of their bars is missing there is no signal.
    """
    day, minute = F.date_trunc("day", "opened_at"), F.hour("opened_at") * 60 + F.minute("opened_at")
    name = start = None
    for k, v in reversed(SESSIONS.items()):
        name = F.when(minute >= v, k) if name is None else name.when(minute >= v, k)
        start = F.when(minute >= v, v) if start is None else start.when(minute >= v, v)
    rows = rows.withColumn("session", name).withColumn("session_at", day + F.make_dt_interval(F.lit(0), F.lit(0), start))
    since = F.unix_timestamp("opened_at") - F.unix_timestamp("session_at")
    first = rows.where(since < minutes * 60).groupBy("symbol", "session_at").agg(F.max("high").alias("rh"), F.min("low").alias("rl"), F.count(F.lit(1)).alias("n"))
    first = first.where(F.col("n") == minutes // bar_minutes).drop("n")
    step, at = confirm * 60, F.floor(F.unix_timestamp("opened_at") / (confirm * 60))
    closed = rows.groupBy("symbol", (at + 1).alias("part")).agg(F.max_by("close", "opened_at").alias("before"), F.count(F.lit(1)).alias("n"))
    closed = closed.where(F.col("n") == step // (bar_minutes * 60)).drop("n")
    rows = rows.withColumn("part", at).join(first, ["symbol", "session_at"], "left").join(closed, ["symbol", "part"], "left")
    rows = rows.withColumn("move", F.col("close") / F.col("before") - 1)
    later, (up, down) = since >= minutes * 60, _flow(imbalance, cvd, intensity)
    long = later & (F.col("close") > F.col("rh") * (1 + buffer)) & (F.col("move") >= move) & up
    short = later & (F.col("close") < F.col("rl") * (1 - buffer)) & (F.col("move") <= -move) & down
    return signal(rows, long, short, F.lit(confidence))
