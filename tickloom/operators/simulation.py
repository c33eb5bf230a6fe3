"""Sequential trade simulation: one position at a time, sized from the running equity.

Each bar depends on the trade before it, so a (symbol, policy) pair runs in order in one grouped task;
pairs run in parallel. Input rows carry ``direction`` and ``confidence`` (any strategy), so strategies
stay DataFrame code. Rules: on every bar after the entry the stop is asked before the target, a
time limit before both; an opposite signal closes at the close; no entry on the bar of an exit; what is
open at the end closes at the last close. Slippage moves both fills against the trader and fees are
taken on both notionals.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """One way to trade; a row of the policy table. Zero switches a limit off."""

    policy_id: str
    exit: str = "fixed"  # fixed, time, atr, trailing or partial_trailing
    stop: float = 0.1
    target: float = 0.2
    max_bars: int = 0
    trail: float = 0.0
    equity_share: float = 0.1
    leverage: float = 1.0
    by_confidence: bool = False
    fee: float = 0.0004
    slippage: float = 0.0002
    opposite: bool = True
    spacing: int = 0
    daily_cap: int = 0
    loss_run: int = 0
    pause: int = 0
    peak_loss: float = 0.0
    daily_loss: float = 0.0


TRADES = (
    "symbol string, policy_id string, direction string, entry_at timestamp, exit_at timestamp, entry_price double, exit_price double, "
    "quantity double, gross double, fee double, net double, reason string, held int, adverse double, equity double"
)


class Account:
    """Equity, limits and the trades of one pair."""

    def __init__(self, p: Policy, cash: float):
        self.p, self.cash, self.equity, self.peak = p, cash, cash, cash
        self.rows: list[tuple] = []
        self.last_entry, self.losses, self.pause_until = -(10**9), 0, -1
        self.day, self.day_trades, self.day_start, self.stopped = None, 0, cash, False

    def new_bar(self, day) -> None:
        if day != self.day:
            self.day, self.day_trades, self.day_start = day, 0, self.equity

    def may_enter(self, i: int) -> bool:
        p = self.p
        if self.stopped or i < self.pause_until or i - self.last_entry < p.spacing:
            return False
        if p.daily_cap and self.day_trades >= p.daily_cap:
            return False
        return not (p.daily_loss and self.equity <= self.day_start * (1 - p.daily_loss))

    def enter(self, i: int, bar, side: int, confidence: float) -> dict:
        p = self.p
        price = bar.close * (1 + side * p.slippage)
        share = p.equity_share * (confidence if p.by_confidence else 1.0)
        self.last_entry, self.day_trades = i, self.day_trades + 1
        return {"i": i, "side": side, "price": price, "qty": self.equity * share * p.leverage / price, "at": bar.closed_at, "best": price, "worst": price, "unit": bar.atr if bar.atr == bar.atr else 0.0}

    def close(self, pos: dict, i: int, bar, price: float, reason: str, part: float = 1.0) -> None:
        p, side = self.p, pos["side"]
        out = price * (1 - side * p.slippage)
        qty = pos["qty"] * part
        gross = side * (out - pos["price"]) * qty
        fee = (pos["price"] + out) * qty * p.fee
        pos["qty"] -= qty
        self.equity += gross - fee
        self.peak = max(self.peak, self.equity)
        adverse = max(0.0, side * (pos["price"] - pos["worst"]) / pos["price"])
        self.rows.append(("long" if side > 0 else "short", pos["at"], bar.closed_at, pos["price"], out, qty, gross, fee, gross - fee, reason, i - pos["i"], adverse, self.equity))
        if part < 1:
            return
        self.losses = self.losses + 1 if gross - fee < 0 else 0
        if p.loss_run and self.losses >= p.loss_run:
            self.pause_until, self.losses = i + p.pause, 0
        if p.peak_loss and self.equity <= self.peak * (1 - p.peak_loss):
            self.stopped = True


def touched(p: Policy, pos: dict, bar, i: int) -> tuple[float, str] | None:
    """The price and reason of an exit on this bar; ``best`` is what earlier bars reached."""
    side, entry = pos["side"], pos["price"]
    if p.max_bars and i - pos["i"] >= p.max_bars:
        return bar.close, "time"
    against, with_ = (bar.low, bar.high) if side > 0 else (bar.high, bar.low)
    size = pos["unit"] if p.exit == "atr" else entry
    stop, target = entry - side * p.stop * size, entry + side * p.target * size
    if p.exit in ("trailing", "partial_trailing") and side * (pos["best"] - entry) > 0:
        trail = pos["best"] - side * p.trail * entry
        stop = max(stop, trail) if side > 0 else min(stop, trail)
    if side * (against - stop) <= 0:
        return stop, "trail" if side * (stop - entry) > -p.stop * size * 0.999999 and p.trail else "stop"
    if p.exit != "trailing" and not pos.get("half") and side * (with_ - target) >= 0:
        return target, "target"
    return None


def run_pair(bars: pd.DataFrame, p: Policy, cash: float = 1_000_000.0) -> list[tuple]:
    account, pos = Account(p, cash), None
    sides = {"long": 1, "short": -1}
    bar = None
    for i, bar in enumerate(bars.itertuples(index=False)):
        account.new_bar(bar.closed_at.date())
        side = sides.get(bar.direction, 0)
        if pos is not None:
            pos["worst"] = min(pos["worst"], bar.low) if pos["side"] > 0 else max(pos["worst"], bar.high)
            hit = touched(p, pos, bar, i)
            if hit and hit[1] == "target" and p.exit == "partial_trailing":
                account.close(pos, i, bar, hit[0], "partial", 0.5)
                pos["half"] = True
            elif hit:
                account.close(pos, i, bar, *hit)
                pos = None
                continue
            elif p.opposite and side == -pos["side"]:
                account.close(pos, i, bar, bar.close, "opposite")
                pos = None
                continue
            pos["best"] = max(pos["best"], bar.high) if pos["side"] > 0 else min(pos["best"], bar.low)
            continue
        if side and account.may_enter(i):
            pos = account.enter(i, bar, side, bar.confidence)
    if pos is not None:
        account.close(pos, len(bars) - 1, bar, bar.close, "end")
    return account.rows


def policy_table(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(p).values()) for p in policies], [f.name for f in fields(Policy)])


def simulate(signals: DataFrame, policies: list[Policy], cash: float = 1_000_000.0) -> DataFrame:
    """The trades of every (symbol, policy). ``signals``: bars with direction, confidence and atr."""
    by_id = {p.policy_id: p for p in policies}
    ids = F.explode(F.array(*(F.lit(i) for i in by_id))).alias("policy_id")
    rows = signals.select("symbol", "closed_at", "high", "low", "close", "direction", "confidence", "atr", ids)
    names = [c.split()[0] for c in TRADES.split(", ")]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = run_pair(part.sort_values("closed_at", kind="stable"), by_id[key[1]], cash)
        return pd.DataFrame([(*key, *r) for r in out], columns=names)

    return rows.groupBy("symbol", "policy_id").applyInPandas(run, TRADES)


def routed(signals: dict[str, DataFrame], regimes: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Signals of the strategy that the bar's regime is mapped to; unmapped regimes wait (cash)."""
    rows = None
    shared = [c for c in next(iter(signals.values())).columns if all(c in df.columns for df in signals.values())]
    for name, df in signals.items():
        part = df.select(*shared, F.lit(name).alias("strategy"))
        rows = part if rows is None else rows.unionByName(part)
    chosen = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else F.create_map()
    regimes = regimes.withColumn("strategy", chosen[F.col("regime")]).select("symbol", "closed_at", "regime", F.col("strategy").alias("wanted"))
    first = next(iter(signals))
    rows = rows.join(regimes, ["symbol", "closed_at"])
    own = rows.where(F.col("strategy") == F.coalesce("wanted", F.lit(first)))
    cash = F.col("wanted").isNull()
    return own.withColumn("direction", F.when(cash, "wait").otherwise(F.col("direction"))).withColumn("confidence", F.when(cash, 0.0).otherwise(F.col("confidence"))).drop("wanted", "strategy")
