"""Borders of rules: how many bars they wait for, and what an opening range needs."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import htf
from tickloom.operators import microstructure as m
from tickloom.operators import trend as t

START = datetime(2024, 5, 6)


def bars(spark, closes, minutes=60, start=START):
    step = timedelta(minutes=minutes)
    rows = [("A", start + i * step, start + (i + 1) * step, float(c), float(c) + 0.1, float(c) - 0.1, float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, opened_at timestamp, closed_at timestamp, open double, high double, low double, close double")


def directions(df):
    return [r.direction for r in df.orderBy("opened_at").collect()]


@pytest.mark.parametrize(
    ("rule", "n"),
    [
        (lambda b: t.pullback_resume(b, 10, 6, 1, least_trend=0.01, least_pullback=0.001, resume=0.0001), 12),
        (lambda b: t.timed_acceleration(b, 10, 2, least_trend=0.01, least_impulse=0.0001, hour=11), 12),
        (lambda b: t.swing_retest(b, 10, 6, least=0.01, depth=0.001, reclaim=0.0001), 12),
        (lambda b: t.exhaustion_reversal(b, 4, 0.001, 1, 0.0001, 10, low=1.1), 11),
    ],
)
def test_rules_wait_for_all_their_bars(spark, rule, n):
    """A series whose last bar signals does so from n bars on, not with one bar fewer."""
    climb = [100, 101, 102, 103, 104, 105, 106, 107, 108, 106.0, 106.5, 107.2]
    fall = [110, 109, 108, 107, 106, 105, 104, 103, 102, 101, 100, 100.5]
    closes = fall if n == 11 else climb
    assert directions(rule(bars(spark, closes[-n:], start=START + timedelta(hours=12 - n))))[-1] == "long"
    assert directions(rule(bars(spark, closes[-n + 1 :], start=START + timedelta(hours=13 - n))))[-1] == "wait"


def opening(spark, skip=(), last=102.0):
    closes = [100, 100.5, 101, 100.2, 100.4] * 3 + [100.6, 100.7, 100.8, 100.9, 101.0, last]
    df = bars(spark, closes, minutes=1, start=START + timedelta(hours=7))
    df = df.where(~F.minute("opened_at").isin(*skip)) if skip else df
    return df.withColumns({"taker_imbalance": F.lit(0.5), "cvd_delta": F.lit(1.0), "trade_intensity": F.lit(500)})


def test_opening_range_needs_its_minutes_and_a_closed_confirmation(spark):
    signal = lambda df, **kw: directions(m.session_opening_range(df, **kw))
    assert signal(opening(spark))[-1] == "long"
    assert signal(opening(spark, skip=[7]))[-1] == "wait", "one of the fifteen minutes is missing"
    assert signal(opening(spark, skip=[17]))[-1] == "wait", "the closed five minutes are not whole"
    assert signal(opening(spark, last=101.05))[-1] == "wait", "inside the range"
    assert signal(opening(spark), minutes=20)[-1] == "long"
    assert signal(opening(spark), minutes=21)[-1] == "wait", "the bar lies in the range itself"


@pytest.mark.parametrize("p", [2, 3, 7, 16, 40, 61])
def test_long_ranges_from_blocks(spark, p):
    closes = [(i * 37) % 101 + (i % 7) for i in range(150)]
    rows = htf.prior_extremes(bars(spark, closes).repartition(4), p, "top", "bottom").orderBy("opened_at").collect()
    for i, r in enumerate(rows):
        before = closes[i - p : i] if i >= p else None
        assert (r.top, r.bottom) == ((None, None) if before is None else (max(before) + 0.1, min(before) - 0.1)), i


def test_higher_time_frame_rules_wait_one_bar_more_and_for_their_interval(spark):
    climb = [100 + i for i in range(40)]
    rule = lambda df, **kw: directions(htf.donchian(df, 20, 5, 6, 0.01, 0.001, 0.0, **kw))
    assert rule(bars(spark, climb[:22], minutes=1), interval=1) == ["wait"] * 21 + ["long"]
    assert [i for i, d in enumerate(rule(bars(spark, climb, minutes=1), interval=10)) if d == "long"] == [30]
    fall = [200 - i for i in range(24)]
    assert directions(htf.acceleration(bars(spark, fall, minutes=1), 15, 3, 6, 0.01, 0.001, 0.001, 0.5, 1))[-1] == "short"
    dip = [100 + i for i in range(30)] + [120, 119, 118, 126]
    assert directions(htf.pullback(bars(spark, dip, minutes=1), 25, 12, 8, 3, 0.01, 0.001, 0.01, 0.0, 1))[-1] == "long"


def test_regime_entry_and_exit_by_hand(spark):
    base = {"symbol": "A", "close": 100.0, "volume": 5.0, "ema_fast": 1.0, "ema_slow": 2.0, "adx": 30.0, "atr": 1.0, "rsi": 60.0, "upper": 99.0, "lower": 90.0}
    cases = [
        ({}, "short"), ({"adx": 20.0}, "wait"), ({"rsi": 57.0}, "wait"), ({"atr": 0.3}, "wait"), ({"close": 98.0}, "wait"), ({"volume": 0.0}, "wait"), ({"upper": None}, "wait"),
        ({"ema_fast": 3.0, "lower": 101.0, "upper": 110.0, "rsi": 40.0}, "long"), ({"ema_fast": 3.0, "lower": 101.0, "upper": 110.0, "rsi": 43.0}, "wait"), ({"ema_slow": None}, "wait"),
    ]
    names = list(base)
    rows = [tuple({**base, **c}[n] for n in names) + (START + timedelta(hours=i),) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, ", ".join("symbol string" if n == "symbol" else f"{n} double" for n in names) + ", opened_at timestamp")
    got = t.regime_entry(df).orderBy("opened_at").collect()
    assert [r.direction for r in got] == [d for _, d in cases]
    assert got[0].confidence == pytest.approx(0.55 + 0.25 * 0.5 + 0.2 * 0.75)
    leave = lambda **c: t.regime_exit(df.limit(1).withColumns({k: F.lit(v).cast("double") for k, v in c.items()})).first()
    assert leave(c_close=1.0, rsi=50.0).leave == "long" and leave(c_close=3.0, rsi=44.0).leave == "long"
    assert leave(c_close=3.0, rsi=50.0).leave == "short" and leave(c_close=2.0, rsi=56.0).leave == "short"
    assert leave(c_close=2.0, rsi=50.0).reason == "keep_position" and leave(c_close=None).reason == "missing_required_fields"
    assert t.regime_exit(df).first().reason == "missing_required_fields", "the exit reads a column of its own"
