"""Hand-computed cases and properties of the market operators."""

import datetime as dt
import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, bars, features, indicators, inference, profile, recursive, signals, simulation, stats, windows
from tickloom.sources import archives, sinks
from tickloom.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def series(spark, closes, symbol="A", volume=10.0, spread=1.0):
    rows, before = [], closes[0]
    for i, c in enumerate(closes):
        at = T0 + i * HOUR
        rows.append((symbol, at, at + HOUR, float(before), max(before, c) + spread, min(before, c) - spread, float(c), float(volume)))
        before = c
    return spark.createDataFrame(rows, "symbol string, opened_at timestamp, closed_at timestamp, open double, high double, low double, close double, volume double")


def in_order(df, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy("opened_at").select(*columns).collect()]


def walk(n, seed=1):
    return (100 + np.random.default_rng(seed).normal(0, 1, n).cumsum()).round(2).tolist()


def test_three_bar_mean(spark):
    out = signals.ma_signal(series(spark, [100, 101, 103]), w=3)
    assert in_order(out, "sma") == [None, None, pytest.approx(304 / 3)]
    assert in_order(out, "direction") == ["wait", "wait", "long"]


def test_ties_and_gaps_of_bars(spark):
    rows = [("A", T0, 2, 5.0, 1.0), ("A", T0, 1, 4.0, 1.0), ("A", T0 + 3 * HOUR, 3, 9.0, 2.0)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, trade_id long, price double, qty double")
    b = bars.bars_of(ticks, "1 hour")
    assert in_order(b, "open", "close") == [(4.0, 5.0), (9.0, 9.0)]
    dense = bars.dense_bars(b, 3600)
    assert in_order(dense, "close", "volume") == [(5.0, 2.0), (5.0, 0.0), (5.0, 0.0), (9.0, 2.0)]
    assert bars.gaps(b, 3600).first().missing == 2
    assert bars.coarser(dense, "4 hours", need=4).first().volume == 4.0
    assert bars.coarser(dense, "4 hours", need=5).count() == 0 and bars.incomplete(dense, "4 hours", 5).count() == 1


@pytest.mark.parametrize("name", ["rsi", "ema_fast", "atr"])
def test_recursive_indicators_against_pandas(spark, name):
    c = pd.Series(walk(200))
    b = series(spark, c.tolist())
    if name == "rsi":
        step = c.diff().fillna(0)
        gain, loss = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (step.clip(lower=0), -step.clip(upper=0)))
        want, got = (100 - 100 / (1 + gain / loss)).fillna(0), indicators.rsi(b)
    elif name == "ema_fast":
        want, got = c.ewm(span=12, adjust=False, min_periods=12).mean(), indicators.ema(b)
    else:
        before = c.shift(1).fillna(c.iloc[0])
        hi, lo = np.maximum(before, c) + 1, np.minimum(before, c) - 1
        tr = pd.concat([hi - lo, (hi - c.shift(1)).abs(), (lo - c.shift(1)).abs()], axis=1).max(axis=1)
        want, got = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), indicators.atr(b)
    values = in_order(got, name)
    assert [v is None for v in values] == want.isna().tolist()
    assert np.allclose(want.dropna(), [v for v in values if v is not None])


def test_conventions(spark):
    up = series(spark, list(range(100, 140)))
    assert in_order(indicators.rsi(up), "rsi")[-1] == 0.0
    assert in_order(indicators.mfi(up), "mfi")[-1] == 50.0
    flat = series(spark, [50] * 30, spread=0.0)
    assert set(in_order(indicators.cci(flat), "cci")) == {0.0}
    assert in_order(indicators.stochastic(flat), "k", "d")[-1] == (0.0, 0.0)


def test_no_look_ahead_and_scale(spark):
    c = walk(120)
    whole, part = series(spark, c), series(spark, c[:80])
    for build in (lambda b: signals.compression_breakout(b), lambda b: signals.range_edge(b), lambda b: signals.exhaustion(b)):
        assert in_order(build(whole), "direction")[:80] == in_order(build(part), "direction")
        scaled = whole.select("symbol", "opened_at", "closed_at", *((F.col(k) * 8).alias(k) for k in ("open", "high", "low", "close")), "volume")
        assert in_order(build(scaled), "direction") == in_order(build(whole), "direction")


def test_features_are_scale_free_and_whole_windows_only(spark):
    b = series(spark, [abs(x) + 50 for x in walk(24 * 8, 4)])
    scaled = b.select("symbol", "opened_at", "closed_at", *((F.col(k) * 4).alias(k) for k in ("open", "high", "low", "close")), "volume")
    one, two = (features.registry(x, bar_s=3600, days=3, breakout=24).orderBy("anchor_at").collect() for x in (b, scaled))
    assert len(one) == 6
    for r, s in zip(one, two, strict=True):
        assert np.allclose(r[2:], s[2:])
    close = [r.close for r in b.orderBy("opened_at").collect()]
    first_open = b.orderBy("opened_at").first().open
    assert one[0].ret_full == pytest.approx(close[71] / first_open - 1)
    gap = b.where(F.col("opened_at") != F.lit(T0 + 30 * HOUR))
    assert features.registry(gap, bar_s=3600, days=3, breakout=24).count() < 6


def test_asof_cases(spark):
    day = dt.timedelta(days=1)
    left = spark.createDataFrame([("A", T0 + k * day) for k in (0, 1, 2, 9)] + [("B", T0)], "k string, t timestamp")
    right = spark.createDataFrame([("A", T0 + day, 1.0), ("A", T0 + day + HOUR, 2.0), ("A", T0 + 9 * day, 3.0)], "k string, at timestamp, v double")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", "at").collect()}
    assert got == {("A", T0): None, ("A", T0 + day): 1.0, ("A", T0 + 2 * day): 2.0, ("A", T0 + 9 * day): 3.0, ("B", T0): None}
    tight = {r.t: r.v for r in asof.asof_join(left, right, ["k"], "t", "at", 23 * 3600).where("k = 'A'").collect()}
    assert tight[T0 + 2 * day] == 2.0
    assert {r.t: r.v for r in asof.asof_join(left, right, ["k"], "t", "at", 23 * 3600 - 1).where("k = 'A'").collect()}[T0 + 2 * day] is None
    assert asof.asof_join(left, right.limit(0), ["k"], "t", "at").where("v is not null").count() == 0


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.choice(["a", "b"], 300), "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, 300), unit="s")}).drop_duplicates().sort_values("t")
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "at": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 10**6, 60), unit="s"), "v": rng.normal(size=60)}).sort_values("at")
    want = pd.merge_asof(left, right, left_on="t", right_on="at", by="k", tolerance=pd.Timedelta("20h"))
    got = asof.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "at", 20 * 3600).toPandas()
    both = want.merge(got, on=["k", "t"], suffixes=("", "_got"))
    assert len(both) == len(left) and np.allclose(both["v"].fillna(-9), both["v_got"].fillna(-9))


def test_changes_need_the_exact_step(spark):
    rows = [("A", T0 + dt.timedelta(minutes=m), v) for m, v in ((0, 10.0), (5, 12.0), (15, 15.0), (20, 18.0))]
    df = spark.createDataFrame(rows, "symbol string, at timestamp, v double").withColumn("d", windows.change_if_step("v", "at", 300))
    assert [r.d for r in df.orderBy("at").collect()] == [None, 2.0, None, 3.0]


def test_hysteresis(spark):
    raw = ["a", "b", "a", "b", "b", "a", "a", "a", "b"]
    df = spark.createDataFrame([("A", i, r) for i, r in enumerate(raw)], "symbol string, opened_at int, raw string")
    assert in_order(recursive.hysteresis(df, "raw", "state"), "state") == ["a", "a", "a", "a", "b", "b", "a", "a", "a"]


def test_value_area(spark):
    rows = [(1, 1.0), (2, 3.0), (3, 10.0), (4, 3.0), (5, 2.0)]
    p = spark.createDataFrame([("A", b, v) for b, v in rows], "symbol string, bin long, volume double")
    r = profile.value_area(p, ["symbol"], 0.8).first()
    assert (r.poc, r.area_low, r.area_high, r.area_volume) == (3, 2, 4, 16.0)


def trade(spark, bars_, **kw):
    p = simulation.Policy("p", slippage=0.0, fee=0.0, **kw)
    cols = "symbol string, closed_at timestamp, high double, low double, close double, direction string, confidence double, atr double"
    df = spark.createDataFrame([("A", T0 + i * HOUR, *b) for i, b in enumerate(bars_)], cols)
    return simulation.simulate(df, [p], 1000.0).orderBy("exit_at").collect()


def bar(high, low, close, direction="wait", confidence=1.0, atr=2.0):
    return (float(high), float(low), float(close), direction, confidence, atr)


def test_stop_before_target_and_no_entry_on_the_exit_bar(spark):
    out = trade(spark, [bar(100, 100, 100, "long"), bar(130, 80, 100, "long"), bar(101, 99, 100, "long"), bar(121, 100, 120)], stop=0.1, target=0.2)
    assert [(r.reason, r.exit_price, r.held) for r in out] == [("stop", 90.0, 1), ("target", 120.0, 1)]
    assert out[0].equity == pytest.approx(1000 - 10) and out[0].adverse == pytest.approx(0.2)


def test_opposite_time_and_end(spark):
    out = trade(spark, [bar(100, 100, 100, "short"), bar(101, 99, 99, "long"), bar(100, 99, 99, "long"), bar(100, 99, 99.5)], stop=0.5, target=0.5)
    assert [r.reason for r in out] == ["opposite", "end"]
    out = trade(spark, [bar(100, 100, 100, "long"), bar(101, 99, 99), bar(200, 1, 100)], exit="time", max_bars=2, stop=0.5, target=0.5)
    assert [(r.reason, r.exit_price) for r in out] == [("time", 100.0)]


def test_trailing_partial_and_atr(spark):
    up = [bar(100, 100, 100, "long"), bar(120, 100, 118), bar(125, 117, 120), bar(121, 110, 112)]
    out = trade(spark, up, exit="trailing", stop=0.3, trail=0.1)
    assert [(r.reason, r.exit_price) for r in out] == [("trail", 115.0)]
    out = trade(spark, up, exit="partial_trailing", stop=0.3, target=0.15, trail=0.1)
    assert [(r.reason, r.exit_price, r.quantity) for r in out] == [("partial", 115.0, 0.5), ("trail", 115.0, 0.5)]
    out = trade(spark, [bar(100, 100, 100, "long"), bar(101, 96, 97)], exit="atr", stop=1.5, target=3.0)
    assert [(r.reason, r.exit_price) for r in out] == [("stop", 97.0)]


def test_guard(spark):
    losing = [bar(100, 100, 100, "long"), bar(100, 80, 90)] * 6
    kw = {"stop": 0.1, "target": 0.5}
    assert len(trade(spark, losing, **kw)) == 6
    assert len(trade(spark, losing, daily_cap=2, **kw)) == 2
    assert len(trade(spark, losing, loss_run=2, pause=5, **kw)) == 4
    assert len(trade(spark, losing, spacing=4, **kw)) == 3
    assert len(trade(spark, losing, peak_loss=0.015, **kw)) == 2


def test_selection_states(spark):
    seq = [(1, False), (1, True), (2, True), (1, True), (2, True), (2, True), (2, False), (2, False), (1, True)]
    df = spark.createDataFrame([("A", i, c, s) for i, (c, s) in enumerate(seq)], "k string, n int, c int, sure boolean")
    out = inference.selection_states(df, "k", "n", "c", "sure").orderBy("n").collect()
    assert [r.current for r in out] == [None, 1, 1, 1, 1, 2, 2, None, 1]


def test_daily_bounds(spark):
    rng = np.random.default_rng(1)
    rows = [("f", c, i, float(rng.normal(m, 0.01))) for c, m in (("good", 0.01), ("none", 0.0)) for i in range(120)]
    df = spark.createDataFrame(rows, "f string, c string, d int, r double")
    low, high = ({r.c: r for r in inference.family_bounds(df, "f", "c", "d", "r", draws=400, level=v).collect()} for v in (0.9, 0.99))
    assert low["good"].bound > 0 > low["none"].bound
    assert all(high[c].bound <= low[c].bound <= low[c].mean for c in low)


def test_pivots_keep_the_more_extreme(spark):
    closes = [1, 2, 3, 9, 3, 2, 1, 2, 8, 2, 1, 1, 1, 1]
    out = inference.separate_pivots(series(spark, [c * 10 for c in closes], spread=0.5), k=2).where("kind = 'high'").orderBy("rn").collect()
    assert [r.price for r in out][:2] == [90.5, 80.5] and all(b.rn - a.rn > 2 for a, b in zip(out, out[1:], strict=False))


def test_statistics(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    r = stats.agreement(df, "a", "b").first()
    assert r.ari == pytest.approx(1.0) and r.nmi == pytest.approx(1.0)
    same = stats.divergence(df.withColumnRenamed("a", "l"), df.withColumnRenamed("a", "l"), "l").first()
    assert same.divergence == pytest.approx(0.0)
    apart = stats.divergence(df.where("a = 0").withColumnRenamed("a", "l"), df.where("a = 1").withColumnRenamed("a", "l"), "l").first()
    assert apart.divergence == pytest.approx(np.log(2)) and apart.l1 == pytest.approx(2.0)
    assert stats.entropy(df, "a", 3).first().entropy == pytest.approx(1.0)


def test_vote_ties(spark):
    rows = [(1, "long", 0.4), (1, "long", 0.2), (1, "short", 0.5), (2, "long", 0.5), (2, "short", 0.5), (3, "wait", 0.0)]
    out = signals.vote(spark.createDataFrame(rows, "k int, direction string, confidence double"), ["k"]).orderBy("k").collect()
    assert [(r.direction, round(r.confidence, 6)) for r in out] == [("long", 0.3), ("wait", 0.0), ("wait", 0.0)]


def archive(path, name, text):
    with zipfile.ZipFile(path / name, "w") as z:
        z.writestr(name.replace(".zip", ".csv"), text)


def test_zipped_csv(spark, tmp_path):
    columns = ["open_time", "open", "high", "low", "close", "volume", "taker_buy_volume"]
    archive(tmp_path, "a.zip", "﻿" + ",".join(columns) + "\n1704067200000,1,2,0.5,1.5,10,4\n")
    archive(tmp_path, "b.zip", "1704067260000,1,2,0.5,1.5,10,14\n1704067320000,1,1,2,x,0,0\n")
    rows = archives.klines(archives.read_zipped_csv(spark, f"file://{tmp_path}", columns))
    got = {r.opened_at.minute: r for r in rows.collect()}
    assert got[0].taker_sell == 6.0 and got[0].taker_imbalance == pytest.approx(-0.2)
    broken = {r.opened_at.minute: r.broken for r in archives.violations(rows).collect()}
    assert broken == {1: ["taker_above_total"], 2: ["not_finite", "outside_range"]}
    with pytest.raises(ValueError, match="taker_above_total|not_finite"):
        archives.assert_clean(rows)
    two = io.BytesIO()
    with zipfile.ZipFile(two, "w") as z:
        z.writestr("a.csv", "1\n")
        z.writestr("b.csv", "1\n")
    with pytest.raises(ValueError, match="one CSV"):
        list(archives.unpacked("two.zip", two.getvalue()))


def test_headers_and_pieces(spark, tmp_path):
    archive(tmp_path, "h.zip", "1.5,b\r\n7,x\r\n\r\n-8,\"y, z\"")
    got = archives.read_zipped_csv(spark, f"file://{tmp_path}", ["a", "b"]).orderBy("line").collect()
    assert [(r.line, r.a, r.b) for r in got] == [(1, "7", "x"), (3, "-8", "y, z")]
    content = (tmp_path / "h.zip").read_bytes()
    assert [x for run in archives.unpacked("h", content, 3) for x in run] == ["1.5,b", "7,x", "", '-8,"y, z"']


def test_funding_and_price_rows(spark):
    raw = ['{"fundingTime": 1704067200000, "fundingRate": "0.0001"}', '{"calc_time": "1704067200000", "last_funding_rate": -2e-4}', "[1704067200000, 8, 0.5]", '{"calc_time": 5}', '{"calc_time": "x", "fundingRate": 1}', '{"calc_time": 1, "fundingRate": "NaN"}']
    got = archives.funding_rows(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string")).orderBy("i").collect()
    assert [r.rate for r in got[:3]] == [0.0001, -0.0002, 0.5] and [r.broken for r in got] == [None, None, None, "missing", "bad_time", "not_finite"]
    rows = [("markPriceKlines", "0", "5"), ("premiumIndexKlines", "0", "-0.1"), ("indexPriceKlines", "0", "0"), ("x", "0", "1"), ("markPriceKlines", "-1", "1"), ("markPriceKlines", "0", "inf")]
    got = archives.price_klines(spark.createDataFrame(rows, "source string, open_time string, close string")).collect()
    assert [r.broken for r in got] == [None, None, "not_positive", "unknown_source", "bad_time", "not_finite"]


def test_appending_is_idempotent(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.append_new(df, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    other = spark.createDataFrame([(1, "a"), (2, "c")], "k int, v string")
    assert [r.k for r in sinks.conflicts(other, spark.read.parquet(path), ["k"], ["v"]).collect()] == [2]
    merged = {r.k: (r.v, r.conflict) for r in sinks.merged_shards(df.distinct(), other, ["k"], "v").collect()}
    assert merged == {1: ("a", False), 2: ("b", True)}


def test_late_ticks_are_dropped_from_streams(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame([(i, t, 1, "A", float(i), '{"k": 1}') for i, t in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{name}")

    batch("events", [(1, T0), (2, T0 + 5 * HOUR)])
    stream = jobs.stream_bars(jobs.tick_stream(spark, f"file://{tmp_path}/events"), "1 hour", "10 minutes")
    assert [r.trades for r in jobs.run_to_end(stream).collect()] == [1]
