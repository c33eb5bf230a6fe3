"""The seven-day registry against direct formulas over one window, its scale-freedom and its gaps."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tickloom.operators import chart_blocks as op

SCHEMA = "symbol string, opened_at timestamp, closed_at timestamp, open double, high double, low double, close double, volume double"
START = datetime(2024, 3, 1)


def bars(n=672, scale=1.0, skip=(), seed=2):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.003, n)))
    rows = []
    for i in range(n):
        o = close[i - 1] * (1 + rng.normal(0, 1e-4)) if i else 100.0
        hi, lo = max(o, close[i]) * (1 + abs(rng.normal(0, 1e-3))), min(o, close[i]) * (1 - abs(rng.normal(0, 1e-3)))
        if i not in skip:
            at = START + timedelta(minutes=15 * i)
            rows.append(("A", at, at + timedelta(minutes=15), float(o * scale), float(hi * scale), float(lo * scale), float(close[i] * scale), float(rng.integers(0, 50))))
    return rows


def registry(spark, rows):
    return op.weekly_registry(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()


def test_one_window_by_direct_formulas(spark):
    rows = bars()
    (got,) = registry(spark, rows)
    assert got.anchor_at == START + timedelta(days=7)
    for name, k in (("4h", 16), ("1d", 96), ("7d", 672)):
        own = rows[-k:]
        path = np.array([own[0][3], *(r[6] for r in own)])
        r, x, steps = np.log(path[1:] / path[:-1]), path[1:] / path[:-1] - 1, np.diff(path)
        assert got[f"return_{name}"] == pytest.approx(path[-1] / path[0] - 1)
        assert got[f"rv_{name}"] == pytest.approx(r.std())
        if k > 16:
            assert got[f"directional_efficiency_{name}"] == pytest.approx(abs(path[-1] - path[0]) / abs(steps).sum())
            assert got[f"sign_change_rate_{name}"] == pytest.approx((x[:-1] * x[1:] < 0).sum() / ((x[:-1] != 0) & (x[1:] != 0)).sum())
            assert got[f"return_autocorr_{name}"] == pytest.approx(np.corrcoef(x[:-1], x[1:])[0, 1])
    peak, trough = np.maximum.accumulate(path), np.minimum.accumulate(path)
    assert got.max_drawdown_7d == pytest.approx((path / peak - 1).min()) and got.max_runup_7d == pytest.approx((path / trough - 1).max())
    hours = [rows[i : i + 4] for i in range(0, 672, 4)]
    volume = np.array([sum(r[7] for r in h) for h in hours])
    assert got.top_decile_volume_share_7d == pytest.approx(np.sort(volume)[::-1][:17].sum() / volume.sum())
    hi, lo, close = (np.array(v) for v in zip(*((max(r[4] for r in h), min(r[5] for r in h), h[-1][6]) for h in hours), strict=True))
    before = np.array([hours[0][0][3], *close[:-1]])
    tr = np.maximum(hi - lo, np.maximum(abs(hi - before), abs(lo - before)))
    assert got.atr_ratio_7d == pytest.approx(tr.mean() / close[-1]) and got.atr_ratio_1d == pytest.approx(tr[-24:].mean() / close[-1])
    broke = [close[i] > hi[i - 24 : i].max() or close[i] < lo[i - 24 : i].min() for i in range(24, 168)]
    assert got.breakout_rate_7d == pytest.approx(np.mean(broke))


def test_features_do_not_depend_on_the_scale_of_prices(spark):
    (one,), (other,) = registry(spark, bars()), registry(spark, bars(scale=250.0))
    for name in op.NAMES:
        assert other[name] == pytest.approx(one[name], rel=1e-9, abs=1e-12)


def test_gaps_and_flat_prices_have_no_row(spark):
    assert len(registry(spark, bars(688))) == 2
    assert registry(spark, bars(688, skip={300})) == []
    flat = [(s, at, end, 5.0, 5.0, 5.0, 5.0, 1.0) for s, at, end, *_ in bars()]
    assert registry(spark, flat) == [] and registry(spark, []) == []
