"""Block-wise recursive means against pandas."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tickloom.operators.recursive import smooth

SPECS = {"fast": ("close", 2 / 13, 12), "slow": ("close", 1 / 14, 1), "other": ("x", 0.5, 3), "whole": ("close", 1.0, 2)}


def table(seed, n, gap_hours):
    rng = np.random.default_rng(seed)
    rows, at = [], datetime(2023, 12, 28)
    for _ in range(n):
        at += timedelta(hours=int(rng.integers(1, gap_hours)))
        rows.append(("s" + str(int(rng.integers(0, 3))), at, float(rng.normal(50, 5)), None if rng.random() < 0.3 else float(rng.normal())))
    return rows


@pytest.mark.parametrize(("seed", "gap"), [(1, 3), (2, 40), (3, 700)])
def test_equals_pandas(spark, seed, gap):
    rows = table(seed, 400, gap) + [("lone", datetime(2024, 5, 1), 7.0, None)]
    df = spark.createDataFrame(rows, "symbol string, opened_at timestamp, close double, x double").repartition(4)
    got = smooth(df, SPECS).toPandas().sort_values(["symbol", "opened_at"]).reset_index(drop=True)
    want = pd.DataFrame(rows, columns=["symbol", "opened_at", "close", "x"]).sort_values(["symbol", "opened_at"]).reset_index(drop=True)
    for name, (column, alpha, least) in SPECS.items():
        want[name] = want.groupby("symbol")[column].transform(lambda s, a=alpha, m=least: s.astype(float).ewm(alpha=a, adjust=False, min_periods=m, ignore_na=True).mean())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in ["close", "x", *SPECS]:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), rtol=1e-12, atol=1e-12)


def test_no_python_and_no_task_of_a_whole_symbol(spark):
    df = spark.createDataFrame(table(4, 50, 5), "symbol string, opened_at timestamp, close double, x double")
    plan = smooth(df, SPECS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert smooth(df.limit(0), SPECS).count() == 0
