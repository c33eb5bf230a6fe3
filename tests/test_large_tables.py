"""What only shows on larger tables, on small ones made alike."""

import os

import numpy as np
import pytest
from oracle import TABLES, compare, connect
from pyspark.sql import functions as F

from tickloom.operators import bootstrap, indicators, performance
from tickloom.plans import catalog, history, registry
from tickloom.sources import adapters

FOLDER = "/root/testdata/sf0.001"


def changed(folder, **tables):
    """A copy of the smallest tables in which some are replaced by a SELECT (old rows: the view of that name)."""
    con = connect(FOLDER)
    for t in TABLES:
        if t in tables:
            con.execute(f"COPY ({tables[t]}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(f"{FOLDER}/{t}.parquet", f"{folder}/{t}.parquet")
    con.close()
    return str(folder)


@pytest.mark.parametrize("name", ["a23_train_score", "a8_a10_tail_stats", "l1_rank", "p8_rejection_reasons"])
def test_months_that_lose_more_than_all(spark, tmp_path, name):
    folder = changed(tmp_path, lineitem="SELECT * REPLACE (l_extendedprice * 500 AS l_extendedprice) FROM lineitem")
    assert performance.monthly(adapters.ledger(spark, folder)).where("return_ratio < -1").count()
    compare(catalog.QUERIES[name](spark, folder), connect(folder), catalog.SQL[name])


def test_compounding_ends_with_a_total_loss(spark):
    rows = spark.createDataFrame([("a", 0.5), ("a", -1.5), ("a", -2.0), ("b", 0.5), ("b", -0.5), ("c", -1.0), ("c", 3.0)], "k string, v double")
    got = {r.k: r.c for r in rows.groupBy("k").agg(performance.compounded(F.col("v")).alias("c")).collect()}
    assert got == {"a": -1.0, "b": pytest.approx(-0.25), "c": -1.0}


def test_flat_windows_late_in_a_series_have_no_direction(spark):
    ends = [0.1 * (i % 50 + 1) for i in range(25)]
    closes = [100.1 + v for v in ends + ends[::-1]] * 40  # the same fifty values, mirrored: slope 0 at each fiftieth row
    rows = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(closes)], "symbol string, n int, high double").selectExpr("symbol", "timestamp_seconds(n * 3600) AS opened_at", "n", "high", "high - 1 AS low", "high AS close")
    got = {r.n: r for r in indicators.slope(rows).collect()}
    assert {got[n].direction for n in range(50, len(closes) + 1, 50)} == {0}
    assert {got[n].direction for n in range(60, len(closes) + 1, 50)} == {got[60].direction}
    assert got[49].slope_high is None and got[50].slope_high is not None


@pytest.mark.parametrize("name", ["c9_mapping", "l8_weekly_ranks", "c7_weekly_bounds"])
def test_trades_are_read_once_for_all_weekly_figures(spark, name, monkeypatch):
    made, table = [], bootstrap.written

    def kept(df):
        made.append("lineitem" in "".join(df.inputFiles()))
        return table(df)

    monkeypatch.setattr(bootstrap, "written", kept)
    df = catalog.QUERIES[name](spark, FOLDER)
    assert sum(made) == 1 and not any("lineitem" in f for f in df.inputFiles())


def test_orders_of_candidates_are_told_apart_in_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(history, "TASK_ROWS", 500)
    df = registry.QUERIES["q4_trade_lookups"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "REPARTITION_BY_NUM" in plan
    assert compare(df, connect(FOLDER), registry.SQL["q4_trade_lookups"])


def test_stability_of_fewer_than_two_refits_has_no_rows(spark):
    from tickloom.operators import fits

    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 11)]) for i in range(60)], "vec_id long, x array<double>")
    one = [f for f in fits.fit_all(rows, [fits.Fit("kmeans", "", 3, 0)]) if f.status == "converged"]
    for refits in ([], one):
        got = fits.seed_stability(rows, refits, "vec_id")
        assert got.columns == ["a", "b", "ari", "nmi", "centroid_distance"] and got.count() == 0


def test_kmeans_ends_when_its_centres_hardly_move(spark):
    from tickloom.operators import fits

    rng = np.random.default_rng(3)
    x = rng.random((3000, 8))  # no clusters: the last rows change sides for very long
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, x array<double>")
    done = fits.fit_all(rows, [fits.Fit("kmeans", "", 6, s) for s in range(2)])
    near = np.array([r.x for r in rows.select("x").orderBy(F.xxhash64("x"), "x").collect()])
    for fit in done:
        means, moved, turns = fits.seeds(near, 6, fit.start), np.inf, 0
        while moved > fits.SHIFT * x.var(0).mean():
            labels, turns, old = fits.squared_distances(x, means).argmin(1), turns + 1, means
            means = np.array([x[labels == c].mean(0) for c in range(6)])
            moved = ((means - old) ** 2).sum()
        assert fit.status == "converged" and fit.rounds == turns + 1
        np.testing.assert_allclose(fit.means, means, atol=1e-9)
        labels = fits.squared_distances(x, means).argmin(1)
        assert fit.score == pytest.approx(-((x - means[labels]) ** 2).sum(1).mean())
