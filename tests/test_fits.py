"""Distributed fits against plain loops on one machine."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tickloom.operators import fits as op


def cloud(seed=1, n=400, d=4, k=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (k, d))
    mix = rng.normal(size=(d, d)) * 0.5 + np.eye(d)
    return np.array([centres[i % k] + rng.normal(size=d) @ mix for i in range(n)])


def frame(spark, x):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(9001, None), (9002, []), (9003, [1.0, None, 2.0, 3.0]), (9004, [1.0, float("nan"), 2.0, 3.0])]
    return spark.createDataFrame(rows, "id long, x array<double>").repartition(5)


def density(x, mean, cov):
    d = len(mean)
    diff = x - mean
    return math.exp(-0.5 * diff @ np.linalg.inv(cov) @ diff) / math.sqrt((2 * math.pi) ** d * np.linalg.det(cov))


def em_by_hand(x, start, covariance, tolerance, rounds=100):
    """Textbook EM, a row at a time, from hard assignments to the start's points."""
    n, d, k = len(x), x.shape[1], len(start)
    r = np.zeros((n, k))
    for i, v in enumerate(x):
        r[i, min(range(k), key=lambda c: ((v - start[c]) ** 2).sum())] = 1
    before = None
    for turn in range(rounds + 1):
        w = r.sum(0)
        means = np.array([(r[:, c, None] * x).sum(0) / w[c] for c in range(k)])
        own = [sum(r[i, c] * np.outer(x[i] - means[c], x[i] - means[c]) for i in range(n)) for c in range(k)]
        if covariance == "diag":
            covs = [np.diag(np.diag(o) / w[c] + op.FLOOR) for c, o in enumerate(own)]
        else:
            covs = [sum(own) / n + op.FLOOR * np.eye(d)] * k
        p = np.array([[w[c] / n * density(v, means[c], covs[c]) for c in range(k)] for v in x])
        score = float(np.log(p.sum(1)).mean())
        if before is not None and abs(score - before) <= tolerance:
            return means, w / n, covs, score, turn + 1
        before, r = score, p / p.sum(1, keepdims=True)
    return None


@pytest.mark.parametrize("covariance", ["diag", "tied"])
def test_mixtures_against_plain_em(spark, covariance):
    x = cloud()
    fits = op.grid([("gmm", covariance)], [3, 4], starts=2)
    op.fit_all(frame(spark, x), fits)
    near = np.array(sorted(map(tuple, x)))
    for fit in fits:
        assert fit.status == "converged" and fit.n == len(x)
        start = op.seeds(sample_of(spark, x), fit.k, fit.start)
        means, weights, covs, score, turns = em_by_hand(x, start, covariance, op.TOLERANCE)
        assert fit.rounds == turns and score == pytest.approx(fit.score, abs=1e-9)
        np.testing.assert_allclose(fit.means, means, atol=1e-8)
        np.testing.assert_allclose(fit.weights, weights, atol=1e-9)
        got = fit.spread if covariance == "tied" else fit.spread[0]
        np.testing.assert_allclose(got, covs[0] if covariance == "tied" else np.diag(covs[0]), atol=1e-8)
        free = fit.k - 1 + fit.k * 4 + (10 if covariance == "tied" else 4 * fit.k)
        assert fit.bic() == pytest.approx(-2 * score * len(x) + free * math.log(len(x)))
    assert len(near) == len(x)


def sample_of(spark, x):
    from pyspark.sql import functions as F

    rows = op.feature_rows(frame(spark, x)).select("x").orderBy(F.xxhash64("x"), "x").limit(op.SAMPLE)
    return np.array([r.x for r in rows.collect()])


def test_kmeans_is_a_fixed_point_and_best_start_is_taken(spark):
    x = cloud(4)
    fits = op.fit_all(frame(spark, x), op.grid([("kmeans", "")], [4], starts=5))
    best = op.best_starts(fits)
    assert len(best) == 1 and best[0].score == max(f.score for f in fits if f.status == "converged")
    for fit in fits:
        labels = op.squared_distances(x, fit.means).argmin(1)
        again = np.array([x[labels == c].mean(0) for c in range(4)])
        np.testing.assert_allclose(again, fit.means, atol=1e-9)
        assert fit.score == pytest.approx(-((x - fit.means[labels]) ** 2).sum(1).mean())


def test_failures_are_rejected_rows(spark):
    same = frame(spark, np.tile([[1.0, 2.0, 3.0, 4.0]], (30, 1)))
    fits = op.fit_all(same, op.grid(clusters=[3], starts=2))
    assert {(f.status, f.reason) for f in fits} == {("rejected", "a component has no rows")}
    few = op.fit_all(frame(spark, cloud(n=2)), op.grid(clusters=[3], starts=1))
    assert {f.reason for f in few} == {"fewer rows than components"}
    short = op.fit_all(frame(spark, cloud(8)), op.grid([("gmm", "diag")], [5], 1), tolerance=0.0, rounds=2)
    assert short[0].reason == "not converged"
    table = op.model_table(same, fits).collect()
    assert len(table) == 6 and all(r.status == "rejected" and r.bic is None and r.silhouette is None for r in table)
    assert op.fit_all(same.limit(0), op.grid(clusters=[3], starts=1))[0].status == "rejected"


def test_stability_against_pair_counts(spark):
    x = cloud(6, n=150, k=3)
    df = frame(spark, x)
    refits = op.fit_all(df, op.grid([("kmeans", "")], [4], starts=3))
    got = {(r.a, r.b): r for r in op.seed_stability(df, refits, "id").collect()}
    labels = [op.squared_distances(x, f.means).argmin(1) for f in refits]
    for a, b in combinations(range(3), 2):
        la, lb = labels[a], labels[b]
        n = len(x)
        together = [(la[i] == la[j], lb[i] == lb[j]) for i, j in combinations(range(n), 2)]
        both, pa, pb = sum(p and q for p, q in together), sum(p for p, _ in together), sum(q for _, q in together)
        expected, most = pa * pb / len(together), (pa + pb) / 2
        assert got[a, b].ari == pytest.approx((both - expected) / (most - expected) if most != expected else 1.0)
        h = lambda c: -sum(v / n * math.log(v / n) for v in Counter(c).values())
        joint = h(zip(la.tolist(), lb.tolist(), strict=True))
        assert got[a, b].nmi == pytest.approx(2 * (h(la.tolist()) + h(lb.tolist()) - joint) / (h(la.tolist()) + h(lb.tolist())))
        d = np.linalg.norm(refits[a].means[:, None] - refits[b].means[None], axis=2)
        assert got[a, b].centroid_distance == pytest.approx(max(d.min(0).max(), d.min(1).max()))


def test_silhouette_by_hand(spark):
    x = cloud(9, n=90, k=3)
    df = frame(spark, x)
    fits = op.fit_all(df, op.grid([("kmeans", ""), ("gmm", "diag")], [3], starts=1))
    rows = {r.family: r for r in op.model_table(df, fits).collect()}
    d = np.sort(np.sqrt(op.squared_distances(x, fits[0].means)), axis=1)
    assert rows["kmeans"].silhouette == pytest.approx(((d[:, 1] - d[:, 0]) / d[:, 1]).mean())
    assert rows["gmm"].silhouette is None and rows["gmm"].bic == pytest.approx(fits[1].bic())
