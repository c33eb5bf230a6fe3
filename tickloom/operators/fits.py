"""Many clustering fits in one distributed loop: k-means and Gaussian mixtures with diagonal or tied covariance.

A fit is a setting (family, covariance, k) with one start. In each round every task goes once over its rows
and adds up, for all fits that still run, what their next step needs: the weight and the weighted sum of
rows of each component, for diagonal ones of squares too, and the score. A row a fit and task is then
summed by fit. The parameters (fits x k x d numbers, whatever the table) are computed from the sums and sent to
the next round. A tied covariance is the scatter of all rows less that of the means, so one d x d sum, taken in
the first round, serves all rounds, and its Cholesky factor turns distances into plain ones.

A mixture ends when its mean log likelihood changes by less than the tolerance, k-means when its centres move by no more than
``SHIFT`` of the features' mean variance (summed squares), the rule of the older engine's fits: rows that still change sides then
number few, and waiting for the last of them takes the more rounds the more rows there are. As there, k-means is taken as it stands after
three times the rounds of a mixture. A mixture that does not end within the rounds, or a fit that loses a component, is rejected
with the reason; of the starts of a setting the converged one with the best score is taken.

Fits of one form and k are computed together: their log densities (k-means: distances) are one matrix product of the rows with
stacked coefficients. Under a tied covariance the part that is quadratic in the row is the same for all components, and
its sum over the rows comes from the scatter. Rows are dealt over the tasks once and kept there for all rounds.

Starts are k-means++ on a bounded sample of rows (those with the smallest hash), seeded by start and k. Rows with
null or non-finite features take no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4096
SEED = 20260714
#: What the older engine's fits use.
FLOOR, TOLERANCE, SHIFT, ROUNDS, STARTS, CLUSTERS = 1e-6, 1e-3, 1e-4, 100, 20, range(3, 9)
#: Rows that a task computes with at a time, and the least rows that make a task of their own.
CHUNK, TASK_ROWS = 512, 1000
SUMS = "fit int, n double, score double, w binary, s binary, q binary"


@dataclass
class Fit:
    family: str
    covariance: str
    k: int
    start: int
    means: np.ndarray | None = None
    weights: np.ndarray | None = None
    spread: np.ndarray | None = None  # variances (k x d) or the tied covariance (d x d)
    factor: np.ndarray | None = None  # of the tied precision: distances are plain ones after x @ factor
    score: float = -np.inf  # mean log likelihood, or the negative mean squared distance
    n: int = 0
    rounds: int = 0
    settled: bool = False  # the centres hardly move any more: one more round scores them
    status: str = "running"
    reason: str = ""
    history: list[float] = field(default_factory=list)

    def reject(self, reason: str) -> None:
        self.status, self.reason = "rejected", reason

    def parameters(self) -> float:
        d, shared = self.means.shape[1], self.k - 1 + self.means.size
        return shared + (d * (d + 1) / 2 if self.covariance == "tied" else self.k * d)

    def bic(self) -> float:
        return -2 * self.score * self.n + self.parameters() * np.log(self.n)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)
    return np.maximum(d2, 0)


def log_densities(fit: Fit, x: np.ndarray) -> np.ndarray:
    """Rows x components: log of weight times density."""
    if fit.covariance == "tied":
        d2 = squared_distances(x @ fit.factor, fit.means @ fit.factor)
        log_det = -2 * np.log(np.abs(np.diag(fit.factor))).sum()
    else:
        p = 1 / fit.spread
        d2 = np.maximum((x * x) @ p.T - 2 * (x @ (fit.means * p).T) + (fit.means**2 * p).sum(1), 0)
        log_det = np.log(fit.spread).sum(1)
    return np.log(fit.weights) - (x.shape[1] * np.log(2 * np.pi) + log_det + d2) / 2


def shares(fit: Fit, x: np.ndarray) -> tuple[np.ndarray, float]:
    """(responsibilities of the components, score of the rows); hard ones for k-means and for a start."""
    if fit.family == "kmeans" or fit.spread is None:
        d2 = squared_distances(x, fit.means)
        out = np.zeros_like(d2)
        out[np.arange(len(x)), d2.argmin(1)] = 1
        return out, -float(d2.min(1).sum())
    lp = log_densities(fit, x)
    top = lp.max(1, keepdims=True)
    e = np.exp(lp - top)
    total = e.sum(1, keepdims=True)
    return e / total, float((top + np.log(total)).sum())


def matrices(frames: Iterable[pd.DataFrame], column: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, their features as a matrix) of a batch."""
    for f in frames:
        if len(f):
            yield f, np.stack(f[column].to_numpy()).astype(np.float64)


@dataclass
class Stack:
    """Fits of one form and k: rows of the matrices are component by component, fit by fit."""

    numbers: list[int]
    k: int
    hard: bool
    squares: bool
    linear: np.ndarray
    constant: np.ndarray
    quadratic: np.ndarray | None

    def sums(self, x: np.ndarray, x2: np.ndarray) -> list[tuple]:
        """(number, n, score, w, s, q) of each fit; a tied fit's score lacks what the scatter gives."""
        z = self.linear @ x.T + self.constant[:, None]
        if self.quadratic is not None:
            z += self.quadratic @ x2.T
        z = z.reshape(self.k, len(self.numbers), len(x))
        if self.hard:
            score = np.minimum(z.max(0) - x2.sum(1), 0).sum(1)
            r = (z.argmax(0) == np.arange(self.k)[:, None, None]).astype(np.float64)
        else:
            top = z.max(0)
            r = np.exp(np.subtract(z, top, out=z), out=z)
            total = r.sum(0)
            score = (top + np.log(total)).sum(1)
            r /= total
        flat = r.reshape(-1, len(x))
        shape = (self.k, len(self.numbers), -1)
        w, s = r.sum(2), (flat @ x).reshape(shape)
        q = (flat @ x2).reshape(shape) if self.squares else None
        return [(number, len(x), float(score[i]), w[:, i], s[:, i], q[:, i] if self.squares else np.empty(0)) for i, number in enumerate(self.numbers)]


def stacks(live: list[tuple[int, Fit]]) -> list[Stack]:
    groups: dict[tuple, list[tuple[int, Fit]]] = {}
    for number, fit in live:
        groups.setdefault((fit.family == "kmeans" or fit.spread is None, fit.covariance, fit.k), []).append((number, fit))
    out = []
    for (hard, covariance, k), own in groups.items():
        quadratic, linear, constant = [], [], []
        for _, fit in own:
            m = fit.means
            if hard:
                linear.append(2 * m)
                constant.append(-(m * m).sum(1))
                continue
            base = np.log(fit.weights) - m.shape[1] * np.log(2 * np.pi) / 2
            if covariance == "tied":
                moved = m @ fit.factor
                linear.append(moved @ fit.factor.T)
                constant.append(base - (moved * moved).sum(1) / 2 + np.log(np.abs(np.diag(fit.factor))).sum())
            else:
                p = 1 / fit.spread
                linear.append(m * p)
                quadratic.append(-p / 2)
                constant.append(base - ((m * m * p).sum(1) + np.log(fit.spread).sum(1)) / 2)
        by_component = lambda parts: np.concatenate(np.stack(parts, axis=1))
        out.append(Stack([n for n, _ in own], k, hard, covariance == "diag", by_component(linear), by_component(constant), by_component(quadratic) if quadratic else None))
    return out


def _pass(held, first: bool):
    def run(batches):
        together, sums, scatter = stacks(held.value), {}, None
        for batch in batches:
            lists = batch.column(0)
            if not len(lists):
                continue
            widths = np.diff(lists.offsets.to_numpy())
            if (widths != widths[0]).any():
                raise ValueError("rows have different numbers of features")
            rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            for at in range(0, len(rows), CHUNK):
                x = rows[at : at + CHUNK]
                x2 = x * x
                for stack in together:
                    for number, *part in stack.sums(x, x2):
                        sums[number] = [a + b for a, b in zip(sums[number], part, strict=True)] if number in sums else part
                if first:
                    scatter = x.T @ x if scatter is None else scatter + x.T @ x
        if scatter is not None:
            sums[-1] = [0, 0.0, np.empty(0), scatter, np.empty(0)]
        rows = [(k, float(n), float(score), *(a.astype("<f8").tobytes() for a in arrays)) for k, (n, score, *arrays) in sums.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SUMS.split(", ")])

    return run


def _summed(part: pd.DataFrame) -> pd.DataFrame:
    """The rows of a fit, one a task, as one."""
    out = {"fit": part["fit"].iloc[:1], "n": part["n"].sum(), "score": part["score"].sum()}
    for c in "wsq":
        out[c] = [np.sum([np.frombuffer(v, "<f8") for v in part[c]], axis=0).tobytes()]
    return pd.DataFrame(out)


def step(fit: Fit, n: float, score: float, w: np.ndarray, s: np.ndarray, q: np.ndarray, scatter: np.ndarray, tolerance: float) -> None:
    """The next parameters of a fit from its sums, or its end."""
    started = bool(fit.history) or fit.family == "kmeans"
    if fit.covariance == "tied" and fit.factor is not None:
        score -= ((fit.factor.T @ scatter) * fit.factor.T).sum() / 2  # the rows' own quadratic part
    before, fit.n = fit.score, int(n)
    if started:
        fit.score = score / n
        fit.history.append(fit.score)
        fit.rounds += 1
        if fit.settled or (fit.family == "gmm" and fit.rounds > 1 and abs(fit.score - before) <= tolerance):
            fit.status = "converged"
            return
    else:
        fit.history.append(-np.inf)
    if not np.isfinite(score) or (w <= 1e-9 * n).any():
        fit.reject("a component has no rows")
        return
    d = len(s) // fit.k
    old, fit.means, fit.weights = fit.means, s.reshape(fit.k, d) / w[:, None], w / w.sum()
    if fit.family == "kmeans":
        variance = max(0.0, np.trace(scatter) / n - ((s.reshape(fit.k, d).sum(0) / n) ** 2).sum()) / d
        fit.settled = bool(((fit.means - old) ** 2).sum() <= SHIFT * variance)
    if fit.covariance == "diag":
        fit.spread = np.maximum(q.reshape(fit.k, d) / w[:, None] - fit.means**2, 0) + FLOOR
    elif fit.covariance == "tied":
        fit.spread = (scatter - (fit.means.T * w) @ fit.means) / n + FLOOR * np.eye(d)
        try:
            lower = np.linalg.cholesky((fit.spread + fit.spread.T) / 2)
        except np.linalg.LinAlgError:
            fit.reject("the tied covariance is not positive")
            return
        fit.factor = np.linalg.solve(lower, np.eye(d)).T


def seeds(sample: np.ndarray, k: int, start: int) -> np.ndarray:
    """k rows by k-means++."""
    rng = np.random.default_rng([SEED, k, start])
    out = [sample[rng.integers(len(sample))]]
    far = ((sample - out[0]) ** 2).sum(1)
    for _ in range(k - 1):
        total = far.sum()
        out.append(sample[rng.choice(len(sample), p=far / total) if total > 0 else rng.integers(len(sample))])
        far = np.minimum(far, ((sample - out[-1]) ** 2).sum(1))
    return np.array(out)


def feature_rows(rows: DataFrame, features: str = "x") -> DataFrame:
    """``rows`` with ``x`` as doubles, without those whose features are null, empty or not finite."""
    x = F.col(features).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.withColumn("x", x).where(x.isNotNull() & (F.size(x) > 0) & ~bad)


def grid(kinds: Iterable[tuple[str, str]] = (("kmeans", ""), ("gmm", "diag"), ("gmm", "tied")), clusters: Iterable[int] = CLUSTERS, starts: int = STARTS) -> list[Fit]:
    return [Fit(family, covariance, k, start) for family, covariance in kinds for k in clusters for start in range(starts)]


def fit_all(rows: DataFrame, fits: list[Fit], features: str = "x", tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> list[Fit]:
    """``fits`` with their parameters; all of them together take one pass over the rows a round."""
    spark, rows = rows.sparkSession, feature_rows(rows, features).select("x")
    n = rows.count()
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, n // TASK_ROWS))
    rows = rows.repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)
    near = rows.where(F.pmod(F.xxhash64("x"), F.lit(1 << 40)) < (1 << 40) * min(1.0, 2 * SAMPLE / max(n, 1))).orderBy(F.xxhash64("x"), "x").limit(SAMPLE)
    sample = np.array([r.x for r in near.collect()])
    for fit in fits:
        fit.status, fit.reason, fit.history, fit.rounds, fit.score, fit.settled = "running", "", [], 0, -np.inf, False
        fit.factor = None
        if n < fit.k:
            fit.reject("fewer rows than components")
        else:
            fit.means, fit.spread = seeds(sample, fit.k, fit.start), None
    scatter = None
    while live := [(i, fit) for i, fit in enumerate(fits) if fit.status == "running"]:
        held = spark.sparkContext.broadcast(live)
        parts = rows.mapInArrow(_pass(held, scatter is None), SUMS)
        for r in parts.groupBy("fit").applyInPandas(_summed, SUMS).collect():  # a row a fit
            w, s, q = (np.frombuffer(v, "<f8") for v in (r.w, r.s, r.q))
            if r.fit < 0:
                scatter = s.reshape(sample.shape[1], sample.shape[1])
            else:
                fits[r.fit].sums = (r.n, r.score, w, s, q)
        held.unpersist()
        for _, fit in live:
            step(fit, *fit.__dict__.pop("sums"), scatter, tolerance)
            if fit.status == "running" and fit.family == "kmeans":
                fit.settled |= fit.rounds >= 3 * rounds - 1
            elif fit.status == "running" and fit.rounds >= rounds:
                fit.reject("not converged")
    rows.unpersist()
    return fits


def best_starts(fits: Iterable[Fit]) -> list[Fit]:
    """Of each setting the converged start with the best score; a rejected one where none converged."""
    out: dict[tuple, Fit] = {}
    for fit in fits:
        key = (fit.family, fit.covariance, fit.k)
        better = (fit.status == "converged", fit.score if fit.status == "converged" else 0.0, -fit.start)
        if key not in out or better > (out[key].status == "converged", out[key].score if out[key].status == "converged" else 0.0, -out[key].start):
            out[key] = fit
    return list(out.values())


def assigned(rows: DataFrame, fits: list[Fit], keep: list[str], features: str = "x") -> DataFrame:
    """``keep``, fit (its place in ``fits``), component, p, second_p, distance, second_distance of every row and fit.

    p and second_p are null for k-means. Distances are plain ones to the means, the second to the nearest other mean.
    """
    held = rows.sparkSession.sparkContext.broadcast(fits)
    kinds = [f"{name} {dict(rows.dtypes)[name]}" for name in keep]

    def run(frames):
        for f, x in matrices(frames, "x"):
            for number, fit in enumerate(held.value):
                d = np.sqrt(squared_distances(x, fit.means))
                at = np.arange(len(x))
                if fit.family == "kmeans":
                    own, p, second = d.argmin(1), None, None
                else:
                    r, _ = shares(fit, x)
                    own = r.argmax(1)
                    p, second = r[at, own], np.partition(r, -2, axis=1)[:, -2] if fit.k > 1 else np.zeros(len(x))
                distance = d[at, own]
                d[at, own] = np.inf
                out = f[keep].copy()
                out["fit"], out["component"], out["p"], out["second_p"] = number, own, p, second
                out["distance"], out["second_distance"] = distance, d.min(1)
                yield out

    schema = ", ".join([*kinds, "fit int", "component int", "p double", "second_p double", "distance double", "second_distance double"])
    return feature_rows(rows, features).select(*keep, "x").mapInPandas(run, schema)


def model_table(rows: DataFrame, fits: list[Fit], features: str = "x") -> DataFrame:
    """family, covariance, k, start, status, reason, rounds, log_likelihood, parameters, bic, silhouette of every fit.

    The silhouette of k-means is the simplified one, from the distances to the own and the nearest other centre.
    """
    spark = rows.sparkSession
    number = lambda v: float(v) if v is not None and np.isfinite(v) else None
    table = []
    for i, f in enumerate(fits):
        good = f.status == "converged"
        mixture = good and f.family == "gmm"
        table.append((i, f.family, f.covariance, f.k, f.start, f.status, f.reason, f.rounds, number(f.score * f.n) if mixture else None, float(f.parameters()) if mixture else None, number(f.bic()) if mixture else None))
    models = spark.createDataFrame(table, "fit int, family string, covariance string, k int, start int, status string, reason string, rounds int, log_likelihood double, parameters double, bic double")
    centres = [f for f in fits if f.family == "kmeans" and f.status == "converged"]
    if not centres:
        return models.withColumn("silhouette", F.lit(None).cast("double"))
    places = F.array(*(F.lit(fits.index(f)) for f in centres))
    a, b = F.col("distance"), F.col("second_distance")
    width = F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)
    silhouettes = assigned(rows, centres, [], features).groupBy("fit").agg(F.avg(width).alias("silhouette")).select(places[F.col("fit")].alias("fit"), "silhouette")
    return models.join(silhouettes, "fit", "left")


def seed_stability(rows: DataFrame, refits: list[Fit], key: str, features: str = "x") -> DataFrame:
    """a, b, ari, nmi, centroid_distance of every pair of refits, from the contingency tables of all pairs in one aggregate.

    The distance of two refits is the largest from a mean of one to the nearest mean of the other.
    """
    spark = rows.sparkSession
    labels = assigned(rows, refits, [key], features).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("fit", "component"))).alias("l"))  # a few refits a row
    pairs = [(i, j) for i in range(len(refits)) for j in range(i + 1, len(refits))]
    if not pairs:  # fewer than two refits converged: nothing to compare
        return spark.createDataFrame([], "a int, b int, ari double, nmi double, centroid_distance double")
    options = F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col("l")[i]["component"].alias("la"), F.col("l")[j]["component"].alias("lb")) for i, j in pairs))
    cells = labels.select(F.explode(options).alias("c")).groupBy("c.a", "c.b", "c.la", "c.lb").agg(F.count(F.lit(1)).cast("double").alias("n"))
    two = lambda c: c * (c - 1) / 2
    sides = {s: cells.groupBy("a", "b", f"l{s}").agg(F.sum("n").alias("m")).groupBy("a", "b").agg(F.sum(two(F.col("m"))).alias(f"pairs_{s}"), F.sum(F.col("m") * F.log("m")).alias(f"ent_{s}")) for s in "ab"}
    whole = cells.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("both"), F.sum(F.col("n") * F.log("n")).alias("ent"))
    t = whole.join(sides["a"], ["a", "b"]).join(sides["b"], ["a", "b"])
    expected = F.col("pairs_a") * F.col("pairs_b") / two(F.col("n"))
    most = (F.col("pairs_a") + F.col("pairs_b")) / 2
    ha, hb, hab = (F.log("n") - F.col(c) / F.col("n") for c in ("ent_a", "ent_b", "ent"))
    ari = F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected))
    nmi = F.when(ha + hb == 0, 1.0).otherwise(2 * (ha + hb - hab) / (ha + hb))
    gaps = [(i, j, float(max(g.min(0).max(), g.min(1).max()))) for i, j in pairs for g in [np.sqrt(squared_distances(refits[i].means, refits[j].means))]]
    far = spark.createDataFrame(gaps, "a int, b int, centroid_distance double")
    return t.select("a", "b", ari.alias("ari"), nmi.alias("nmi")).join(F.broadcast(far), ["a", "b"])
