import numpy as np
import pytest

from tickloom.llm import embedding_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int, x string, h1 long, block int"


def by_hand(rows, threshold):
    good = []
    for k, (v, x, label) in enumerate(rows):
        if v is None or label is None or x is None or not len(x) or any(c is None or not np.isfinite(c) for c in x) or not any(x):
            continue
        good.append((k, v, np.array(x, np.float32).astype(float), label))
    near = {k: [] for k in range(len(rows))}
    for k, _, x, label in good:
        for m, _, y, other in good:
            if k != m and label == other and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                near[k].append(m)
    out = []
    for k, (v, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            new = [m for m in near[todo.pop()] if m not in seen]
            seen.update(new)
            todo += new
        low = None if v is None else min(rows[m][0] for m in seen)
        out.append((v, len(near[k]), low, v == low))
    return sorted(out, key=str)


def run(spark, rows, threshold=0.98):
    df = spark.createDataFrame([(v, x, label, "clash", 1, 2) for v, x, label in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in op.near_embeddings(df, threshold).collect()), key=str)


def cloud(seed, n, dims, centres, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    return (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def test_against_brute_force_with_chains_copies_and_many_blocks(spark):
    x = cloud(1, 1500, 16, 60, 0.16)
    rows = [(k * 7 % 1501, x[k].tolist(), k % 2) for k in range(1500)]
    rows += [(2000 + k, x[5].tolist(), 1) for k in range(40)] + [(3000 + k, (x[5] * 3).tolist(), 1) for k in range(3)]
    want = by_hand(rows, 0.98)
    assert run(spark, rows) == want
    assert sum(r[1] > 0 for r in want) > 500 and len({r[2] for r in want}) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0, 2.0, 3.0]
    rows = [
        (1, good, 1), (2, good, 1), (2, good, 1), (3, good, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, -0.0], 1), (7, [1.0, None, 3.0], 1),
        (8, [nan, 2.0, 3.0], 1), (9, [inf, 2.0, 3.0], 1), (None, good, 1), (10, [1.0, 2.0], 1), (11, [1e-40, 2e-40, 3e-40], 1), (12, [1e38, 2e38, 3e38], 1),
        (13, [-1.0, -2.0, -3.0], 1), (14, good, 2), (2, [3.0, 1.0, -1.0], 1), (15, [3.0, 1.0, -1.0], 1), (16, [0.0, 0.0, 5.0], 3), (17, [-0.0, 0.0, 1.0], 3),
    ]
    assert run(spark, rows) == by_hand(rows, 0.98)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_hot_label_of_near_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=64) + 0.01 * rng.normal(size=(700, 64))
    rows = [(k, v.tolist(), 4) for k, v in enumerate(x.astype(np.float32))]
    assert run(spark, rows) == sorted(((k, 699, 0, k == 0) for k in range(700)), key=str)


@pytest.mark.parametrize("dims", [3, 64, 1500])
def test_bounds_hold_and_leave_few_pairs(dims):
    x = np.concatenate([cloud(7, 900, dims, 300, 0.15), cloud(8, 300, dims, 2, 1e-3)])
    a, b = op.Side(x[:700]), op.Side(x[500:])
    exact = (a.x / a.norm[:, None]) @ (b.x / b.norm[:, None]).T
    rough = (a.q.astype(float) * a.scale[:, None]) @ (b.q.astype(float) * b.scale[:, None]).T
    assert (np.abs(exact - rough) <= a.error[:, None] + np.outer(a.length, b.error) + 1e-12).all()
    kept = {(int(r), int(c)) for rs, cs in op.possible(a, b, 0.98, False) for r, c in zip(rs, cs, strict=True)}
    sure = set(zip(*(v.tolist() for v in np.nonzero(exact >= 0.98)), strict=True))
    assert sure <= kept
    assert len(kept) <= (exact >= 0.94).sum()
