import hashlib
import random

from tickloom.llm import mixing as op


def fill(budget, nodes):
    """Water-filling by rounds; nodes: name -> (weight, cap)."""
    given = dict.fromkeys(nodes, 0.0)
    while budget > 1e-9 and (free := [k for k, (w, c) in nodes.items() if w > 0 and given[k] < c - 1e-9]):
        total = sum(nodes[k][0] for k in free)
        step = min([budget / total, *((nodes[k][1] - given[k]) / nodes[k][0] for k in free)])
        for k in free:
            given[k] += step * nodes[k][0]
        budget -= step * total
    return given


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, "w " * (0 if i % 17 == 0 else rng.randrange(1, 40)), rng.choice(["en", "de", None]), rng.choice(["src0"] * 5 + ["src1", "src2", "x", None]), 1) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens int")
    got = op.mix(op.with_tree(df), op.LEVELS, op.WEIGHTS, share=1.3, max_epochs=2, seed=17).collect()
    assert len(got) == 400
    tokens, leaves = {}, {}
    for r in got:
        leaves[(r.domain, r.lang, r.source)] = leaves.get((r.domain, r.lang, r.source), 0) + r.n_tokens
    total = sum(leaves.values())
    cap = lambda k: 2 * sum(v for p, v in leaves.items() if p[: len(k)] == k)
    budget = {(): float(int(1.3 * total))}
    for depth, level in enumerate(op.LEVELS):
        for parent in [p for p in budget if len(p) == depth]:
            names = {p[: depth + 1] for p in leaves if p[:depth] == parent}
            budget |= fill(budget[parent], {n: (op.WEIGHTS.get(level, {}).get(n[-1], 1.0), cap(n)) for n in names})
    for leaf, n in leaves.items():
        given = budget[leaf]
        full, rest = divmod(int(given + 1e-6), n) if n else (0, 0)
        own = [r for r in got if (r.domain, r.lang, r.source) == leaf and r.n_tokens]
        assert abs(own[0].leaf_budget - given) <= 1 if own else True
        upto = 0
        for r in sorted(own, key=lambda r: hashlib.md5(f"17:{full}:{r.doc_id}".encode()).hexdigest()):
            upto += r.n_tokens
            assert r.copies == full + (upto <= rest), (leaf, r)
    assert all(r.copies == 0 for r in got if r.n_tokens == 0)


def test_stage_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "a b c", "en", f"src{i % 3}", 5) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    out = op.mixed_rows(df, 0.5)
    assert out.columns == df.columns and 20 <= out.count() <= 30
    assert op.mixed_rows(df.limit(0), 0.5).count() == 0
    assert op.mix(op.with_tree(df.limit(0)), op.LEVELS, op.WEIGHTS).count() == 0


def test_stage_with_clashing_columns_and_nulls(spark):
    rows = [(i if i % 7 else None, "a b c" if i % 5 else None, "en", f"src{i % 3}", 77, i, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, full int, rest string")
    out = op.mixed_rows(df, 1.0)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == 48 and {r.n_tokens for r in got} == {77} and {r.rest for r in got} == {"x"}
    assert {r.full for r in got} == {r[5] for r in rows if r[1]}
    assert len(op.mix(op.with_tree(df), op.LEVELS, op.WEIGHTS).collect()) == 60
