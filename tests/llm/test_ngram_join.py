import random
import re

import numpy as np
import pytest

from tickloom.llm import hashing
from tickloom.llm import ngram_join as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def set_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def by_hand(rows, k, num, den):
    sets = {d: set_of(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in sets)


def family_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    rows, d = [], 0
    common = [word() for _ in range(40)]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 30, 80, 150]))] + (common if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 4, 15])):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own = own[: -rng.randrange(1, 4)]
            rows.append((d, rng.choice([" ", "\n", "  "]).join(own) if rng.random() < 0.9 else " ".join(own).upper()))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \t"), (d + 3, "one"), (d + 4, "ONE"), (d + 5, "one two"), (d + 6, "x " * 30_000), (d + 7, rows[0][1])]
    return rows


@pytest.mark.parametrize(("seed", "k", "num"), [(1, 3, 90), (2, 5, 80)])
def test_against_brute_force(spark, seed, k, num):
    rows = family_texts(seed)
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, n int, tokens string").repartition(3)
    got = op.ngram_components(df, k, num, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == by_hand(rows, k, num, 100)
    kept = op.one_of_each(df, k, num, 100)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in by_hand(rows, k, num, 100)})


def test_repeats_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "z z z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in op.ngram_components(df, 3, 90, 100).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert op.ngram_components(df.limit(0), 3, 90, 100).count() == 0


def test_one_doc_id_with_several_texts(spark):
    rng = random.Random(11)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(60)] for x in "ab")
    near = lambda w, k: " ".join(w[:-k] + [f"n{k}{i}" for i in range(k)])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (12, near(a, 2)), (13, near(b, 2)), (14, near(b, 1)), (15, " ".join(b)), (4, "alone " + near(a, 40)), (4, "alone " + near(b, 40))]
    rows += [(30, near(a, 3)), (30, near(a, 1)), (None, near(b, 1)), (None, "no partner at all"), (20, near(a, 2) + " z1 z2 z3"), (3, "x y"), (3, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets, link = [set_of(t, 3) for _, t in rows], {k: {k} for k in range(len(rows))}
    for i in link:
        for j in link:
            same = sets[i] == sets[j] if None in (rows[i][0], rows[j][0]) else 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            if same:
                link[i].add(j)
    want, groups = [], {}
    for i in link:
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want.append((rows[i][0], len(sets[i]), min(ids, default=None)))
        groups[min(seen)] = min(ids, default=None)
    got = op.ngram_components(df, 3, 80, 100).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert {r.component_id for r in got if r.doc_id == 13} == {5} == {r.component_id for r in got if r.doc_id == 12}
    kept = op.one_of_each(df, 3, 80, 100).collect()
    # Two components have doc_id 5 as their smallest, two sets of doc_id 4 stand alone, equal rows of doc_id 3 stay together.
    assert sorted((r.doc_id for r in kept), key=str) == sorted([*groups.values(), 3], key=str)


def test_word_hashes():
    texts = [b"Aa bB\taa", b"", b"  ", "é aa".encode(), b"x" * 700]
    got = {}
    for k, docs in hashing.text_words(texts):
        got |= {k + i: d.tolist() for i, d in enumerate(docs)}
    assert got[0][0] == got[0][2] == got[3][1] and got[0][1] != got[0][0]
    assert got[1] == got[2] == [] and len(got[4]) == 1
    long = b"ab cd " * 600_000
    assert len(np.unique(hashing.long_text(long))) == 2 and len(hashing.long_text(long)) == 1_200_000
