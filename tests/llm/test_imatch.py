import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from tickloom.llm import imatch as op

SCHEMA = "doc_id long, text string, side int, own string"


def edited_by_hand(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (d, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        f = len(t) // 3
        out[d] = hashlib.sha256((t[: len(t) - f] + nxt[:f]).encode()).hexdigest()
    return out


def test_edits_and_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ROWS", 50)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(d.doc_id * 7, d.text) for d in docs] + [(5000, None), (5001, ""), (5003, docs[0].text), (5002, docs[0].text), (5005, "é" * 50), (5007, " ".join(f"w{i}" for i in range(30_000)))]
    got = {r.doc_id: r for r in op.fingerprints(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).collect()}
    assert {d: r.edited_sha256 for d, r in got.items()} == edited_by_hand(rows)
    ids = sorted(got, reverse=True)
    texts = dict(rows)
    for k, d in enumerate(ids):
        assert got[d].next_id == ids[(k + 1) % len(ids)]
        assert got[d].n_chars == len(texts[d] or "")
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    assert got[5003].fingerprint == got[5002].fingerprint == got[0].fingerprint and got[5003].near_next == 1.0
    assert got[5000].fingerprint == got[5001].fingerprint
    own = [d.doc_id * 7 for d in docs if d.n_chars > 300]
    edited, other = (sum(getattr(got[d], c) for d in own) / len(own) for c in ("near_edited", "near_next"))
    assert edited > 0.15 and other < 0.1 and edited > 3 * other


def test_repeats_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d e f"), (3, None)], "doc_id long, text string")
    got = op.fingerprints(df).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "3", "None"]
    assert {r.next_id for r in got if r.doc_id is None} == {3}
    assert op.fingerprints(df.limit(0)).count() == 0


def hash_of(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def terms_by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return {signed(hash_of(w.encode())) for w in re.findall(r"[^\x20\x09-\x0D]+", lower)}


def chained(values):
    h = 42
    for t in values:
        h = hash_of(struct.pack("<q", t), h)
    return h


def print_by_hand(terms, lexicon):
    out = []
    for g in range(op.GROUPS):
        own = [signed(hash_of(struct.pack("<q", t), hash_of(struct.pack("<i", g)))) for t in sorted(terms & lexicon)]
        own, ladder = [h for h in own if h % 3], []
        while own and len(ladder) < op.RUNGS:
            ladder.append(f"{chained(own):X}"[-op.DIGITS :].zfill(op.DIGITS))
            own = [h for h in own if h % 4 ** len(ladder) == 0]
        out.append(",".join(ladder))
    return ".".join(out) if any(out) else f"={chained(sorted(terms)):X}"


def likeness_by_hand(a, b):
    if a == b:
        return 1.0
    if "=" in a + b:
        return 0.0
    x, y = ([g.split(",") for g in f.split(".")] for f in (a, b))
    best = None
    for k in range(op.RUNGS):
        at = lambda z: [g[k] if len(g) > k else "" for g in z]  # noqa: B023, E731
        pairs = list(zip(at(x), at(y), strict=True))
        used = sum(p != ("", "") for p in pairs)
        if best is None or used >= op.GROUPS / 2:
            best = used, sum(p[0] == p[1] != "" for p in pairs)
    used, same = best
    if not same:
        return 0.0
    z, e = max(op.GROUPS - used, 0.5) / op.GROUPS, (op.GROUPS - used + same) / op.GROUPS
    return min(max(1 - math.log(e) / math.log(z), 0.0), 1.0)


def test_fingerprints_and_likeness_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(d.doc_id, d.text) for d in docs] + [(5000, None), (5001, "only once written"), (5002, " ".join(f"w{i}" for i in range(5000)) + " the")]
    got = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    df = Counter(t for _, text in rows for t in terms_by_hand(text))
    lexicon = {t for t, n in df.items() if op.BAND[0] <= 1 - math.log(n) / math.log(len(rows)) <= op.BAND[1]}
    texts, order = dict(rows), sorted((d for d, _ in rows), reverse=True)
    for r in got:
        text, after = texts[r.doc_id] or "", texts[r.next_id] or ""
        assert r.next_id == order[(order.index(r.doc_id) + 1) % len(order)]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert r.fingerprint == print_by_hand(terms_by_hand(text), lexicon)
        assert r.edited_fingerprint == print_by_hand(terms_by_hand(edited), lexicon)
        assert r.near_edited == pytest.approx(likeness_by_hand(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(likeness_by_hand(r.fingerprint, print_by_hand(terms_by_hand(after), lexicon)))


def near(rows, got):
    """Mean absolute error of near_edited against the Jaccard similarity of lexicon terms, by length."""
    df = Counter(t for _, text in rows for t in terms_by_hand(text))
    lexicon = {t for t, n in df.items() if op.BAND[0] <= 1 - math.log(n) / math.log(len(rows)) <= op.BAND[1]}
    texts, errors = dict(rows), {True: [], False: []}
    for r in got:
        text, after = texts[r.doc_id] or "", texts[r.next_id] or ""
        third = len(text) // 3
        a, b = terms_by_hand(text) & lexicon, terms_by_hand(text[: len(text) - third] + after[:third]) & lexicon
        if a | b:
            errors[len(text) < 200].append(abs(r.near_edited - len(a & b) / len(a | b)))
    return {k: sum(v) / len(v) for k, v in errors.items() if v}


def test_likeness_is_near_the_jaccard_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
    errors = near(rows, op.fingerprints(docs).collect())
    assert errors[True] < 0.13 and errors[False] < 0.13  # a share of 24 groups strays by about 0.1


def test_short_random_texts_have_fingerprints_of_their_own(spark):
    import random

    draw = random.Random(5)
    rows = [(i, " ".join(f"w{draw.randrange(3000)}" for _ in range(10))) for i in range(2000)]
    got = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in got}) == len({frozenset(t.split()) for _, t in rows})


def test_a_large_lexicon_meets_terms_by_a_shuffled_join(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, op.fingerprints(docs).collect()))
    monkeypatch.setattr(op, "SENT_TERMS", 0)
    assert sorted(map(tuple, op.fingerprints(docs).collect())) == want


def test_unrelated_texts_without_lexicon_terms_are_not_alike(spark):
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(40))) for i in range(6)]
    got = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in got}) == 6 and all(r.near_next == 0.0 for r in got)


def test_frequent_ids_are_split(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ROWS", 10)
    rows = [(None, f"n{i}") for i in range(150)] + [(7, f"s{i}") for i in range(150)] + [(i, f"t{i}") for i in range(20, 170)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", op.F.xxhash64("text"))
    _, parts = op.bounds_of(df, len(rows))
    assert parts[0] > 8 and max(parts[1:]) > 8
    got = op.with_next(df).collect()
    key = lambda d, k: (d is not None, d or 0, k)
    order = sorted(((r.doc_id, r.text_key) for r in got), key=lambda x: key(*x), reverse=True)
    place = {x: i for i, x in enumerate(order)}
    assert len(got) == 450 and all(place[(r.next.doc_id, r.next.text_key)] == (place[(r.doc_id, r.text_key)] + 1) % 450 for r in got)


def test_next_fingerprints_are_found_in_the_bucket_without_writing_or_shuffling_any(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET_ROWS", 50)
    wrote, write = [], op.written
    monkeypatch.setattr(op, "written", lambda df: wrote.append(df.columns) or write(df))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(d.doc_id, d.text) for d in docs.collect()] + [(None, "a text without id"), (9000, None), (9001, "")]
    out = op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.collect()
    assert not [c for columns in wrote for c in columns if "fingerprint" in c]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "fingerprint" in x] and "SortMergeJoin" not in plan
    prints = {r.doc_id: r.fingerprint for r in got}
    assert len(got) == len(prints) == len(rows)
    for r in got:
        assert r.near_next == pytest.approx(likeness_by_hand(r.fingerprint, prints[r.next_id]))


@pytest.mark.parametrize("most", [op.SENT_TERMS, 0])
def test_items_are_made_once_and_terms_are_hashed_in_rows_that_nothing_moves_afterwards(spark, monkeypatch, most):
    monkeypatch.setattr(op, "SENT_TERMS", most)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = op.fingerprints(docs)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "Filter" in x and "array_except" in x]  # a filter in front of the explosion would make the items again
    assert not [x for x in plan if "ObjectHashAggregate" in x]
    hashed = next(i for i, x in enumerate(plan) if "xxhash64(0, term" in x)
    listed = next(i for i, x in enumerate(plan) if "Window" in x and "collect_list" in x)
    assert listed < hashed and not [x for x in plan[listed + 1 : hashed] if "Sort" in x or "Exchange" in x]
    assert "Sort" in plan[hashed + 1]
