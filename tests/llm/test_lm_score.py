import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import gru
from tickloom.llm import lm_score as op

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for ws, out in zip(tokens, held, strict=True) if not out for w in ws)
    n, v = sum(c.values()), len(c)
    return [(out, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws, out in zip(tokens, held, strict=True)]


def test_base_columns_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "LISTED", 300)
    monkeypatch.setattr(op, "VOCABULARY", 100)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = [(d.doc_id, d.text) for d in docs] + [(900, None), (901, " \t"), (902, "new " * 40_000)]
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, n_tokens int, h string")
    got = {r.doc_id: r for r in op.lm_scores(df).collect()}
    for (d, _), (out, n, known, total, base) in zip(rows, by_hand(rows), strict=True):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_beats_the_base_on_held_out_text(spark):
    got = op.op7_gru_lm(spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in got) > 0.97 * sum(r.base_score for r in got)


def small(seed=0, words=30):
    rng = np.random.default_rng(seed)
    layout = gru.Layout(np.sort(rng.integers(1, 500, words))[::-1].astype(float), 6)
    return layout, layout.first() + rng.normal(0, 0.3, len(layout.first())).astype(np.float32), rng


def plain_score(layout, flat, text):
    """Word by word with whole softmaxes."""
    p = {k: v.astype(float) for k, v in layout.named(flat).items()}
    h, total, x, H = np.zeros(gru.HIDDEN), 0.0, np.zeros(gru.HIDDEN), gru.HIDDEN
    sig = lambda a: 1 / (1 + np.exp(-a))
    for w in text:
        a, hu = x @ p["w"] + p["b"], h @ p["u"]
        z, r = sig(a[:H] + hu[:H]), sig(a[H : 2 * H] + hu[H : 2 * H])
        n = np.tanh(a[2 * H :] + r * hu[2 * H :])
        h = (1 - z) * n + z * h
        k = layout.word_class[w]
        c = h @ p["c"] + p["cb"]
        lo, hi = layout.start[k], layout.start[k + 1]
        o = h @ p["o"][lo:hi].T + p["ob"][lo:hi]
        total += c[k] - np.log(np.exp(c).sum()) + o[w - lo] - np.log(np.exp(o).sum())
        x = p["emb"][w]
    return total / np.log(10)


def test_scores_carry_the_state_through_windows():
    layout, flat, rng = small()
    texts = [rng.integers(0, 30, n) for n in (1, 2, 23, 24, 25, 200, 77, 5, 48)]
    got = gru.Scorer(layout, flat, lanes=3).score(texts)
    assert got == pytest.approx([plain_score(layout, flat, t) for t in texts], rel=1e-4)


def test_probabilities_sum_to_one():
    layout, flat, _ = small()
    total = sum(10 ** plain_score(layout, flat, [3, w]) for w in range(30))
    assert total == pytest.approx(10 ** plain_score(layout, flat, [3]), rel=1e-6)


def test_gradient_by_differences():
    layout, flat, rng = small(3, 12)
    ids = rng.integers(0, 12, (7, 4))
    ids[5:, 1] = -1
    before = np.vstack([np.full((1, 4), -1), ids[:-1]])
    flat = flat.astype(float)

    def loss(f):
        g = layout.named(np.zeros_like(f))
        total, h = 0.0, np.zeros((4, gru.HIDDEN))
        p = layout.named(f)
        for j in range(4):
            total -= plain_score(layout, f, ids[ids[:, j] >= 0, j]) * np.log(10)
        del g, h, p
        return total

    grad = np.zeros_like(flat)
    gru.window_gradient(layout, layout.named(flat), layout.named(grad), before, ids, np.zeros((gru.HIDDEN, 4)))
    for i in rng.integers(0, len(flat), 60):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert grad[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-4)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted(r.n_tokens for r in op.lm_scores(df).collect()) == [1, 1, 3]
    assert op.lm_scores(df.limit(0)).count() == 0


def test_texts_end_to_end_on_a_lane_have_the_gradient_of_lanes_of_their_own():
    layout, flat, rng = small(5, 12)
    ids = rng.integers(0, 12, (8, 2))
    before = np.vstack([np.full((1, 2), -1), ids[:-1]])
    apart, joined = np.zeros(len(flat)), np.zeros(len(flat))
    p = layout.named(flat.astype(float))
    gru.window_gradient(layout, p, layout.named(apart), before, ids, np.zeros((gru.HIDDEN, 2)))
    gru.window_gradient(layout, p, layout.named(joined), before.T.reshape(-1, 1), ids.T.reshape(-1, 1), np.zeros((gru.HIDDEN, 1)))
    assert joined == pytest.approx(apart, abs=1e-9)


def test_learns_from_whole_texts(spark):
    text = " ".join(f"w{i % 50}" for i in range(3000))
    df = spark.createDataFrame([(i, text) for i in range(12)], "doc_id long, text string").coalesce(1)
    got = op.lm_scores(df).collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_WORDS", 4000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r.score for r in op.lm_scores(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in op.lm_scores(docs.repartition(5)).collect()}
    assert many == pytest.approx(one, rel=1e-6)


def test_windows_of_streams_equal_a_dense_layout():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 9, n).astype(np.uint16) for n in (1, 2, 300, 25, 24, 48, 7, 1, 130)]
    lanes = gru.dealt(texts, 4)
    dense = np.full((max(sum(map(len, lane)) for lane in lanes), 4), -1)
    before = np.full_like(dense, -1)
    for j, lane in enumerate(lanes):
        at = 0
        for t in lane:
            dense[at : at + len(t), j], before[at + 1 : at + len(t), j] = t, t[:-1]
            at += len(t)
    streams = gru.Streams(lanes)
    for at in range(0, streams.longest, gru.WINDOW):
        got_before, got = streams.window(at)
        live = got.shape[1]
        assert (got == dense[at : at + gru.WINDOW, :live]).all() and (got_before == before[at : at + gru.WINDOW, :live]).all()
        assert (dense[at : at + gru.WINDOW, live:] == -1).all()


def test_one_long_text_beside_short_ones_holds_little_memory():
    import tracemalloc

    texts = [np.ones(2_000_000, np.uint16)] + [np.ones(30, np.uint16)] * 800
    tracemalloc.start()
    streams = gru.Streams(gru.dealt(texts, 256))
    streams.window(0), streams.window(1_000_008)
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()
