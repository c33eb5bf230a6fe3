import random

import numpy as np

from tickloom.llm import toxicity as op


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train, rest = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    got = op.toxicity(docs.join(labels, "doc_id", "left_semi"), train).join(rest, "doc_id").collect()
    hit = sum(r.rejected and r.toxic == 1 for r in got)
    assert hit / sum(r.rejected for r in got) > 0.95
    assert hit / sum(r.toxic == 1 for r in got) > 0.85


def test_chain_uses_earlier_categories():
    rng = random.Random(2)
    rows, targets = [], []
    for _ in range(600):
        low, toxic = rng.random() < 0.5, rng.random() < 0.3
        words = [f"w{rng.randrange(50)}" for _ in range(20)] + ["junkword"] * low + ["nasty"] * toxic
        rows.append(" ".join(words).encode())
        targets.append((low, toxic, toxic and not low))
    h, r = op.distinct_pairs(list(op.features_of(rows)))
    chain = op.Chain().fit(h, r, np.array(targets, np.int64))
    p = chain.probabilities([b"w1 nasty", b"w1 nasty junkword", b"w1", b""])
    assert p[0, 1] > 0.9 and p[0, 2] > 0.8 and p[1, 0] > 0.9 and p[1, 2] < 0.3 and p[2, 1] < 0.1
    assert chain.links[2][1].dense[0] < 0 < chain.links[2][1].dense[1]


def test_whole_text_counts(spark):
    docs = [(i, ("nasty words here" if i % 2 else "kind words here"), i) for i in range(200)]
    docs += [(1000, "kind " * 600_000 + "nasty", 0), (1001, None, 0), (None, "nasty", 0), (1002, "", 0)]
    labels = [(i, 1, i % 2) for i in range(200)] + [(5, None, 1), (None, 1, 1), (7777, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in op.toxicity(df, lab).collect()}
    assert got[1000] and got[None] and not got[1001] and not got[1002] and got[1] and not got[2]
    kept = op.without_toxic(df, lab)
    assert kept.columns == df.columns and kept.where("doc_id < 200").count() == 100
    assert op.toxicity(df.limit(0), lab).count() == 0
    assert not any(r.rejected for r in op.toxicity(df, lab.limit(0)).collect())


def test_labels_without_signal_reject_nothing(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(15))) for i in range(300)]
    labels = [(i, rng.randrange(2), int(rng.random() < 0.12)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = op.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 300 and not any(r.rejected for r in got)
    same = spark.createDataFrame([(i, "one text") for i in range(50)], "doc_id long, text string")
    assert not any(r.rejected for r in op.toxicity(same, spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")).collect())


def test_threshold_never_takes_all():
    y = np.array([1, 0, 0, 0])
    assert op.best_threshold(np.full(4, 0.3), y) == 2.0
    assert op.best_threshold(np.array([0.9, 0.2, 0.1, 0.1]), y) == 0.55
    assert op.best_threshold(np.array([0.1, 0.9, 0.8, 0.7]), y) == 2.0
    assert op.best_threshold(np.empty(0), np.empty(0)) == 2.0


def test_labels_of_one_kind_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"words w{i % 7} here v{i % 3}") for i in range(40)], "doc_id long, text string")
    for quality, toxic in ((1, 1), (1, 0), (0, 1), (0, 0)):
        labels = spark.createDataFrame([(i, quality, toxic) for i in range(40)], "doc_id long, quality int, toxic int")
        rows = op.toxicity(docs, labels).collect()
        assert len(rows) == 40 and not any(r.rejected for r in rows)
        assert max(max(r.p_low_quality, r.p_toxic, r.p_toxic_fluent) for r in rows) < 1e-6
        assert op.without_toxic(docs, labels).count() == 40
