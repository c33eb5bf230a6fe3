import random
import re

import corpus_pipeline as cp
from tickloom.llm import exact_dedup


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        docs = exact_dedup.written(stage(spark, docs, sf))
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    first = kept["toxicity"]
    best = {}
    for d, r in first.items():
        norm = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[norm] = min(best.get(norm, (0, 1 << 60)), (-len(r.text), d))
    assert set(kept["exact_dedup"]) == {d for _, d in best.values()}
    sets = {d: shingles(r.text) for d, r in kept["exact_dedup"].items()}
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    assert set(kept["ngram_join"]) == set(root.values())
    assert set(kept["mixing"]) < set(kept["ngram_join"])
    pieces = cp.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(kept["mixing"])


def test_stages_with_nulls_repeats_clashing_columns_and_no_rows(spark, tmp_path):
    """Every stage returns the table's columns; null texts and ids, ties and repeats have their defined results."""
    sf = str(tmp_path)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30)), "en", f"src{i % 3}", 5, i, "a") for i in range(60)]
    rows += [(60, None, "en", "src0", 0, 1, "b"), (None, None, None, None, None, 2, "c"), (None, rows[3][1], "de", None, 1, 3, "d"), (61, "", "en", "src1", 0, 4, "e"), rows[5], rows[5]]
    rows += [(62, rows[7][1] + " tail", "en", "src2", 1, 5, "f"), (63, rows[8][1].upper(), "en", "src2", 1, 6, "g"), (64, "long " * 30_000, "en", "src1", 1, 7, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, full string")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = df
    for name, stage in cp.STAGES[:-1]:
        docs = exact_dedup.written(stage(spark, docs, sf))
        assert docs.columns == df.columns
        assert set(map(tuple, docs.collect())) <= set(rows)
        if name == "ngram_join":
            texts = sorted(r.text or "" for r in docs.collect())
            assert texts == sorted([r[1] for r in rows[:60]] + ["", "long " * 30_000])
    left = docs.collect()
    assert 0 < len(left) < 64
    pieces = cp.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.start == 0) == sorted(str(r.doc_id) for r in left)
    none = df.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0
