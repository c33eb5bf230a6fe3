import hashlib
import re

from tickloom.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, kept boolean, digest string"
ROWS = [(5, "a b"), (3, "ab"), (4, " a\tb"), (9, None), (8, ""), (7, "\n\x0b"), (6, " "), (2, "é"), (1, "é"), (None, "a b"), (11, "z" * 200_000), (12, "z" * 200_000)]


def by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), d is None, d or 0, d))
    return sorted(
        ((d, min(groups[norm(t)])[3], len(groups[norm(t)]), d == min(groups[norm(t)])[3], hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows), key=str
    )


def test_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, None, "clash") for d, t in ROWS], SCHEMA).repartition(4)
    assert sorted(map(tuple, op.exact_duplicates(df).collect()), key=str) == by_hand(ROWS)


def test_dropping_keeps_columns_and_one_of_each(spark):
    df = spark.createDataFrame([(d, t, None, "clash") for d, t in ROWS], SCHEMA)
    kept = op.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r[1] for r in by_hand(ROWS)})


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in op.exact_duplicates(df).collect()] == [(1, 1, 2, True)] * 2
    assert op.exact_duplicates(df.limit(0)).count() == 0


def test_dropping_leaves_other_texts_of_a_dropped_doc_id(spark):
    rows = [(1, "x"), (None, "x"), (None, "alone"), (2, "x"), (2, "own"), (3, "y"), (3, "y"), (None, "z"), (None, " z")]
    kept = op.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, "x"), (None, "alone"), (2, "own"), (3, "y"), (None, " z")], key=str)


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "same text", "a"), (1, "same text", "b"), (1, "same  text", "a"), (1, "other", "a"), (2, None, None), (2, "", "c"), (3, "same text", "z")] + [(7, "hot", "h")] * 500
    kept = op.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "same  text", "a"), (1, "other", "a"), (2, None, None), (7, "hot", "h")], key=str)
