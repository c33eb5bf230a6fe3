"""Exact duplicates by a tree-merge of sorted digest runs.

Each scan partition forms a run: one row per digest, sorted by (run, digest) as Spark's
sort-based aggregation does it. Runs then meet in binomial rounds: in every round the runs whose
numbers agree above the merged bits exchange their rows by (run group, digest) and a multiway merge
keeps the best row of each digest. Four binomial levels are taken at a time, so three rounds join
4,096 runs. Every level carries the digest with the length and a second hash of the normalised text,
so a row is only merged with rows whose three values agree (the verification of the identifier).
Work is spread over the digests in every round, so no task holds a whole run group, and a hot digest
is reduced to one row per task before it is shuffled. Texts are never shuffled.

Defined results: null text is empty; texts of white space only are equal to the empty text; of equal
texts the one with the most code points stays, then the smallest doc_id; a null doc_id loses against
any other; rows repeated with the same doc_id are one document (all of them carry ``kept``), of which the filter keeps one row;
an empty table gives an empty result; other columns of the input are not looked at, but for ties of repeated rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, table, text_of, written

RUNS = 4096
FAN_IN = 16
KEYS = ("digest", "norm_chars", "check")


def normalised(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, text)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), normalised(text).alias("norm"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.unhex(F.sha2(F.col("norm"), 256)).alias("digest"),
        F.length("norm").alias("norm_chars"),
        F.xxhash64("norm").alias("check"),
    )


def tree_merge(rows: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: KEYS, keep_id, group_size."""
    best = F.struct((-F.col("n_chars")).alias("short"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    level = rows.select(*KEYS, best.alias("best"), F.lit(1).cast("long").alias("rows"), F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"))
    while runs > 1:
        runs = -(-runs // fan_in)
        keys = [*KEYS] if runs == 1 else [F.expr(f"run div {fan_in}").cast("int").alias("run"), *KEYS]
        level = level.groupBy(*keys).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    return level.select(*KEYS, F.col("best.doc_id").alias("keep_id"), F.col("rows").alias("group_size"))


def with_winners(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, KEYS, keep_id, group_size, kept for every row of ``docs``."""
    rows = digests(docs, id_col, text_col)
    winners = written(tree_merge(rows))
    return rows.join(winners, [*KEYS], "inner").select("doc_id", *KEYS, "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    return with_winners(docs, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as they were.

    The row that stays is that of ``keep_id``. Where several equal texts have that doc_id (or none of them has one), one
    of these rows stays: the one with the most code points, then the last text, then the last of the other columns as JSON.
    A row is dropped by its doc_id and its text, so another text under a dropped doc_id stays.
    """
    keys = [F.col(k).alias(f"__{k}") for k in KEYS]
    marked = with_winners(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id"), *keys, "kept").agg(F.count(F.lit(1)).alias("__many"))
    marked = written(marked.where("not kept or __many > 1").select("__id", *(f"__{k}" for k in KEYS), F.col("kept").alias("__kept")))
    text = text_of(text_col)
    norm = normalised(text)
    values = {"digest": F.unhex(F.sha2(norm, 256)), "norm_chars": F.length(norm), "check": F.xxhash64(norm)}
    same = docs[id_col].eqNullSafe(F.col("__id"))
    for k, value in values.items():
        same = same & (value == F.col(f"__{k}"))
    rows = docs.join(marked, same, "left").where("__kept is null or __kept")
    once, again = rows.where("__kept is null").select(*docs.columns), rows.where("__kept")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.struct(F.length(text), text, *([F.to_json(F.struct(*others))] if others else []))
    picked = again.groupBy("__id", *(f"__{k}" for k in KEYS)).agg(F.max_by(F.struct(*docs.columns), order).alias("__row"))
    return once.unionByName(picked.select("__row.*"))


def op2_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
SQL = {
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
