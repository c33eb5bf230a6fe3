"""Audit of how five text filters interact, by contingency tensor contractions.

Every document is reduced to its part and five bits, one a filter it fails. Their counts (all documents,
good ones, toxic ones) are at most 32 rows a part; reshaped to a 2x2x2x2x2 tensor, one contraction
with a vector of pass, fail or all along each axis gives the documents of any step of any order.

The filters: A under 200 words, B fewer distinct words than half of them, C more than 3 % capital
letters A-Z, D one of ``#$%&*|``, E text identical to that of a smaller doc_id of the whole table.

Texts are read once, where they lie; only a digest, the bits, the part and the ids move. Copies
are found by digest: of a digest only the smallest doc_id and only digests that occur twice are kept, so a
hot text is reduced in its tasks and its join can be split. A part with most rows is a sum like any other.

Defined results: null text is empty (0 words: A fails; B does not, 0 < 0 being false); null part is the empty string;
a null doc_id is neither smaller nor larger than any other, so such rows never fail E, and they have no labels;
rows repeated with one doc_id do not make each other copies, each counts; a document is good (toxic) when any of
its label rows has quality 1 (toxic 1), other label values are ignored, labels without document too; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, table, text_of, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MARKS = r"[#$%&*|]"
MEASURES = ("n", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: str, words: str) -> dict[str, Column]:
    """The failure conditions of a document's own text, by filter."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * F.length(text), "D": F.col(text).rlike(MARKS)}


def tested(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, digest and bits (A to D) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK + "+"), ""))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures("text", "words").values())), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("bits"))


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with the bit of E: the text is that of a smaller doc_id."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("many")).where("many > 1").select("digest", "first_id")
    met = rows.join(written(first), "digest", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return met.withColumn("bits", F.col("bits") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, bits, n, good, toxic: the contingency table, at most 32 rows a part."""
    rows = with_copies(written(tested(docs, id_col, text_col, part_col))).select("doc_id", "part", "bits")
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("labelled"))
    known = known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    met = rows.join(known, rows["doc_id"] == known["labelled"], "left")
    return met.groupBy("part", "bits").agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in ("good", "toxic")))


def contracted(bits: np.ndarray, counts: np.ndarray, orders: list[str] = ORDERS) -> pd.DataFrame:
    """All steps of all ``orders`` over a contingency table: rows of ``counts`` are the MEASURES of ``bits``."""
    k = len(FILTERS)
    tensor = np.zeros((2**k, len(MEASURES)), np.int64)
    np.add.at(tensor, bits, counts)
    tensor = tensor.reshape(*[2] * k, len(MEASURES))  # the highest bit is the first axis
    passes, fails, any_ = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    axes = [FILTERS.index(f) for order in orders for f in order]
    steps = [s for order in orders for s in range(len(order))]
    places = [[FILTERS.index(f) for f in order] for order in orders for _ in order]

    def contract(along) -> np.ndarray:
        """``along(place of a filter in the order, step)`` picks the vector of its axis; one row of measures a step."""
        picks = np.empty((len(steps), k, 2), np.int64)
        for row, (order, s) in enumerate(zip(places, steps, strict=True)):
            for at, f in enumerate(order):
                picks[row, k - 1 - f] = along(at, s)
        return np.einsum("abcdem,sa,sb,sc,sd,se->sm", tensor, *(picks[:, i] for i in range(k)), optimize=True)

    removed = contract(lambda at, s: passes if at < s else fails if at == s else any_)
    failing = contract(lambda at, s: fails if at == s else any_)[:, 0]
    out = pd.DataFrame({"filter_order": np.repeat(orders, k), "step": np.array(steps, np.int32) + 1})
    out["kept"] = contract(lambda at, s: passes if at <= s else any_)[:, 0]
    out["removed"] = removed[:, 0]
    out["redundant"] = failing - removed[:, 0]
    out["unique_fails"] = contract(lambda at, s: fails if at == s else passes)[:, 0]
    out["good_lost"], out["toxic_lost"] = removed[:, 1], removed[:, 2]
    shares = np.zeros(k, np.int64)
    np.add.at(shares, axes, removed[:, 0])
    out["shapley"] = shares[axes]
    return out


def _audit(frame: pd.DataFrame) -> pd.DataFrame:
    out = contracted(frame["bits"].to_numpy(), frame[[*MEASURES]].to_numpy(np.int64))
    out.insert(0, "part", frame["part"].iloc[0])
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The steps of all orders, a row each a part."""
    return cells(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(_audit, RESULT)


def op12_filter_audit(spark, sf_dir):
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op12_filter_audit": op12_filter_audit}
SQL = {
    "op12_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
b AS (
  SELECT part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS bits
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, bits, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY part, bits),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(name, bit)),
o AS (
  SELECT v.name || w.name || x.name || y.name || z.name AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bit
  FROM f v, f w, f x, f y, f z
  WHERE v.bit | w.bit | x.bit | y.bit | z.bit = 31),
s AS (
  SELECT filter_order, step, bit[step] AS own, coalesce(list_sum(bit[1:step - 1]), 0) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
         sum(CASE WHEN bits & CAST(earlier + own AS BIGINT) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bits & CAST(earlier AS BIGINT) = 0 AND bits & own <> 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bits & CAST(earlier AS BIGINT) <> 0 AND bits & own <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN bits = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN bits & CAST(earlier AS BIGINT) = 0 AND bits & own <> 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN bits & CAST(earlier AS BIGINT) = 0 AND bits & own <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""
}
