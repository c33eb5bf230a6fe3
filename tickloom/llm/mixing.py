"""Mixing sources to target weights: hierarchical budgets over a domain - language - source tree.

1. Every document gets its number of tokens (words); leaves are summed up, then their ancestors.
2. The budget goes down the tree. A node shares its budget among its children by weight; a child that
   cannot fill its share (its tokens times the allowed epochs) is filled up and what it leaves goes to
   its siblings by weight (water-filling in closed form, a window over the children). Only what all
   siblings together cannot take is left to the ancestors, whose own capacity was limited before.
3. A leaf takes whole epochs and then a token-prefix of one more, in the seeded order of that epoch.

The prefix is found without sorting a leaf in one task: documents fall into 4,096 buckets of the
seeded hash, tokens are summed by (leaf, bucket), a running sum over a leaf's buckets finds the one
that is cut, and only its documents are put in order. A leaf holding a third of all rows is therefore
spread evenly.

Defined results: null text is empty; documents without words have no tokens and are never taken; null
tree columns count as the label 'none'; a null doc_id is hashed as 'null'; rows repeated with one
doc_id share a hash and go in or out together; non-positive weights give no budget; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, text_of, written

BUCKET_DIGITS = 3


def weight_of(level: str, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def water_fill(children: DataFrame, parent: list[str], budget: str, name: list[str]) -> DataFrame:
    """Adds ``given``: the share of ``budget`` (one value per parent) of each child, up to its ``cap``."""
    ratio = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(0.0))
    rows = children.withColumn("ratio", ratio)
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", *name)
    usable = F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))
    before = F.coalesce(F.sum(usable).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.greatest(F.col("w"), F.lit(0.0))).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("lam", F.when(rest > 0, (F.col(budget) - before) / rest))
    level = F.max(F.when((F.col("w") > 0) & (F.col("lam") <= F.col("ratio")), F.col("lam"))).over(by)
    given = F.when(F.col("w") <= 0, F.lit(0.0)).when(level.isNull(), F.col("cap").cast("double"))
    given = given.otherwise(F.least(F.col("cap").cast("double"), F.greatest(level, F.lit(0.0)) * F.col("w")))
    return rows.withColumn("given", given).drop("lam", "ratio")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], share: float, max_epochs: int) -> DataFrame:
    """Leaves (levels, tokens) with ``given`` tokens each; ``share`` is the budget as a part of all tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    budget = caps.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(float(share))).cast("double").alias("budget"))
    above = None
    for depth, level in enumerate(levels):
        parent, name = levels[:depth], levels[: depth + 1]
        nodes = caps.groupBy(*name).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(level, weights.get(level, {})))
        nodes = nodes.crossJoin(F.broadcast(budget)) if above is None else nodes.join(above, parent)
        filled = water_fill(nodes, parent, "budget", name)
        above = filled.select(*name, F.col("given").alias("budget"))
    return leaves.join(above.withColumnRenamed("budget", "given"), levels)


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def leaf_plan(docs: DataFrame, levels: list[str], weights, share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents with tokens, leaves with full epochs and the place of the cut).

    ``docs`` has doc_id, text and the columns of ``levels``.
    """
    sized = written(docs.select("doc_id", *levels, F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("n_tokens")))
    leaves = sized.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"))
    given = budgets(leaves, levels, weights, share, max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("given") / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    given = given.withColumn("full", full)
    given = written(given.withColumn("rest", F.floor(F.col("given")).cast("long") - F.col("full") * F.col("tokens")))
    keyed = keyed_documents(sized, given, levels, seed)
    sums = keyed.groupBy(*levels, "rest", "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    upto = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    over = sums.withColumn("upto", F.sum("bucket_tokens").over(upto)).where(F.col("upto") > F.col("rest"))
    cut = over.groupBy(*levels).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("bucket_tokens")).alias("before"))).alias("c"))
    cut = written(cut.select(*levels, F.col("c.bucket").alias("cut_bucket"), F.col("c.before").alias("before")))
    inside = keyed.join(cut, levels).where(F.col("bucket") == F.col("cut_bucket"))
    running = Window.partitionBy(*levels, "cut_bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = inside.withColumn("upto", F.col("before") + F.sum("n_tokens").over(running)).where(F.col("upto") <= F.col("rest"))
    last = last.groupBy(*levels).agg(F.max("key").alias("cut_key"))
    return sized, written(given.join(cut, levels, "left").join(last, levels, "left").drop("before"))


def keyed_documents(sized: DataFrame, plan: DataFrame, levels: list[str], seed: int) -> DataFrame:
    rows = sized.join(plan, levels).where(F.col("n_tokens") > 0)
    rows = rows.withColumn("key", order_key(seed, F.col("full"), F.col("doc_id")))
    return rows.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))


def copies(seed: int, prefix: str = "") -> Column:
    """How often a document is taken, from the (prefixed) columns of its leaf's plan and of its tokens."""
    full, rest, cut_bucket, cut_key, n_tokens = (F.col(prefix + c) for c in ("full", "rest", "cut_bucket", "cut_key", "n_tokens"))
    key = order_key(seed, full, F.col("doc_id"))
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    part = cut_bucket.isNull() | (bucket < cut_bucket)
    part = part | ((bucket == cut_bucket) & F.coalesce(key <= cut_key, F.lit(False)))
    return F.when(n_tokens > 0, full + F.when(part & (rest > 0), 1).otherwise(0)).otherwise(0).cast("long")


def mix(docs: DataFrame, levels: list[str], weights, share: float = 1.0, max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """doc_id, the levels, n_tokens, leaf_budget, copies for every document."""
    sized, plan = leaf_plan(docs, levels, weights, share, max_epochs, seed)
    return sized.join(plan, levels).select("doc_id", *levels, "n_tokens", F.floor("given").cast("long").alias("leaf_budget"), copies(seed).alias("copies"))


def with_tree(docs: DataFrame, domains: int = 4) -> DataFrame:
    """doc_id, text and the tree's columns: the domain is the source's number modulo ``domains``."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1)
    domain = F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("domain"), F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("long"), F.lit(0)) % domains))
    named = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    return docs.select("doc_id", "text", domain.alias("domain"), named("lang"), named("source"))


LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"domain0": 4.0, "domain1": 3.0, "domain2": 2.0}, "lang": {"en": 3.0}}


def op9_mixing(spark, sf_dir):
    return mix(with_tree(table(spark, sf_dir, "documents")), LEVELS, WEIGHTS, share=1.0, max_epochs=4, seed=17)


def mixed_rows(docs: DataFrame, share: float, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that one epoch's budget of ``share`` of all tokens takes, columns as they were."""
    named = lambda c: F.coalesce(F.col(c), F.lit("none"))
    _, plan = leaf_plan(with_tree(docs), LEVELS, WEIGHTS, share, 1, seed)
    plan = plan.select(*(F.col(c).alias(f"__{c}") for c in ("lang", "source", "full", "rest", "cut_bucket", "cut_key")))
    rows = docs.withColumn("__n_tokens", F.regexp_count(text_of(), F.lit(WORD)))
    rows = rows.join(plan, (named("lang") == F.col("__lang")) & (named("source") == F.col("__source")))
    return rows.where(copies(seed, "__") > 0).select(*docs.columns)


QUERIES = {"op9_mixing": op9_mixing}


def _fill(nodes: str, parent: str, order: str) -> str:
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""
  SELECT *, CASE WHEN lev IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), greatest(lev, 0) * w) END AS given FROM (
    SELECT *, max(CASE WHEN lam <= cap / w THEN lam END) OVER ({by}) AS lev FROM (
      SELECT *, (budget - coalesce(sum(cap) OVER ({by}ORDER BY cap / w, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER ({by}ORDER BY cap / w, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam
      FROM {nodes}))"""


SQL = {
    "op9_mixing": rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'none'
              ELSE 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) END AS domain,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
n1 AS (SELECT domain, CAST(sum(tokens) AS BIGINT) * 4 AS cap,
              CASE domain WHEN 'domain0' THEN 4.0::DOUBLE WHEN 'domain1' THEN 3.0::DOUBLE WHEN 'domain2' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
              (SELECT CAST(sum(tokens) AS DOUBLE) FROM leaf) AS budget FROM leaf GROUP BY domain),
f1 AS ({_fill("n1", "", "domain")}),
n2 AS (SELECT l.domain, l.lang, CAST(sum(tokens) AS BIGINT) * 4 AS cap, CASE l.lang WHEN 'en' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
              any_value(f1.given) AS budget FROM leaf l JOIN f1 USING (domain) GROUP BY l.domain, l.lang),
f2 AS ({_fill("n2", "domain", "lang")}),
n3 AS (SELECT l.domain, l.lang, l.source, tokens, tokens * 4 AS cap, 1.0::DOUBLE AS w, f2.given AS budget
       FROM leaf l JOIN f2 ON l.domain = f2.domain AND l.lang = f2.lang),
f3 AS ({_fill("n3", "domain, lang", "source")}),
p AS (SELECT domain, lang, source, given, CASE WHEN tokens > 0 THEN CAST(floor(given / tokens) AS BIGINT) ELSE 0 END AS full_n, tokens FROM f3),
q AS (SELECT *, CAST(floor(given) AS BIGINT) - full_n * tokens AS rest FROM p),
k AS (SELECT d.*, q.given, q.full_n, q.rest,
             sum(n_tokens) OVER (PARTITION BY d.domain, d.lang, d.source
               ORDER BY md5(concat_ws(':', '17', CAST(full_n AS VARCHAR), CAST(doc_id AS VARCHAR)))) AS upto
      FROM d JOIN q ON d.domain = q.domain AND d.lang = q.lang AND d.source = q.source)
SELECT doc_id, domain, lang, source, n_tokens, CAST(floor(given) AS BIGINT) AS leaf_budget,
       CAST(CASE WHEN n_tokens > 0 THEN full_n + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies
FROM k
"""
}
