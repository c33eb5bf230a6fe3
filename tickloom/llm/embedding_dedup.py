"""Near-duplicate embeddings of a label by int8 tile products with rigorous error bounds.

1. Equal vectors of a label form one class; the smallest vec_id represents it, its size is kept.
2. The classes of a label are dealt by hash into blocks of at most about ``CELL_VALUES`` numbers, and every
   pair of blocks is one cell, so a hot label has more cells, none of them larger.
3. In a cell, unit vectors are quantised to q in -127..127 with a scale s each. For u and w with
   quantisation errors |u - s q| = e_u, e_w and |s q| = n_u, Cauchy and Schwarz give
   |u.w - s_u s_w q_u.q_w| <= e_u + n_u e_w, so only pairs with s_u s_w q_u.q_w + e_u + n_u e_w >= threshold can
   be links. The integer products are exact: a tile is one matrix product of whole numbers below
   2^24 in single precision (2^53 in double where vectors are longer). Only those pairs are recomputed, in double.
4. A cell gives no pairs but for each class that is linked in it the number of vectors linked and the smallest
   class it reaches there: at most a row a class, however many pairs. Their sums and components are the result.

All pairs of a label are compared, so work grows with the square of a label's classes; blocks of
16,384 vectors of 64 numbers keep a cell at some 50 MB and send a class once for each block.

Defined results: vectors that are null, empty or zero, hold null or non-finite numbers, have no label or no vec_id link with nothing
(n_links 0, component_id is vec_id); vectors of different lengths link with nothing of each other; rows repeated with one
vec_id are vectors of their own, equal ones are linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .graph import components

#: Numbers in a block of vectors; small labels have up to FEW_BLOCKS blocks of at least LEAST_ROWS, to spread over tasks.
CELL_VALUES = 1 << 20
FEW_BLOCKS, LEAST_ROWS = 4, 256
TILE, PAIRS = 1024, 1 << 15
#: More than what single precision loses in scaling the products (five roundings of numbers below 2).
ROUNDING = 1e-5
CELL = ("label", "dims", "i", "j")
CLASS = ("vec_id", "h1")
FOUND = "vec_id long, h1 long, links long, root_id long, root_h1 long"


class Side:
    """The vectors of a block: as they are (scaled by powers of two), and quantised."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.float64)
        self.x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x))
        unit = self.x / self.norm[:, None]
        self.scale = (np.abs(unit).max(1) if len(x) else np.empty(0)) / 127
        whole = np.rint(unit / self.scale[:, None])
        kept = whole * self.scale[:, None]
        self.error = np.linalg.norm(unit - kept, axis=1)
        self.length = np.linalg.norm(kept, axis=1)
        exact = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
        self.q = whole.astype(np.int8)
        self.exact = exact

    def tile(self, at: int) -> tuple[slice, np.ndarray]:
        part = slice(at, min(at + TILE, len(self.x)))
        return part, self.q[part].astype(self.exact)


def possible(a: Side, b: Side, threshold: float, same: bool):
    """(rows of a, rows of b), tile by tile, of the pairs that the bounds do not rule out; of one side with itself each pair once."""
    for at in range(0, len(a.x), TILE):
        one, qa = a.tile(at)
        for to in range(at if same else 0, len(b.x), TILE):
            two, qb = b.tile(to)
            most = qa @ qb.T
            most *= a.scale[one, None].astype(a.exact)
            most *= b.scale[None, two].astype(a.exact)
            most += a.error[one, None].astype(a.exact)
            most += np.outer(a.length[one], b.error[two]).astype(a.exact)
            r, c = np.nonzero(most >= threshold - ROUNDING)
            r, c = r + at, c + to
            if same:
                r, c = r[r < c], c[r < c]
            yield r, c


def linked_pairs(a: Side, b: Side, threshold: float, same: bool):
    """Of the possible pairs those whose cosine, in double precision, reaches the threshold."""
    for r, c in possible(a, b, threshold, same):
        for k in range(0, len(r), PAIRS):
            own, other = r[k : k + PAIRS], c[k : k + PAIRS]
            cosine = np.einsum("ij,ij->i", a.x[own], b.x[other]) / (a.norm[own] * b.norm[other])
            hit = cosine >= threshold
            yield own[hit], other[hit]


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (a node's smallest known number) with the links (a, b) taken up."""
    while True:
        one, two = root[a], root[b]
        if (one == two).all():
            return root
        low = np.minimum(one, two)
        np.minimum.at(root, one, low)
        np.minimum.at(root, two, low)
        while (root[root] != root).any():
            root = root[root]


def _cell(threshold: float):
    schema = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        _, dims, i, j = (k.as_py() for k in key)
        cell = cell.sort_by([("vec_id", "ascending"), ("h1", "ascending")])
        x = cell.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dims)
        block, many = cell.column("block").to_numpy(), cell.column("many").to_numpy()
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a = Side(x[one])
        b = a if i == j else Side(x[two])
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for r, c in linked_pairs(a, b, threshold, i == j):
            r, c = one[r], two[c]
            links += np.bincount(r, many[c], len(x)).astype(np.int64) + np.bincount(c, many[r], len(x)).astype(np.int64)
            root = joined(root, r, c)
        hit = np.flatnonzero(links)
        ids, h1 = cell.column("vec_id").to_numpy(), cell.column("h1").to_numpy()
        return pa.Table.from_arrays([pa.array(v) for v in (ids[hit], h1[hit], links[hit], ids[root[hit]], h1[root[hit]])], schema=schema)

    return run


def keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, dims, x, h1, h2 of every row; without x where it links with nothing."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    good = x.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~bad & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.when(good, x).alias("x"))
    return rows.select("*", F.size("x").alias("dims"), F.xxhash64(F.lit(1), "x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2"))


def dealt(classes: DataFrame) -> DataFrame:
    """A row of each class for each cell of its block."""
    sizes = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.ceil(F.col("n") * F.col("dims") / CELL_VALUES), F.least(F.lit(FEW_BLOCKS), F.ceil(F.col("n") / LEAST_ROWS)))
    rows = classes.join(written(sizes.select("label", "dims", blocks.cast("int").alias("blocks"))), ["label", "dims"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("label", "dims", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *CLASS, "many", "x")


def near_embeddings(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    rows = keyed(vectors, id_col, vector_col, label_col)
    classes = rows.where("x is not null").groupBy("label", "dims", "h1", "h2", "x").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("many"))
    classes = written(classes)
    found = written(dealt(classes).groupBy(*CELL).applyInArrow(_cell(threshold), FOUND))
    counts = found.groupBy(*CLASS).agg(F.sum("links").alias("links"))
    comps = components(found.select(F.struct(*CLASS).alias("a"), F.struct(F.col("root_id").alias("vec_id"), F.col("root_h1").alias("h1")).alias("b")))
    comps = comps.select(F.col("v.vec_id").alias("vec_id"), F.col("v.h1").alias("h1"), F.col("comp.vec_id").alias("smallest"))
    known = classes.drop("x", "dims").join(counts, [*CLASS], "left").join(comps, [*CLASS], "left").where("links is not null or many > 1")
    known = written(known.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("smallest", "vec_id").alias("smallest")))
    linked = rows.withColumn("h2", F.when(F.col("x").isNotNull(), F.col("h2"))).drop("x", "dims").join(known, ["label", "h1", "h2"], "left")
    component = F.coalesce("smallest", "vec_id")
    return linked.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op13_embedding_dedup(spark, sf_dir):
    return near_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_dedup": op13_embedding_dedup}
SQL = {
    "op13_embedding_dedup": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS x
  FROM embeddings),
g AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.r AS a, b.r AS b, b.vec_id AS far
  FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(r, far, via) AS (
  SELECT a, far, b FROM l
  UNION
  SELECT reach.r, l.far, l.b FROM reach JOIN l ON reach.via = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.r) AS n_links,
       least(v.vec_id, coalesce((SELECT min(far) FROM reach WHERE reach.r = v.r), v.vec_id)) AS component_id,
       v.vec_id IS NOT DISTINCT FROM least(v.vec_id, coalesce((SELECT min(far) FROM reach WHERE reach.r = v.r), v.vec_id)) AS kept
FROM v
"""
}
