"""The trie of conversation prefixes by a splitter skeleton.

1. A turn is 22 bytes: a digest of role and text, and the text's code points. A conversation is the
   string of its turns (its path); bytes order as turns do and a prefix of turns is a prefix of bytes.
2. Equal conversations become one path. Their ids are kept in strings of ``CHUNK`` consecutive ids, so a hot
   conversation is reduced in its tasks and never gathered.
3. A bounded sample of paths gives splitters, each cut to the first turn in which it differs from the one
   before (``DEEPEST`` turns at most). All proper prefixes of splitters are the skeleton, and it is broadcast:
   at most ``MOST_SHARDS`` splitters of ``DEEPEST`` turns. Only its nodes can have members on both sides of a splitter.
4. Paths are dealt to shards by their place among the splitters and sorted. One pass over a shard with a stack finishes every
   other node; of skeleton nodes it gives partial aggregates.
5. Partial aggregates are reduced by node. What only whole skeleton nodes know (tokens saved at a node,
   children that are skeleton nodes) goes up to their ancestors in the skeleton, and the parents' ids go
   down to the finished nodes below.

Defined results: rows without conv_id are ignored; null role or text is empty, null turn comes first; turns with one
number are ordered by role, the text's first 64 code points, then digest, and all kept (repeated rows are repeated turns); a conversation whose turns all come from a
missing head has none and ends at the root; an empty table gives no nodes; other columns are ignored. A conversation is one
row of 22 bytes a turn. The ids of one conversation's copies are hashed in order by one task, as a digest of all must be,
but as a stream.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample, released, table, written

WIDTH = 22
CHUNK = 1 << 10
#: Turns of a splitter, shards, sampled paths a shard and paths a shard.
DEEPEST, MOST_SHARDS, SAMPLED, SHARD_PATHS = 64, 4096, 16, 50_000
HEADS, HEAD_TURNS = 100, 6
#: Code points of a text that order turns of one number and role, before the digest does.
TIE_CHARS = 64
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = "path binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, partial boolean"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id, turns: the 44 hexadecimal digits of each turn, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    mark = F.concat(F.md5(F.concat_ws(":", F.length(role), role, text)), F.lpad(F.lower(F.hex(F.length(text))), 12, "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), role.alias("role"), F.substring(text, 1, TIE_CHARS).alias("start"), mark.alias("mark")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["mark"]).alias("turns"))


def whole_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path of the conversations as they are."""
    return turn_lists(turns).select("conv_id", F.unhex(F.array_join("turns", "")).alias("path"))


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """conv_id, path of the conversations with the first turns (crc32 of the id modulo 6) of the one at the last hundred."""
    lists = written(turn_lists(turns))
    heads = lists.where(F.col("conv_id") % HEADS == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, HEAD_TURNS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS).cast("int")
    rows = lists.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % HEADS == F.col("head_id"), "left")
    first = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.unhex(F.array_join(F.concat(first, rest), "")).alias("path"))


def chunked_ids(paths: DataFrame) -> DataFrame:
    """path, chunk, n, first, ids: the members of a path with ids of one range, joined in order."""
    chunk = F.floor(F.col("conv_id") / CHUNK)
    found = paths.groupBy("path", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return found.select("path", "chunk", F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("first"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def splitters_of(paths: DataFrame, shards: int) -> list[bytes]:
    """At most shards - 1 strings that cut the paths into about equal shares, from a sample of fixed size a shard."""
    if shards < 2:
        return []
    short = paths.select(F.substring("path", 1, DEEPEST * WIDTH).alias("path"), F.xxhash64("path", "chunk").alias("key"))
    got = sorted(bytes(r.path) for r in hashed_sample(short, "key", SAMPLED * shards).select("path").collect())
    out, before = [], b""
    for k in range(1, shards):
        if got and (s := got[k * len(got) // shards]) > before:
            same = next((i for i in range(0, len(s), WIDTH) if s[i : i + WIDTH] != before[i : i + WIDTH]), len(s))
            out.append(s[: same + WIDTH])
            before = s
    return out


def skeleton_of(splitters: list[bytes]) -> frozenset[bytes]:
    return frozenset(s[:k] for s in [b"\0" * WIDTH, *splitters] for k in range(0, len(s), WIDTH))


class Node:
    """A node whose subtree is still being read."""

    __slots__ = ("path", "n", "first", "children", "leaves", "saved", "ends", "below")

    def __init__(self, path: bytes):
        self.path, self.n, self.first, self.children, self.leaves, self.saved, self.ends, self.below = path, 0, None, 0, 0, 0, None, []


class Walk:
    """Rows of nodes from sorted rows (path, n, first, ids); those of ``skeleton`` are partial.

    A finished node waits for its parent's smallest id; under a skeleton node it does not wait.
    """

    def __init__(self, skeleton: frozenset[bytes]):
        self.skeleton, self.open, self.out = skeleton, [], []

    def take(self, path: bytes, n: int, first: int, ids: str) -> None:
        if not self.open:
            self.open.append(Node(b""))
        while not path.startswith(self.open[-1].path):
            self.close()
        while len(self.open[-1].path) < len(path):
            self.open.append(Node(path[: len(self.open[-1].path) + WIDTH]))
        last = self.open[-1]
        last.n += n
        last.first = first if last.first is None else min(last.first, first)
        if last.ends is None:
            last.ends = hashlib.sha256()
        else:
            last.ends.update(b",")
        last.ends.update(ids.encode())

    def close(self) -> None:
        node = self.open.pop()
        depth, partial = len(node.path) // WIDTH, node.path in self.skeleton
        if not partial:
            node.leaves += not node.children
            node.saved += (node.n - 1) * int.from_bytes(node.path[-6:], "big")
        for row in node.below:
            row["parent_conv_id"] = node.first
            self.out.append(row)
        parent = self.open[-1] if self.open else None
        if parent is not None:
            parent.n += node.n
            parent.first = node.first if parent.first is None else min(parent.first, node.first)
            parent.children += not partial
            parent.leaves += node.leaves
            parent.saved += node.saved
        held = parent is None or parent.path in self.skeleton
        row = {"path": node.path if partial else None, "parent": parent.path if parent is not None and held else None, "depth": depth, "conv_id": node.first, "parent_conv_id": None, "n_convs": node.n}
        row |= {"n_children": node.children, "n_leaves": node.leaves, "saved": node.saved, "ends_sha256": node.ends.hexdigest() if node.ends else None, "partial": partial}
        (self.out if held else parent.below).append(row)

    def rows(self) -> list[dict]:
        out, self.out = self.out, []
        return out

    def end(self) -> list[dict]:
        while self.open:
            self.close()
        return self.rows()


def _shard(held):
    schema = pa.schema([("path", pa.binary()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")), ("ends_sha256", pa.string()), ("partial", pa.bool_())])

    def run(batches):
        walk = Walk(held.value[1])
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "n", "first", "ids")), strict=True):
                walk.take(*row)
            yield pa.RecordBatch.from_pylist(walk.rows(), schema)
        yield pa.RecordBatch.from_pylist(walk.end(), schema)

    return run


def placed(held):
    """A column function: the shard of a path, its place among the splitters."""

    @F.pandas_udf("int")
    def shard(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in paths:
            yield pd.Series([bisect_right(held.value[0], bytes(x)) for x in p], dtype="int32")

    return shard


def reduced(partial: DataFrame) -> DataFrame:
    """The skeleton's nodes, a row each: partial aggregates combined, then what they give their ancestors."""
    text = F.conv(F.hex(F.substring("path", -6, 6)), 16, 10).cast("long")
    nodes = partial.groupBy("path").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("ends_sha256").alias("ends_sha256")
    )
    nodes = written(nodes.withColumn("own", F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * text).otherwise(0)))
    up = nodes.select(F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"), "path", "depth", "own")
    given = up.groupBy(F.substring("path", F.lit(1), (F.col("d") * WIDTH).cast("int")).alias("above")).agg(
        F.sum("own").alias("more_saved"), F.sum((F.col("d") == F.col("depth") - 1).cast("long")).alias("more_children")
    )
    nodes = nodes.join(F.broadcast(given), F.col("path") == F.col("above"))
    parents = nodes.select(F.col("path").alias("over"), F.col("conv_id").alias("parent_conv_id"))
    cut = F.when(F.col("depth") > 0, F.substring("path", F.lit(1), ((F.col("depth") - 1) * WIDTH).cast("int")))
    return written(
        nodes.join(F.broadcast(parents), cut == F.col("over"), "left").select(
            "path", "depth", "conv_id", "parent_conv_id", "n_convs", (F.col("n_children") + F.col("more_children")).alias("n_children"), "n_leaves", (F.col("saved") + F.col("more_saved")).alias("saved"), "ends_sha256"
        )
    )


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """RESULT for every node of the trie of ``paths`` (conv_id, path)."""
    spark = paths.sparkSession
    rows = written(chunked_ids(paths))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // SHARD_PATHS)
    shards = min(shards or wanted, MOST_SHARDS)
    splitters = splitters_of(rows, shards)
    held = spark.sparkContext.broadcast((splitters, skeleton_of(splitters)))
    dealt = rows.withColumn("shard", placed(held)("path")).repartitionByRange(len(splitters) + 1, "shard").sortWithinPartitions("path", "chunk")
    nodes = written(dealt.select("path", "n", "first", "ids").mapInArrow(released(_shard(held)), NODES))
    skeleton = reduced(nodes.where("partial").select("path", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"))
    over = F.broadcast(skeleton.select(F.col("path").alias("over"), F.col("conv_id").alias("over_id")))
    whole = nodes.where("not partial").join(over, F.col("parent") == F.col("over"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over_id"))
    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return whole.select(*columns).unionByName(skeleton.select(*columns)).select(*RESULT)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head_id,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda s, i: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.head_id WHERE k <= h
  UNION ALL
  SELECT c.conv_id, k, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE k > h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, md5(length(role) || ':' || role || ':' || text) AS m, length(text) AS chars FROM r),
p AS (
  SELECT conv_id, 0 AS d, '' AS path, 0 AS chars FROM c
  UNION ALL
  SELECT conv_id, d, string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d), chars FROM s),
e AS (SELECT conv_id, max(d) AS ends FROM p GROUP BY conv_id),
n AS (
  SELECT path, d AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE ends = d), '')) AS ends_sha256
  FROM p JOIN e ON p.conv_id = e.conv_id GROUP BY path, d),
k AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
u AS (
  SELECT left(n.path, 32 * CAST(unnest(range(0, depth + 1)) AS INTEGER)) AS path, CASE WHEN k.path IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved
  FROM n LEFT JOIN k ON n.path = k.path),
a AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY path)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN a ON n.path = a.path LEFT JOIN k ON n.path = k.path
LEFT JOIN n q ON n.depth > 0 AND q.path = left(n.path, greatest(length(n.path) - 32, 0))
"""
}
