"""Similarity join of documents on sets of word n-grams by a grouped prefix join.

1. Documents with the same set form one class; the smallest doc_id represents it.
2. Prefilter. With tokens (shingle hashes) in hash order, two sets of Jaccard >= t share at least l
   tokens among their first n - ceil(t n) + l. A class stays only if that many of its prefix tokens
   occur in a second document's prefix. This removes most of a corpus at the price of counting a part
   of its shingles.
3. For the classes left, all tokens are counted and ordered by frequency, then hash. Tokens of one
   set only cannot be shared; with k shared ones a class is dropped if k < ceil(t n), else its
   prefix is the first k - ceil(t n) + 1 of them.
   Before rows are shuffled to the counts they meet, bit filters of fixed size (``bits``) drop those
   that cannot meet any; a filter that would be too full to help is left out, and the plain join serves.
4. Classes with the same prefix and size are one group. Groups meet through the tokens of their
   prefixes, filtered by size and by the overlap their positions still allow. First only with the
   token's pivot group (the one with the fewest unshared tokens): a number of pairs linear in
   the postings. Members are expanded, verified on whole sets, and linked ones become components.
   Then every remaining pair of groups is taken, but only between different components, and verified the same
   way. Pairs inside a component need no check, so a large group of near copies costs one pass; no
   link between components is lost.

Sets, classes and links are known by their content, not by doc_id: a doc_id with several texts has a set for
each, and they are linked only through their own links.

Defined results: null or blank text has an empty set and is linked with nothing; texts with fewer
words than n have one shingle; of a component the filter keeps the rows of its smallest doc_id with one set and text (equal
rows repeated with it stay together); a null doc_id is linked
through equal sets only (component_id of its class; null if no member has an id); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .common import released, slices, table, text_of, written
from .graph import components
from .hashing import shingles, text_words


class Similarity:
    """Jaccard >= num/den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least_overlap(self, n: str) -> Column:
        """ceil(t n): what any partner of a set of size n shares with it at least."""
        return F.expr(f"cast(({self.num} * {n} + {self.den - 1}) div {self.den} as int)")

    def pair_overlap(self, a: str, b: str) -> Column:
        whole = self.num + self.den
        return F.expr(f"cast(({self.num} * ({a} + {b}) + {whole - 1}) div {whole} as int)")

    def sizes_fit(self, a: str, b: str) -> Column:
        return F.expr(f"{self.den} * least({a}, {b}) >= {self.num} * greatest({a}, {b})")


def _sets(k: int, prefix: tuple[int, int] | None, ids=None):
    """doc_id, mark, n, d1, d2 and the first tokens (with ``prefix``) or all of them; of the ``ids`` only."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            if ids is not None:
                known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(known & bits.test(ids.value, b.column(0).fill_null(0).to_numpy())))
            for lo, end in slices(b.column(1), 256):
                part = b.slice(lo, end - lo)
                texts = [t.encode() for t in part.column(1).to_pylist()]
                n, digests, tokens = [], [], []
                for _, docs in text_words(texts):
                    for words in docs:
                        own = shingles(words, k)
                        n.append(len(own))
                        digests.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64))
                        if prefix:
                            num, den = prefix
                            own = own[: len(own) - -(-num * len(own) // den) + 1 + len(own) // SPARE]
                        tokens.append(own)
                d = np.array(digests, np.int64).reshape(-1, 2)
                columns = [part.column(0), part.column(2), pa.array(n, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), lists(tokens)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


#: One more shared token is asked for in the prefilter per so many tokens of a set.
SPARE = 20
SETS = "doc_id long, mark long, n int, d1 long, d2 long, tokens array<long>"


def sets_of(docs: DataFrame, k: int, prefix: tuple[int, int] | None = None, ids=None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ids) if ids is not None else None
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), mark_of()).mapInArrow(released(_sets(k, prefix, held)), SETS)


def mark_of() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text_of()).alias("mark")


def _only_shared(held, num: int, den: int):
    """Rows (key, n, tokens) with tokens that may be shared; without rows that have too few."""

    def run(batches):
        for b in batches:
            tokens = b.column(2)
            flat, ends = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(tokens.value_lengths().fill_null(0).to_numpy())])
            hit = bits.test(held.value, flat)
            sums = np.concatenate([[0], np.cumsum(hit)])
            left = sums[ends[1:]] - sums[ends[:-1]]
            n = b.column(1).to_numpy()
            enough = left >= (-(-num * n.astype(np.int64) // den) if num else 1)
            rows = np.repeat(enough, np.diff(ends)) & hit
            kept = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left[enough])]).astype(np.int32)), pa.array(flat[rows]))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(enough)), b.column(1).filter(pa.array(enough)), kept], names=b.schema.names)

    return run


def only_shared(rows: DataFrame, shared: DataFrame, num: int = 0, den: int = 1) -> DataFrame:
    """``rows`` (key, n, tokens) without tokens outside ``shared`` (token), as far as a bit filter tells."""
    filled = bits.filled(shared)
    if filled is None:
        return rows
    held = rows.sparkSession.sparkContext.broadcast(filled)
    return rows.mapInArrow(released(_only_shared(held, num, den)), rows.schema)


def possible_ids(heads: DataFrame, t: Similarity) -> DataFrame:
    """doc_id, d1, d2 of the sets that pass the prefilter; their classes' representatives are among them.

    Rows of one set are grouped by the document, not by the token they were joined on, so Spark can
    split the join of a frequent token.
    """
    rows = heads.where("n > 0 and doc_id is not null").select(F.struct("doc_id", "d1", "d2").alias("set"), "n", "tokens")
    shared = written(rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token"))
    met = only_shared(rows, shared).select("set.*", "n", F.explode("tokens").alias("token")).join(shared, "token")
    counts = met.groupBy("doc_id", "d1", "d2").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("met"))
    return counts.where(F.col("met") >= 1 + F.expr(f"({t.num} * n + {t.den - 1}) div {t.den} div {SPARE}")).select("doc_id", "d1", "d2")


def frequency_prefixes(sets: DataFrame, t: Similarity) -> DataFrame:
    """doc_id, n, k and the prefix in frequency order, of sets that can still have a partner."""
    often = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    often = written(often.where("df > 1"))
    rows = only_shared(sets, often.select("token"), t.num, t.den).select("doc_id", "n", F.explode("tokens").alias("token"))
    core = rows.join(often, "token").groupBy("doc_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("core"))
    core = core.withColumn("k", F.size("core")).where(F.col("k") >= t.least_overlap("n"))
    prefix = F.transform(F.slice("core", F.lit(1), F.col("k") - t.least_overlap("n") + 1), lambda c: c["token"])
    return core.select("doc_id", "n", "k", prefix.alias("prefix"))


def verified(pairs: DataFrame, sets: DataFrame, t: Similarity) -> DataFrame:
    """Links (a, b) among the candidate ``pairs`` (a, b), checked on whole sets."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    rows = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("ta") + F.size("tb")).alias("sum"))
    return rows.where(F.expr(f"{t.den} * both >= {t.num} * (sum - both)")).select("a", "b")


def overlap_allowed(t: Similarity) -> Column:
    """Sizes fit, and the tokens from the shared one on suffice (sides 1 and 2)."""
    return t.sizes_fit("n1", "n2") & (F.expr("least(k1 - i1, k2 - i2)") >= t.pair_overlap("n1", "n2"))


def side(postings: DataFrame, k: int) -> DataFrame:
    return postings.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("group", "comp", "n", "k", "i") if c in postings.columns))


def linked(sets: DataFrame, t: Similarity) -> DataFrame:
    """(v, comp) of the sets that are linked with others."""
    members = frequency_prefixes(sets, t)
    members = written(members.withColumn("group", F.xxhash64("n", "prefix")))
    groups = written(members.groupBy("group").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("prefix").alias("prefix"), F.min("doc_id").alias("first")))
    postings = groups.select("group", "n", "k", F.posexplode("prefix").alias("i", "token"))
    best = F.min_by("group", F.struct((F.col("n") - F.col("k")) / F.col("n"), "group")).alias("group")
    pivots = postings.groupBy("token").agg(best, F.count(F.lit(1)).alias("many")).where("many > 1").select("token", "group")
    pivots = written(pivots.join(postings, ["token", "group"]))
    near = side(pivots, 1).join(side(postings, 2), "token").where(overlap_allowed(t)).select("group1", "group2").distinct()
    near = near.where("group1 <> group2").union(groups.select(F.col("group").alias("group1"), F.col("group").alias("group2")))
    first = groups.select(F.col("group").alias("group1"), F.col("first").alias("a"))
    second = members.select(F.col("group").alias("group2"), F.col("doc_id").alias("b"))
    pairs = near.join(first, "group1").join(second, "group2").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = written(verified(written(pairs), sets, t))
    comps = components(found)
    rest = remaining_pairs(members, groups, comps, t)
    more = written(verified(rest, sets, t))
    return comps if more.isEmpty() else components(found.union(more))


def remaining_pairs(members: DataFrame, groups: DataFrame, comps: DataFrame, t: Similarity) -> DataFrame:
    """Candidate pairs of members of different components.

    Of each token, the component with the most cells (group and component) is the major one; its
    cells are only met by cells of others, so the pairs inside it are never made.
    """
    cells = members.join(comps, members["doc_id"] == comps["v"], "left").withColumn("comp", F.coalesce("comp", "doc_id")).select("doc_id", "group", "comp")
    cells = written(cells)
    shapes = groups.select("group", "n", "k", F.posexplode("prefix").alias("i", "token"))
    postings = cells.select("group", "comp").distinct().join(shapes, "group")
    sizes = postings.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("many"))
    major = sizes.groupBy("token").agg(F.max_by("comp", F.struct("many", "comp")).alias("major"), F.count(F.lit(1)).alias("kinds"))
    postings = written(postings.join(major.where("kinds > 1"), "token").withColumn("minor", F.col("comp") != F.col("major")))
    one = side(postings.where("minor"), 1)
    two = side(postings, 2).join(postings.select("token", F.col("group").alias("group2"), F.col("comp").alias("comp2"), F.col("minor").alias("minor2")), ["token", "group2", "comp2"])
    apart = (F.col("comp1") != F.col("comp2")) & (~F.col("minor2") | (F.struct("comp1", "group1") < F.struct("comp2", "group2")))
    met = one.join(two, "token").where(apart & overlap_allowed(t)).select("group1", "comp1", "group2", "comp2").distinct()
    a = cells.select(F.col("doc_id").alias("a"), F.col("group").alias("group1"), F.col("comp").alias("comp1"))
    b = cells.select(F.col("doc_id").alias("b"), F.col("group").alias("group2"), F.col("comp").alias("comp2"))
    return written(met.join(a, ["group1", "comp1"]).join(b, ["group2", "comp2"]).select("a", "b"))


def set_key(several: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, d1, d2) with the key of the set: its doc_id, or a hash where the doc_id (of ``several``) has other sets too."""
    known = rows.join(several, rows["doc_id"] == several["several_id"], "left")
    return known.withColumn("key", F.when(F.col("several_id").isNull(), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "d1", "d2"))).drop("several_id")


def in_classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, mark, n, class_id, component_id, and whether the row is the one that stays, for every document."""
    t = Similarity(num, den)
    heads = written(sets_of(docs, k, (num, den)))
    full = heads.where("n > 0")
    several = full.where("doc_id is not null").groupBy(F.col("doc_id").alias("several_id")).agg(F.min(F.struct("d1", "d2")).alias("one"), F.max(F.struct("d1", "d2")).alias("other"))
    several = written(several.where("one <> other").select("several_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark")).alias("first")
    classes = full.groupBy("d1", "d2").agg(first).select("d1", "d2", "first", F.col("first.doc_id").alias("doc_id"))
    classes = written(set_key(several, classes))
    chosen = classes.where("doc_id is not null").select("key", "doc_id", "d1", "d2")
    chosen = written(chosen.join(possible_ids(heads, t), ["doc_id", "d1", "d2"], "left_semi"))
    ids = bits.filled(chosen.select("doc_id"))
    few = docs if ids is not None else docs.join(chosen.select(F.col("doc_id").alias("__id")).distinct(), docs["doc_id"] == F.col("__id"), "left_semi")
    rows = set_key(several, sets_of(few, k, ids=ids))
    # Rows of one key have one set. What a full bit lets pass by chance is the set of a class that it does no harm to.
    odd = chosen.join(several, chosen["doc_id"] == several["several_id"], "left_semi").select(F.col("key").alias("odd"))
    sets = written(rows.join(several, rows["doc_id"] == several["several_id"], "left_anti").unionByName(rows.join(written(odd), F.col("key") == F.col("odd"), "left_semi")).select(F.col("key").alias("doc_id"), "n", "tokens"))
    if sets.groupBy("doc_id").count().where("count > 1").limit(1).count():
        sets = written(sets.dropDuplicates(["doc_id"]))
    comps = linked(sets, t)
    classes = written(classes.join(comps, classes["key"] == comps["v"], "left").select("d1", "d2", "first", "comp"))
    grouped, alone = classes.where("comp is not null"), classes.where("comp is null")
    tops = written(grouped.groupBy(F.col("comp").alias("top")).agg(F.min("first").alias("best")))
    grouped = grouped.join(tops, F.col("comp") == F.col("top")).select("d1", "d2", F.col("first.doc_id").alias("class_id"), "best")
    classes = grouped.unionByName(alone.select("d1", "d2", F.col("first.doc_id").alias("class_id"), F.col("first").alias("best")))
    rows = heads.drop("tokens").join(written(classes), ["d1", "d2"], "left")
    stays = F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("mark") == F.col("best.mark")))
    return rows.select("doc_id", "mark", "n", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("best.doc_id", "doc_id").alias("component_id"), stays.alias("stays"))


def ngram_components(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every document."""
    return in_classes(docs, k, num, den).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class_id", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component, columns as they were."""
    gone = in_classes(docs, k, num, den).where("not stays").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    return docs.join(written(gone), docs["doc_id"].eqNullSafe(F.col("__gone")) & (mark_of() == F.col("__mark")), "left_anti")


def op10_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id", "class_id")


QUERIES = {"op10_ngram_join": op10_ngram_join}
SQL = {}
