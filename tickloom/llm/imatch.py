r"""I-Match fingerprints with randomised lexicon subsets, in DataFrame functions only.

Terms are words with A-Z lower-cased, known by a 64-bit hash. The document frequency of every term is
counted over all texts; the lexicon is the band of terms whose relative inverse document frequency,
ln(N/df)/ln(N), lies between ``band`` (so it scales with the corpus). All distinct terms of a text and of
its edited text that are in the lexicon are sorted and hashed once per randomised lexicon subset.

The subsets are the same for all texts: ``GROUPS`` groups, each a random two thirds of the whole lexicon (a term is in some
sixteen of them), and in each group a ladder of ``RUNGS`` random subsets, every one a quarter of the one before. A
long text finds few of its terms in the sparse rungs, a short one in the dense ones, so both have subsets that an
edit leaves alone. A fingerprint lists, group by group, the hashes of the rungs that hold a term (a rung without one ends
its ladder); texts that differ in one lexicon term differ in it. Where no subset holds a term of a text, it is a hash of
all its sorted terms.

The likeness of two fingerprints is taken at the sparsest rung that at least half of the groups use in
one of them (else the first): with Z the share of groups that are empty in both and E the share of
groups that are equal (empty ones too), it is 1 - ln(E)/ln(Z), which estimates the Jaccard similarity of
the lexicon terms whatever the rung's density. Equal fingerprints have likeness 1, fingerprints without
a common hash 0.

Terms meet the lexicon where the texts are: a lexicon of ``SENT_TERMS`` terms at most (its size is counted) is sent to the
tasks, and a document's terms are put together again in the task that took them apart. A larger one meets them by a
shuffled join, which Spark can split for frequent terms.

The next document (by descending doc_id) is found in buckets of the id's quantiles, a frequent id's (and
null's) bucket being split by the texts' hash; each bucket gets the head of the next one as an
additional row. Whole texts are shuffled once, for this. The additional row gets its fingerprint too, so the
next document's fingerprint is found in the bucket as well, and no fingerprint is written or joined.

Defined results: null text is empty, has no terms and the fingerprint of no terms; a null doc_id comes
after all others; rows repeated with one doc_id follow each other in the order of a hash of their text;
a table of one row is its own next document; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, ascii_lower, table, text_of, written

GROUPS = 24
RUNGS = 9
DIGITS = 4
SENT_TERMS = 1 << 21
BAND = (0.2, 0.95)
BUCKET_ROWS = 500
MOST_BUCKETS = 16_384
MOST_PARTS = 1 << 15  # more than MOST_BUCKETS, with which bucket numbers stay below 2^30


def terms_of(text: Column) -> Column:
    """Hashes of the distinct words."""
    words = F.transform(F.split(ascii_lower(text), BLANK + "+"), lambda t: F.xxhash64(t))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))


def lexicon(terms: DataFrame, rows: int, band: tuple[float, float]) -> DataFrame:
    """The terms (one row a document and term) inside the band."""
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = (F.lit(math.log(max(rows, 2))) - F.log("df")) / F.lit(math.log(max(rows, 2)))
    return counts.where((idf >= band[0]) & (idf <= band[1])).select("term")


def bounds_of(base: DataFrame, rows: int) -> tuple[list[int], list[int]]:
    """(bounds of the id buckets, number of parts of each bucket); the first part number is that of null."""
    buckets = min(MOST_BUCKETS, rows // BUCKET_ROWS)
    if buckets < 2:
        return [], [1, 1]
    shares = [k / buckets for k in range(1, buckets)]
    found = Counter(int(x) for x in base.approxQuantile("doc_id", shares, 0.25 / buckets))
    nulls = base.where("doc_id is null").count()
    parts = {}
    for bound, n in found.items():  # an id on several quantiles gets a bucket of its own, in parts
        parts[bound] = max(n, parts.get(bound, 1))
        if n > 1:
            parts.setdefault(bound + 1, 1)
    bounds = sorted(parts)
    return bounds, [1 + nulls * buckets // max(rows, 1), 1, *(parts[b] for b in bounds)]


def bucket_of(bounds: list[int], doc_id: Column) -> Column:
    """The number of bounds at or below the id, by binary search; -1 for null."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    held = F.lit(bounds).cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    at = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= doc_id, at + s).otherwise(at))
    return F.when(doc_id.isNull(), -1).otherwise(at)


def down_ids():
    """Window over a bucket by descending doc_id, the head of the next bucket last."""
    return Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("text_key"))


def with_next(docs: DataFrame, heads_stay: bool = False) -> DataFrame:
    """bucket, doc_id, text_key, text, next (doc_id, text_key, text) by descending doc_id, around the end.

    With ``heads_stay`` the additional rows (extra = 1, without a next) are returned too.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    bounds, parts = bounds_of(base, base.count())
    base = base.withColumn("id_bucket", bucket_of(bounds, F.col("doc_id")))
    many = F.get(F.lit(parts).cast("array<int>"), F.col("id_bucket") + 1)
    part = F.floor((F.col("text_key").cast("double") / 2.0**64 + 0.5) * many).cast("int")
    base = base.withColumn("bucket", (F.col("id_bucket") + 1) * MOST_PARTS + F.least(part, many - 1)).drop("id_bucket")
    heads = base.groupBy("bucket").agg(F.max(F.struct("doc_id", "text_key")).alias("head"))
    down = Window.orderBy(F.desc("bucket"))  # one row a bucket
    first = F.first("bucket").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.withColumn("after", F.coalesce(F.lead("bucket").over(down), first))
    before = heads.select(F.col("bucket").alias("to"), F.col("after").alias("from"))
    heads = heads.select(F.col("bucket").alias("from"), F.col("head.doc_id").alias("h_id"), F.col("head.text_key").alias("h_key")).join(before, "from")
    heads = written(heads)
    tails = base.join(F.broadcast(heads), (F.col("bucket") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")))
    tails = tails.select("doc_id", "text", "text_key", F.col("to").alias("bucket"), F.lit(1).alias("extra")).dropDuplicates(["bucket"])
    both = base.withColumn("extra", F.lit(0)).select("doc_id", "text", "text_key", "bucket", "extra").unionByName(tails)
    both = both.withColumn("next", F.lead(F.struct("doc_id", "text_key", "text")).over(down_ids()))
    return both if heads_stay else both.where("extra = 0").drop("extra")


def fingerprint(left_out: int, whole: str) -> Column:
    """Of the terms in ``kept`` but those of one side; where there is none in any subset, ``whole``.

    A group has a hash of its own for each term: a third of them (its remainder by 3, here 0) is dropped, and the pairs of zero bits at
    its end tell the term's last rung.
    """

    def rungs(held, k):
        """The hash of the terms on rung ``k``, and those of the sparser rungs until one is empty."""
        shown = F.substring(F.concat(F.lit("0" * DIGITS), F.hex(F.xxhash64(held))), -DIGITS, DIGITS)
        if k == RUNGS - 1:
            return shown
        sparser = F.filter(held, lambda h: h.bitwiseAND(F.lit((1 << 2 * (k + 1)) - 1).cast("long")) == 0)
        return F.concat(shown, let(sparser, lambda held: F.when(F.size(held) > 0, F.concat(F.lit(","), rungs(held, k + 1))).otherwise("")))

    def by_group(terms):
        return F.array(*(F.array_remove(terms[f"h{g}"], F.lit(0).cast("long")) for g in range(GROUPS)))

    groups = let(F.filter("kept", lambda x: x["side"] != left_out), by_group)
    ladders = F.array_join(F.transform(groups, lambda held: F.when(F.size(held) > 0, rungs(held, 0)).otherwise("")), ".")
    return let(ladders, lambda x: F.when(x != "." * (GROUPS - 1), x).otherwise(F.col(whole)))


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def likeness(a: str, b: str) -> Column:
    """Of two fingerprints, see the module's text."""
    ladders = lambda x: F.transform(F.split(x, r"\."), lambda g: F.split(g, ","))

    def rungs(both):
        def at(k):
            hashes = F.transform(both, lambda p: F.struct(F.coalesce(F.get(p["x"], k), F.lit("")).alias("x"), F.coalesce(F.get(p["y"], k), F.lit("")).alias("y")))
            used = lambda hashes: F.filter(hashes, lambda p: (p["x"] != "") | (p["y"] != ""))
            return let(used(hashes), lambda used: F.struct(F.size(used).cast("double").alias("used"), F.size(F.filter(used, lambda p: p["x"] == p["y"])).cast("double").alias("same")))

        return F.transform(F.sequence(F.lit(0), F.lit(RUNGS - 1)), at)

    def sparsest(rungs):
        return F.aggregate(rungs, F.get(rungs, F.lit(0)), lambda best, r: F.when(r["used"] >= GROUPS / 2, r).otherwise(best))

    def value(pick):
        empty = F.greatest(F.lit(GROUPS) - pick["used"], F.lit(0.5))
        equal = F.greatest(F.lit(GROUPS) - pick["used"] + pick["same"], F.lit(0.5))
        share = 1 - F.log(equal / GROUPS) / F.log(empty / GROUPS)
        return F.when(pick["same"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))))

    both = F.arrays_zip(ladders(a).alias("x"), ladders(b).alias("y"))
    share = let(both, lambda both: let(rungs(both), lambda rungs: let(sparsest(rungs), value)))
    none = F.startswith(F.col(a), F.lit("=")) | F.startswith(F.col(b), F.lit("="))
    return F.when(F.col(a) == F.col(b), 1.0).when(none, 0.0).otherwise(share).cast("double")


def term_items(docs: DataFrame) -> DataFrame:
    """bucket, row, meta, items: of each document one item without a term, and one for each term of text (side 1), edited text (2) or both (3).

    The heads of the next buckets are among them (extra = 1), with an empty edited text.
    """
    pairs = with_next(docs, heads_stay=True).withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.substring(F.col("next.text"), F.lit(1), third))
    pairs = pairs.withColumn("edited", F.when(F.col("extra") == 0, edited).otherwise(""))
    pairs = pairs.withColumn("own", terms_of(F.col("text"))).withColumn("other", terms_of(F.col("edited")))
    whole = lambda terms: F.concat(F.lit("="), F.hex(F.xxhash64(F.sort_array(terms))))
    meta = F.struct(
        "extra", "doc_id", "text_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("next.doc_id").alias("next_id"), whole("own").alias("own_whole"), whole("other").alias("other_whole")
    )
    pairs = pairs.select("bucket", F.monotonically_increasing_id().alias("row"), meta.alias("meta"), "own", "other")
    item = lambda side, terms: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(side).alias("side")))
    terms = F.concat(F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(0).alias("side"))), item(1, F.array_except("own", "other")), item(2, F.array_except("other", "own")), item(3, F.array_intersect("own", "other")))
    return pairs.select("bucket", "row", "meta", terms.alias("items"))


def with_lexicon_terms(items: DataFrame, words: DataFrame, sent: bool) -> DataFrame:
    """bucket, what is in meta, and the sorted lexicon terms ``kept`` of every document: term, side and h0, h1 ..., its hash in each group (0: dropped).

    Rows are dealt by bucket already, so without a shuffled join nothing moves. The hashes are taken of rows, which Spark compiles, and
    not in arrays, where it walks an expression for each of them; the rows are sorted before they have them. Only the document's own
    item has terms one after its place, so only it gets a list.
    """
    if not sent:
        items = written(items)
    known = words.select("term", F.lit(True).alias("known"))
    first = F.when(F.col("x.side") == 0, F.col("meta"))
    rows = items.select("bucket", "row", "meta", F.explode_outer("items").alias("x")).select("bucket", "row", first.alias("meta"), "x.term", "x.side")
    met = rows.join(F.broadcast(known) if sent else known, "term", "left").where("side = 0 or known")
    if not sent:
        met = met.repartition("bucket")
    met = met.select("bucket", "row", "meta", "term", "side", (F.col("side") > 0).cast("int").alias("place"))
    met = met.sortWithinPartitions("bucket", "row", "place", "term")
    met = met.select("*", *(F.xxhash64(F.lit(g), "term").alias(f"h{g}") for g in range(GROUPS)))
    kept = (F.when(F.col(f"h{g}") % 3 != 0, F.col(f"h{g}")).otherwise(0).alias(f"h{g}") for g in range(GROUPS))
    met = met.select("bucket", "row", "meta", "place", F.struct("term", "side", *kept).alias("x"))
    terms = Window.partitionBy("bucket", "row").orderBy("place").rangeBetween(1, 1)
    out = met.withColumn("kept", F.collect_list("x").over(terms)).where("place = 0")
    return out.select("bucket", "meta.*", F.sort_array("kept").alias("kept"))


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id."""
    terms = docs.select(F.explode_outer(terms_of(text_of())).alias("term")).where("term is not null")
    words = written(lexicon(terms, docs.count(), band))
    rows = with_lexicon_terms(term_items(docs), words, words.count() <= SENT_TERMS)
    prints = [fingerprint(2, "own_whole").alias("fingerprint"), fingerprint(1, "other_whole").alias("edited_fingerprint")]
    out = rows.select("bucket", "extra", "doc_id", "text_key", "n_chars", "edited_sha256", *prints, "next_id")
    out = out.withColumn("next_fingerprint", F.lead("fingerprint").over(down_ids())).where("extra = 0")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        "next_id",
    )


def op8_imatch(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op8_imatch": op8_imatch}
