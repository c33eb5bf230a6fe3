"""Language-model scores: a gated recurrent network with a class-factored softmax.

1. Words of the training documents (crc32 of the doc_id's text modulo 7 is not 2) are counted over the
   whole corpus, with one end token a document. N, V and the base score come from these counts.
2. The most frequent words (``LISTED`` at most, by a threshold on the count) are held in every task; the
   network's own vocabulary is the first ``VOCABULARY`` of them, the end token, and one token for all
   other words, whose probability is shared out among them by their add-one smoothed counts.
3. Training texts are dealt to shards by a hash. The network is trained in rounds, each on its own shards:
   every shard trains a copy by truncated back-propagation on all windows of each of its texts, the state
   carried through the text, and the copies are averaged by their number of words in Spark. So each
   window of each training text is learnt from once. A task holds a block of texts (``BLOCK_WORDS`` words, or
   one longer text) and one set of parameters.
4. Every whole text is scored, the state carried through its windows to its end. Words outside the list
   are looked up in the counts by a join that Spark can split.

Words are known by 64-bit hashes of their bytes (A-Z lower-cased).

Defined results: null text is empty (one end token); a null doc_id has the text '' for the split and
stays null; rows repeated with one doc_id are documents of their own; without training documents
N = V = 0 and the network's distribution is even; very long texts are scored to their end; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import released, slices, table, text_of, written
from .hashing import text_words

LISTED = 1 << 18
VOCABULARY = 2046
CLASSES = 32
RATES = (0.02, 0.01, 0.005)
END = np.uint64(0xE4D0E4D0E4D0E4D0)
PART_WORDS = 1 << 21
SHARD_WORDS = 1 << 22
BLOCK_WORDS = 1 << 22
UNITS = 1 << 20  # of a parameter, when it is averaged


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _count(batches):
    held, n = [], 0

    def out():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    for b in batches:
        for lo, end in slices(b.column(0)):
            texts = [t.encode() for t in b.column(0).slice(lo, end - lo).to_pylist()]
            for _, docs in text_words(texts):
                held += docs
                n += sum(map(len, docs))
            held.append(np.full(len(texts), END))
            n += len(texts)
            if n > PART_WORDS:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: the tokens of the training documents."""
    parts = docs.where(~held_out()).select(text_of().alias("text")).mapInArrow(released(_count), "h long, c long")
    return parts.groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the most frequent words, at most ``most``, in order of frequency."""
    level = F.floor(F.log2("c") * 16).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 1,024 levels
    least, sum_ = 1 << 30, 0
    for r in sorted(bins, key=lambda r: -r.level):
        sum_ += r.n
        if sum_ > most:
            break
        least = r.level
    rows = counts.where(level >= least).toArrow()
    h, c = rows["h"].to_numpy(), rows["c"].to_numpy()
    order = np.lexsort((h, -c))
    return h[order].view(np.uint64), c[order]


class Vocabulary:
    """The listed words with their counts, and their numbers in the network (broadcast)."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int):
        order = np.argsort(h)
        self.names, self.counts = h[order], c[order]
        kept = [i for i in range(min(len(h), VOCABULARY)) if h[i] != END]
        ends = int(c[h == END].sum())
        inside = int(sum(c[i] for i in kept))
        words = [(int(c[i]), int(h[i])) for i in kept] + [(ends, int(END)), (max(total - inside - ends, 0), -1)]
        words.sort(key=lambda w: (-w[0], w[1]))
        number = {w: k for k, (_, w) in enumerate(words)}
        self.other, self.end = number[-1], number[int(END)]
        self.number = np.array([number.get(int(x), self.other) for x in self.names], np.int32)
        self.layout = gru.Layout(np.array([w[0] for w in words], float), CLASSES)
        self.total, self.distinct = total, distinct
        self.other_mass = max(total - inside - ends, 0) + max(distinct - len(kept) - (ends > 0), 0) + 1

    def look_up(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, counts, listed) of hashed words."""
        if not len(self.names):
            return np.full(len(words), self.other, np.int32), np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        listed = self.names[at] == words
        return np.where(listed, self.number[at], self.other), np.where(listed, self.counts[at], 0), listed


NUMBERED = "row long, doc_id long, out boolean, shard long, place long, n_tokens long, listed_known long, listed_sum double, other_sum double, other_rare long, ids binary, rare array<long>"


def _numbered(held):
    """The word numbers of each text with its end, what its listed words add to the scores, and its other words' hashes."""
    names = [c.split()[0] for c in NUMBERED.split(", ")]
    types = {"ids": pa.binary(), "rare": pa.list_(pa.int64()), "listed_sum": pa.float64(), "other_sum": pa.float64()}

    def run(batches):
        vocabulary = held.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, end in slices(b.column(4)):
                part, columns = b.slice(lo, end - lo), {k: [] for k in names}
                for _, docs in text_words([t.encode() for t in part.column(4).to_pylist()]):
                    for words in docs:
                        words = np.append(words, END)
                        number, count, listed = vocabulary.look_up(words)
                        number[-1] = vocabulary.end
                        other = number == vocabulary.other
                        logs = np.log10(count + 1.0)
                        columns["n_tokens"].append(len(words))
                        columns["listed_known"].append(int((count > 0).sum()))
                        columns["listed_sum"].append(float(logs.sum()))
                        columns["other_sum"].append(float(logs[other].sum()))
                        columns["other_rare"].append(int(other.sum()))
                        columns["ids"].append(number.astype("<u2").tobytes())
                        columns["rare"].append(words[~listed].view(np.int64))
                columns["row"] = np.arange(row, row + part.num_rows)
                row += part.num_rows
                own = dict(zip(("doc_id", "out", "shard", "place"), part.columns[:4], strict=True))
                yield pa.RecordBatch.from_arrays([own[k] if k in own else pa.array(columns[k], types.get(k, pa.int64())) for k in names], names=names)

    return run


def shards_of(vocabulary: Vocabulary) -> int:
    return len(RATES) * max(1, -(-vocabulary.total // (len(RATES) * SHARD_WORDS)))


def numbered(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All documents as ``NUMBERED``; shards and places in them are hashes of a row's doc_id and text."""
    key = [F.col("doc_id").cast("long"), text_of()]
    shard, place = F.pmod(F.xxhash64(*key), F.lit(shards_of(vocabulary))), F.xxhash64(F.lit(7), *key)
    rows = docs.select(key[0].alias("doc_id"), held_out().alias("out"), shard.alias("shard"), place.alias("place"), key[1].alias("text"))
    return written(rows.mapInArrow(released(_numbered(docs.sparkSession.sparkContext.broadcast(vocabulary))), NUMBERED))


def _trained(held, rate: float, turn: int):
    """A network for each shard; the rows of a shard come one after another, in their order."""

    def out(trainer, shard):
        n = float(trainer.words)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([trainer.flat.tolist()], pa.list_(pa.float32())), pa.array([n])], names=["shard", "p", "n"])

    def run(batches):
        vocabulary, flat = held.value
        trainer, shard, texts, n = None, None, [], 0
        for b in batches:
            for s, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if s != shard or n >= BLOCK_WORDS:
                    if trainer:
                        trainer.learn(texts)
                        texts, n = [], 0
                    if s != shard:
                        if trainer:
                            yield out(trainer, shard)
                        trainer, shard = gru.Trainer(vocabulary.layout, flat, rate, seed=turn * 100_003 + s), s
                texts.append(np.frombuffer(data.as_py(), "<u2"))
                n += len(texts[-1])
        if trainer:
            trainer.learn(texts)
            yield out(trainer, shard)

    return run


def train(rows: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The network's parameters: every training text is read once, in the round of its shard.

    Shards hold about ``SHARD_WORDS`` words each, and neither they nor the order inside them depend on how
    the table is laid out. After each round the copies of its shards are averaged by their words, in
    whole numbers, so that the order of adding does not count either.
    """
    flat, context = vocabulary.layout.first(), rows.sparkSession.sparkContext
    rounds, shards = len(RATES), shards_of(vocabulary)
    for turn, rate in enumerate(RATES):
        held = context.broadcast((vocabulary, flat))
        own = rows.where(~F.col("out") & (F.col("shard") % rounds == turn)).select("shard", "place", "ids")
        own = own.repartition(shards // rounds, "shard").sortWithinPartitions("shard", "place", "ids")
        parts = own.mapInArrow(released(_trained(held, rate, turn)), "shard long, p array<float>, n double")
        cells = parts.select("n", F.posexplode("p").alias("at", "value"))
        whole = F.round(F.col("value").cast("double") * UNITS).cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")
        means = cells.groupBy("at").agg((F.sum(whole).cast("double") / F.sum("n") / UNITS).alias("mean")).toArrow()  # one row a parameter
        held.unpersist()
        if means.num_rows:
            flat = flat.copy()
            flat[means["at"].to_numpy()] = means["mean"].to_numpy()
    return flat


SCORED = [c for c in NUMBERED.split(", ") if c.split()[0] not in ("shard", "place", "ids", "rare")]


def _scored(held):
    """The columns ``SCORED`` and the network's score of the last column, ids."""
    names = [c.split()[0] for c in SCORED] + ["net"]

    def run(batches):
        vocabulary, flat = held.value
        scorer = gru.Scorer(vocabulary.layout, flat)
        for b in batches:
            ids = b.column(b.num_columns - 1)
            ends, at = np.cumsum(pc.binary_length(ids).to_numpy()), 0
            while at < b.num_rows:  # about 2 * BLOCK_WORDS bytes, or one longer text
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2 * BLOCK_WORDS, side="right")))
                net = scorer.score([np.frombuffer(i.as_py(), "<u2") for i in ids[at:end]])
                yield pa.RecordBatch.from_arrays([*b.slice(at, end - at).columns[:-1], pa.array(net)], names=names)
                at = end

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    counts = written(word_counts(docs))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    vocabulary = Vocabulary(*frequent(counts, LISTED), int(sums.n), int(sums.v))
    rows = numbered(docs, vocabulary)
    flat = train(rows, vocabulary)
    held = spark.sparkContext.broadcast((vocabulary, flat))
    net = rows.select(*(c.split()[0] for c in SCORED), "ids").mapInArrow(released(_scored(held)), ", ".join([*SCORED, "net double"]))
    rare = rows.select("row", F.explode("rare").alias("h")).join(counts, "h", "left").groupBy(F.col("row").alias("r_row"))
    rare = rare.agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_sum"), F.count("c").alias("rare_known"))
    rows = net.join(rare, F.col("row") == F.col("r_row"), "left")
    found = F.coalesce("rare_sum", F.lit(0.0))
    base = F.col("listed_sum") + found - F.col("n_tokens") * F.lit(math.log10(sums.n + sums.v + 1))
    net = F.col("net") + F.col("other_sum") + found - F.col("other_rare") * F.lit(math.log10(vocabulary.other_mass))
    return rows.select(
        "doc_id",
        F.col("out").alias("held_out"),
        "n_tokens",
        (F.col("listed_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(sums.n)).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        net.alias("score"),
    )


def op7_gru_lm(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op7_gru_lm": op7_gru_lm}
