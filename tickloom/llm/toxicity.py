"""Toxicity by classifier chains.

Categories come from the labels: low_quality, toxic, toxic_fluent (toxic but well formed). They are
predicted in this order; each linear model gets, besides the words, the log odds that the chain gave
the earlier categories. In training those are out-of-fold predictions (each fold is scored by models of
the other folds, whose word lists are chosen on the other folds too), so later models see the earlier
ones as uncertain as they are on new text. A document is rejected when the probability of ``toxic``
reaches the threshold that is best (F1) on the out-of-fold predictions, of those where at least
``LEAST_PRECISION`` of the rejected ones are toxic; without such a threshold nothing is rejected.

Features are presence of words (letters and digits, A-Z lower-cased) and of their first 4, 5 and 6
bytes, which catches inflected forms; a feature is chosen when its association with the category
stands out by ``Z`` standard errors. Training takes at most ``MAX_ROWS`` labelled documents, those with
the smallest hash of doc_id, until they have ``MAX_PAIRS`` distinct features: a bounded sample. Features are
found where the whole texts are, and only they are gathered in one task. Scoring moves nothing.

Defined results: null text is empty; an empty text gets the chain's base rate; labels that are null or belong to
no document are ignored, repeated labels of one document take the largest; without labels of both kinds a
category gets probability 0 and nothing is rejected; null ids stay null; repeated rows are scored alike;
an empty table gives an empty result; other columns are kept by the filter and ignored by the scan.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, hashed_sample, released, table, text_of
from .hashing import BLOCK, batches_of, blocks, hash_words
from .linear import Logistic, associated, present, sigmoid

CATEGORIES = ("low_quality", "toxic", "toxic_fluent")
MAX_ROWS = 8000
MAX_PAIRS = 1 << 25
LEAST_PRECISION = 0.5
FOLDS = 3
PREFIXES = (4, 5, 6)
Z = 3.5
LEAST_ROWS = 2
MOST_FEATURES = 8192
NEVER = -40.0  # log odds of a category without labels of both kinds
PAIRS_HELD = 1 << 20


def features_of(texts: list[bytes], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, rows): the distinct features of each text, all or those ``wanted`` (sorted)."""
    mask = None
    if wanted is not None:
        mask = np.zeros(1 << 18, bool)
        mask[wanted & np.uint32((1 << 18) - 1)] = True
    for first, end, data, borders in batches_of(texts):
        single = end - first == 1 and len(data) > BLOCK
        for offset, piece in blocks(data) if single else [(0, data)]:
            words, starts, _, *heads = hash_words(piece, PREFIXES, plain=True)
            row = np.searchsorted(borders, starts + offset, side="right") + first
            for h in (words, *heads):
                keep = h != 0 if mask is None else mask[(h & np.uint64((1 << 18) - 1)).astype(np.int64)] & (h != 0)
                h, r = h[keep], row[keep]
                if wanted is not None:
                    r, at = present(h.astype(np.uint32), r, wanted)
                    h = wanted[at]
                if len(h):
                    yield h, r


def distinct_pairs(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(features, rows) without repeats, in order of rows; features shortened to 32 bits, repeats dropped as parts come in."""
    done, held, n = [], [], 0
    for h, r in parts:
        held.append((r.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        n += len(h)
        if n > PAIRS_HELD:
            done.append(_distinct(held))
            held, n = [], 0
    pairs = _distinct(done + held)
    return pairs.astype(np.uint32), (pairs >> np.uint64(32)).astype(np.int32)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    pairs.sort()
    return pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs


def repeated(h: np.ndarray, r: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the features of at least ``least`` rows."""
    names = np.sort(h)
    again = names[least - 1 :] == names[: max(len(names) - least + 1, 0)]
    names = np.unique(names[least - 1 :][again])
    at = np.searchsorted(names, h).astype(np.int32)
    keep = names[np.minimum(at, len(names) - 1)] == h if len(names) else np.zeros(len(h), bool)
    return h[keep], r[keep]


class Chain:
    """Models of all categories in order; picklable."""

    def fit(self, h: np.ndarray, r: np.ndarray, targets: np.ndarray) -> "Chain":
        """targets: rows x categories of 0 and 1."""
        n, self.links = len(targets), []
        h, r = repeated(h, r, LEAST_ROWS)
        fold = np.arange(n) % FOLDS
        logits = np.zeros((n, 0))
        for c in range(targets.shape[1]):
            y = targets[:, c].astype(float)
            out = np.zeros(n)
            for k in range(FOLDS):
                own, rest = fold == k, fold != k
                new = np.cumsum(rest) - 1
                pick = rest[r]
                names, model = self.one(h[pick], new[r[pick]], logits[rest], y[rest])
                rows, columns = present(h, r, names)
                out[own] = model.logits(rows, columns, logits)[own]
            self.links.append(self.one(h, r, logits, y))
            logits = np.column_stack([logits, np.clip(out, -15, 15)])
        toxic = targets[:, CATEGORIES.index("toxic")]
        self.threshold = best_threshold(sigmoid(logits[:, CATEGORIES.index("toxic")]), toxic) if 0 < toxic.sum() < n else 2.0
        self.wanted = np.unique(np.concatenate([names for names, _ in self.links])) if self.links else np.empty(0, np.uint32)
        return self

    @staticmethod
    def one(h, r, dense, y):
        """(features, model) of a category; of labels of one kind nothing can be learnt, and it gets about probability 0."""
        if not len(y) or y.min() == y.max():
            model = Logistic(rounds=0).fit(np.empty(0, np.int64), np.empty(0, np.int64), dense, y, 0)
            model.bias = NEVER
            return np.empty(0, np.uint32), model
        names = associated(h, r, y, LEAST_ROWS, Z, MOST_FEATURES)
        rows, columns = present(h, r, names)
        return names, Logistic().fit(rows, columns, dense, y, len(names))

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        h, r = distinct_pairs(features_of(texts, self.wanted)) if len(self.wanted) else distinct_pairs([])
        logits = np.zeros((len(texts), 0))
        for names, model in self.links:
            rows, columns = present(h, r, names)
            logits = np.column_stack([logits, np.clip(model.logits(rows, columns, logits), -15, 15)])
        return sigmoid(logits)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of the midpoints between predictions, the one with the best F1 of those with ``LEAST_PRECISION``.

    2 (nothing is rejected) where no cut is that precise; a cut below all predictions is none.
    """
    order = np.argsort(-p, kind="stable")
    hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    f1 = 2 * hits / (taken + y.sum() + 1e-9)
    right = np.append(np.diff(p[order]) != 0, False) & (hits >= LEAST_PRECISION * taken)
    if not right.any():
        return 2.0
    k = int(np.argmax(np.where(right, f1, -1)))
    return float((p[order][k] + p[order][k + 1]) / 2)


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, text, quality, toxic of the bounded sample."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("__quality"), F.max("toxic").alias("__toxic"))
    known = hashed_sample(known, "doc_id", max_rows)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id")
    return rows.select("doc_id", "text", F.col("__quality").cast("int").alias("quality"), F.col("__toxic").cast("int").alias("toxic"))


LEARNT = "doc_id long, quality int, toxic int, features binary"


def _learnt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The distinct features of each row, where the texts are; only these move."""
    for f in frames:
        h, r = distinct_pairs(features_of([t.encode() for t in f["text"]]))
        parts = np.split(h, np.searchsorted(r, np.arange(1, len(f))))
        yield pd.DataFrame({"doc_id": f["doc_id"], "quality": f["quality"], "toxic": f["toxic"], "features": [p.astype("<u4").tobytes() for p in parts[: len(f)]]})


def _train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of a hash: those after the first ``MAX_PAIRS`` features are not learnt."""
    h, r, low, toxic, n = [], [], [], [], 0
    for f in frames:
        for q, t, data in zip(f["quality"], f["toxic"], f["features"], strict=True):
            if n < MAX_PAIRS:
                own = np.frombuffer(data, "<u4")
                h.append(own)
                r.append(np.full(len(own), len(low), np.int32))
                low.append(q == 0)
                toxic.append(t == 1)
                n += len(own)
    low, toxic = np.array(low, bool), np.array(toxic, bool)
    h, r = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((h, np.uint32), (r, np.int32)))
    chain = Chain().fit(h, r, np.column_stack([low, toxic, toxic & ~low]).astype(np.int64))
    yield pd.DataFrame({"model": [pickle.dumps(chain)]})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    """The chain, fitted in one task on the bounded sample."""
    rows = training_rows(docs, labels, max_rows).mapInPandas(released(_learnt), LEARNT)
    first = rows.groupBy("doc_id").agg(*(F.max_by(c, "features").alias(c) for c in ("quality", "toxic", "features")))
    order = F.xxhash64("doc_id")
    one = first.repartition(1).sortWithinPartitions(order, "doc_id")
    got = one.mapInPandas(released(_train), "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else Chain().fit(np.empty(0, np.uint32), np.empty(0, np.int32), np.zeros((0, len(CATEGORIES)), np.int64))


def scores(spark, chain: Chain):
    """A column function: text to a struct of the categories' probabilities."""
    held = spark.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = [held.value.probabilities([t.encode() for t in texts.iloc[k : k + 1024]]) for k in range(0, len(texts), 1024)]
            yield pd.DataFrame(np.concatenate(p) if p else np.empty((0, len(CATEGORIES))), columns=CATEGORIES)
        give_back()

    return score


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, p_<category>..., rejected."""
    chain = train(docs, labels, max_rows)
    rows = docs.select("doc_id", scores(docs.sparkSession, chain)(text_of()).alias("p"))
    return rows.select("doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in CATEGORIES), (F.col("p.toxic") >= chain.threshold).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rejected rows, columns as they were."""
    chain = train(docs, labels)
    rows = docs.withColumn("__p", scores(docs.sparkSession, chain)(text_of()))
    return rows.where(F.col("__p.toxic") < chain.threshold).select(*docs.columns)


def op4_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity": op4_toxicity}
