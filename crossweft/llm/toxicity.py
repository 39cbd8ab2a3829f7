"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased (A-Z), blanks become one kind of space, and every run of 4 and 5 bytes
is hashed to a bucket. A bucket present in a document is a feature. On a bounded sample of
labelled documents (``SAMPLE`` of each class, those with the smallest hash of their id) the
log-count ratio ``r = log((p + 1) / |p|) - log((q + 1) / |q|)`` of each bucket is counted;
``FEATURES`` buckets with the largest weighted ratio become the inputs ``r * presence`` of a
logistic regression with an L2 penalty. All labelled ids of each class outside the held-out fold
are counted, and a sampled row weighs as many as it stands for, so the threshold means the same
whether a class is sampled or not. Counts are summed by Spark; what reaches the driver
is bounded by the two parameters. Scoring is one scan of all texts without a shuffle.

Defined cases: a null or empty text has no features and gets the score of the intercept.
Rows without an id are scored, never learned from. An id with several labels is toxic if one
of them says so; labels other than 0 and 1 are ignored. If labels of one class are missing
nothing can be learned and every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweft.llm.registry import query
from crossweft.llm.tables import give_back, one_by_one, sampled_rows, stored, table

#: Labelled documents of each class that are learned from, and features kept.
SAMPLE = 6_000
FEATURES = 6_000
BUCKET_BITS = 20
GRAMS = (4, 5)
PENALTY = 1e-3
FOLDS = 5

_FOLD = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text, with repeats."""
    raw = np.frombuffer(f" {text or ''} ".encode().translate(_FOLD), np.uint8).astype(np.uint32)
    found, rolled = [], raw
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        rolled = rolled[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n in GRAMS:
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            found.append(mixed >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class Classifier:
    """``weights`` of the buckets (log-count ratio times coefficient), 0 where not a feature."""

    feature: np.ndarray
    weights: np.ndarray
    intercept: float
    learned: bool

    def score(self, text: str | None) -> float:
        if not self.learned:
            return 0.0
        hit = self.feature[buckets(text)]
        hit = np.unique(hit[hit >= 0])
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[hit].sum(), -40, 40))))


def fold(identity: Column) -> Column:
    return F.pmod(F.crc32(F.encode(identity.cast("string"), "UTF-8")), F.lit(FOLDS))


def known_labels(labels: DataFrame, identity: str) -> DataFrame:
    """(_id, _toxic) of the labelled ids outside the held-out fold."""
    return (
        labels.where(F.col(identity).isNotNull() & F.col("toxic").isin(0, 1))
        .groupBy(F.col(identity).alias("_id"))
        .agg(F.max("toxic").alias("_toxic"))
        .where(fold(F.col("_id")) != 0)
    )


def labelled_sample(docs: DataFrame, known: DataFrame, sample: int, identity: str, text: str) -> DataFrame:
    """(text, toxic) of at most ``sample`` rows a class; the list of ids is bounded, so it travels."""
    known = known.withColumn("_order", F.xxhash64("_id"))
    pick = [known.where(F.col("_toxic") == k).orderBy("_order", "_id").limit(sample) for k in (0, 1)]
    ids = F.broadcast(pick[0].unionByName(pick[1]))
    found = docs.select(F.col(identity).alias("_id"), F.col(text).alias("_text")).join(ids, "_id")
    bounded = [sampled_rows(found.where(F.col("_toxic") == k), sample) for k in (0, 1)]
    return stored(bounded[0].unionByName(bounded[1]).select("_text", "_toxic"), "toxicity-sample")


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[toxic, np.unique(buckets(text))] += 1
    used = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[1, used]), pa.array(total[0, used])], ["bucket", "p", "q"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = SAMPLE,
    features: int = FEATURES,
    identity: str = "doc_id",
    text: str = "text",
) -> Classifier:
    known = known_labels(labels, identity)
    rows = labelled_sample(docs, known, sample, identity, text)
    counts = rows.mapInArrow(_counts, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    sizes = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Classifier(np.full(1 << BUCKET_BITS, -1, np.int32), np.zeros(0), 0.0, False)
    if not sizes.get(0) or not sizes.get(1):
        return nothing
    # How many labelled ids a sampled one stands for.
    stands_for = {r["_toxic"]: max(1.0, r["n"] / sample) for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = stands_for[0], stands_for[1]
    # How far presence tells the classes apart: difference of the rates over its deviation.
    rate = (F.col("p") * toxic + F.col("q") * clean) / (sizes[0] * clean + sizes[1] * toxic)
    apart = F.abs(F.col("p") / sizes[1] - F.col("q") / sizes[0]) / F.sqrt(rate * (1 - rate) + 1e-4)
    best = counts.where("p + q >= 3").withColumn("apart", apart).orderBy(F.col("apart").desc(), "bucket").limit(features).toArrow()
    chosen = best["bucket"].to_numpy()
    p, q = best["p"].to_numpy() + 1.0, best["q"].to_numpy() + 1.0
    ratio = np.log(p / (sizes[1] + 2)) - np.log(q / (sizes[0] + 2))
    feature = np.full(1 << BUCKET_BITS, -1, np.int32)
    feature[chosen] = np.arange(len(chosen))

    def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [feature[buckets(t)] for t in batch.column(0).to_pylist()]
            lists = pa.array([np.unique(h[h >= 0]) for h in hits], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), lists], ["toxic", "hits"])

    # Sorted, so that the same sample gives the same sums in the same order.
    seen = rows.mapInArrow(present, "toxic int, hits array<int>").orderBy("toxic", F.size("hits"), "hits").toArrow()
    y = seen["toxic"].to_numpy().astype(float)
    hits = seen["hits"].combine_chunks()
    at = np.repeat(np.arange(len(y)), np.diff(hits.offsets.to_numpy()))
    coefficients, intercept = logistic(at, hits.values.to_numpy(), y, ratio, np.where(y > 0, toxic, clean))
    return Classifier(feature, ratio * coefficients, intercept, True)


def logistic(
    row: np.ndarray, column: np.ndarray, y: np.ndarray, scale: np.ndarray, weight: np.ndarray, steps: int = 400
) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on presence times ``scale``, by accelerated gradient steps.

    Rows count by ``weight``.
    """
    n, k = len(y), len(scale)
    weight = weight / weight.sum()
    value = scale[column]
    squares = np.bincount(row, value * value, n)
    rate = 1 / (0.25 * (squares @ weight * 4 + 1) + PENALTY)
    w, b = np.zeros(k), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        z = ahead_b + np.bincount(row, value * ahead_w[column], n)
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        new_w = ahead_w - rate * (np.bincount(column, value * gap[row], k) + PENALTY * ahead_w)
        new_b = ahead_b - rate * gap.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_next
        if gap @ (b - new_b + np.bincount(row, value * (w - new_w)[column], n)) < 0:
            pull, t_next = 0.0, 1.0  # going uphill: start the acceleration anew
        ahead_w, ahead_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, float(b)


def score(docs: DataFrame, model: Classifier, to: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the probability of being toxic; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != to]
    schema = docs.select(*kept).schema.add(to, "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t) for t in one_by_one(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], [*kept, to])
        give_back()

    return docs.mapInArrow(run, schema)


@query("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
