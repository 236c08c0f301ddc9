"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all training texts together count as
unlabelled, whatever their label.  The classifier is a logistic model over the
words of a text and their first letters, trained in numpy with the
non-negative risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

where the prior is the share of toxic rows among the labelled training rows.
When the second term is negative, its gradient step is reversed.  Scoring runs
on all rows in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, ship

#: Hash buckets of features.
BITS = 22
#: Lengths of word beginnings that are features beside the whole word: inflected and compounded insults share them.
STARTS = (3, 4, 5)
#: Most positives and most unlabelled texts that are read for training (the labelled rows with the smallest id hashes).
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 10_000
#: A feature is used if this share of the positives has it, and so many times the share of all texts.
LEAST_SHARE, LEAST_LIFT = 0.005, 3.0


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings."""
    mask = (1 << BITS) - 1
    word = word.strip(".,;:!?\"'()")
    own = [f"{n}:{word[:n]}" for n in STARTS if len(word) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in [f"=:{word}", *own]]


def words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


#: Words whose features a task remembers.
REMEMBERED = 60_000


class Model:
    """Weights of the used features and a bias; a text's score depends on which of them it has."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scorer(self):
        """A function of a text.  It remembers the used features of words, up to a bound; those met again stay."""
        seen: dict[str, tuple] = {}
        before: dict[str, tuple] = {}
        weights = self.weights

        def score(text: str | None) -> float:
            nonlocal seen, before
            hit: set[int] = set()
            for w in words(text):
                f = seen.get(w)
                if f is None:
                    f = before.get(w)
                    if f is None:
                        f = tuple(x for x in features(w) if x in weights)
                    if len(seen) >= REMEMBERED // 2:
                        seen, before = {}, seen
                    seen[w] = f
                if f:
                    hit.update(f)
            return float(_sigmoid(self.bias + sum(weights[x] for x in sorted(hit))))

        return score


def fit(use: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.3) -> Model:
    """Trains by full-batch steps (Adam) on the non-negative risk with logistic loss.

    ``use`` are the sorted features, the texts are arrays of those that they
    have.  Without positives or without unlabelled texts every text gets the prior.
    """
    bias = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not positive or not unlabelled:
        return Model({}, bias)
    def matrix(rows):
        x = np.zeros((len(rows), len(use)), np.float32)
        for i, r in enumerate(rows):
            x[i, np.searchsorted(use, r)] = 1
        return x

    xp, xu = matrix(positive), matrix(unlabelled)
    w, m, v = np.zeros(len(use) + 1), np.zeros(len(use) + 1), np.zeros(len(use) + 1)
    w[-1] = bias
    for t in range(1, rounds + 1):
        v32 = w[:-1].astype(np.float32)
        zp, zu = (xp @ v32).astype(np.float64) + w[-1], (xu @ v32).astype(np.float64) + w[-1]
        sp, su = _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)

        def slope(p, u):
            return np.append(xp.T @ p.astype(np.float32) + xu.T @ u.astype(np.float32), p.sum() + u.sum())

        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = slope(-prior * sp, su)
        g = -g if negative < 0 else g + slope(prior * (sp - 1 / len(zp)), 0 * su)
        g[:-1] += 1e-5 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate / np.sqrt(t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({int(k): float(x) for k, x in zip(use, w[:-1])}, float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, held_out) -> Model:
    """Fits on bounded samples of the labelled rows for which ``held_out`` is false."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out)
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    prior = counts["p"] / counts["n"] if counts["n"] else 0.0
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = known.where("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    # toxic rows are also part of what is unlabelled, as they are of the corpus
    unlabelled = known.orderBy(*order).limit(MAX_UNLABELLED).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    picked = positive.union(unlabelled).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))
    # at most MAX_POSITIVE + MAX_UNLABELLED ids
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def reduce(batches):
        for b in batches:
            bags = ({f for w in words(t) for f in features(w)} for t in b["text"])
            yield pd.DataFrame({"p": b["p"], "u": b["u"], "ids": [np.array(sorted(x), np.int32) for x in bags]})

    bags = scratch.write(rows.select("p", "u", "text").mapInPandas(reduce, "p int, u int, ids array<int>"), "bags")
    np_, nu = bags.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("u"), F.lit(0))).first()
    if not np_ or not nu:
        return fit(np.empty(0, np.int64), [], [], prior)
    share = bags.select("p", "u", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    useful = (F.col("p") >= max(3, LEAST_SHARE * np_)) & (F.col("p") / np_ >= LEAST_LIFT * F.col("u") / nu)
    # a text of the sample has each at most once: few thousand features
    use = sorted(r["id"] for r in share.where(useful).select("id").collect())
    kept = bags.select("p", "u", F.sort_array(F.array_intersect("ids", F.lit(use).cast("array<int>"))).alias("ids")).collect()
    texts = sorted((r["ids"], r["p"], r["u"]) for r in kept)
    take = lambda k: [np.array(x[0], np.int64) for x in texts if x[k]]
    return fit(np.array(use, np.int64), take(1), take(2), prior)


def score(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """The score of a text column as a column: double from 0 to 1."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    # a batch's texts become Python strings one at a time
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = shared.value.scorer()
        for texts in batches:
            yield pa.array((one(t.as_py()) for t in texts), pa.float64())

    return scored(text)


def toxicity(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` added, learnt from the labelled rows outside ``held_out``.

    ``held_out`` is a condition on doc_id.  Null and empty texts get the score
    of a text without words; long texts are read whole; labels that are null or
    repeat are taken once (toxic if any row says so); without positives every
    score is below 1e-5; an empty table gives an empty result; columns named
    score or predicted are replaced, others kept.
    """
    scored = docs.withColumn("score", score(docs.sparkSession, train(docs, labels, held_out)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
