"""Toxicity classifier: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the average of the embeddings of its distinct character 3- to 6-grams
with word boundaries (and of a few zero vectors), so misspellings share most of
their vectors with the known form; embeddings and softmax weights are learned
together by Adagrad on a bounded, seeded sample of the labelled texts.  Only
n-grams whose share of texts differs between the classes beyond chance
(LEAST_Z standard errors) hold a vector: a long text's many other n-grams
neither dilute its average nor are learned by heart.  Two classes make the score
linear in the bag, so for scoring each bucket folds to one number.

Defined cases: null text counts as empty; a text without letters scores like
any text without a telling n-gram; documents without a label, with a null
label, or without an id are scored but not learned from (rows without an id are
not held out); several labels of one id are all used;
with no label or one class only, every score is the share of positives (0 with
no label); repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, release, spread, tidy
from quarry.llm._ngrams import ngrams, slices

SIZES = (3, 4, 5, 6)
BITS = 18                    # buckets of n-grams: 2**18
DIM = 4
STEPS = 2000                 # of training, whatever the number of texts
RATE = 1.0
BATCH = 32
NEUTRAL = 10                 # zero vectors that every average holds besides, so that a single weak n-gram decides nothing
MIN_TEXTS = 3                # a bucket in fewer texts of the sample keeps no vector
LEAST_Z = 5.0                # nor one whose share of texts differs between the classes by fewer standard errors
THRESHOLD = 0.3
SAMPLE_POSITIVE = 4000       # the classifier is fitted on at most so many labelled texts of either class
SAMPLE_NEGATIVE = 6000
SEED = 5


class Model(NamedTuple):
    weight: np.ndarray       # log-odds of the positive class that a bucket adds, as an average over the bag
    bias: float


def _bags(texts: Sequence[str]) -> list[np.ndarray]:
    """Distinct buckets of each text."""
    out: list[np.ndarray] = []
    for lo, hi in slices(texts):
        bucket, row = ngrams(texts[lo:hi], SIZES, BITS)
        key = np.unique((row << BITS) | bucket)
        cut = np.searchsorted(key >> BITS, np.arange(hi - lo + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            out.append((key[a:b] & ((1 << BITS) - 1)).astype(np.int32))
    return out


def telling(bags: Sequence[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets that keep a vector: seen in MIN_TEXTS texts, and in one class more often than chance would have it."""
    seen = np.zeros((2, 1 << BITS), np.int64)
    for bucket, label in zip(bags, y):
        seen[label, bucket] += 1
    n = np.bincount(y, minlength=2)[:, None]
    share = seen.sum(0) / n.sum()
    spread = np.sqrt(share * (1 - share) * (1 / n).sum())
    apart = np.abs(seen[1] / n[1] - seen[0] / n[0])
    return (seen.sum(0) >= MIN_TEXTS) & (apart >= LEAST_Z * spread) & (spread > 0)


def train(texts: Sequence[str], labels: Sequence[int], steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> Model:
    y = np.asarray(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if len(y) == 0 or share in (0.0, 1.0):
        return Model(np.zeros(1 << BITS, np.float32), 50.0 if share == 1.0 else -50.0)
    rng = np.random.default_rng(seed)
    bags = _bags(texts)
    common = telling(bags, y)
    bags = [bucket[common[bucket]] for bucket in bags]
    share_of = np.array([1 / (len(bucket) + NEUTRAL) for bucket in bags], np.float32)
    emb = ((rng.random((1 << BITS, DIM), dtype=np.float32) - 0.5) / DIM)
    out = rng.standard_normal((DIM, 2)).astype(np.float32) * 0.1
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    g_emb, g_out, g_bias = np.full(1 << BITS, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    order = np.concatenate([rng.permutation(len(bags)) for _ in range(-(-steps * BATCH // len(bags)))])   # every text in turn
    for step in range(steps):
        part = order[step * BATCH: (step + 1) * BATCH]
        idx = np.concatenate([bags[i] for i in part])
        doc = np.repeat(np.arange(len(part)), [len(bags[i]) for i in part])
        val = share_of[part][doc]
        hidden = np.empty((len(part), DIM), np.float32)
        rows = emb[idx] * val[:, None]
        for d in range(DIM):
            hidden[:, d] = np.bincount(doc, rows[:, d], len(part))
        z = hidden @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(part)), y[part]] -= 1
        grad_out, back = hidden.T @ p, p @ out.T
        uniq, inv = np.unique(idx, return_inverse=True)
        grad = np.empty((len(uniq), DIM), np.float32)
        for d in range(DIM):
            grad[:, d] = np.bincount(inv, val * back[doc, d], len(uniq))
        g_emb[uniq] += (grad * grad).mean(1)
        emb[uniq] -= rate * grad / np.sqrt(g_emb[uniq])[:, None]
        g_out += grad_out * grad_out
        out -= rate * 0.2 * grad_out / np.sqrt(g_out)
        grad_bias = p.sum(0)                      # a text without telling n-grams is evidence as well
        g_bias += grad_bias * grad_bias
        bias -= rate * 0.2 * grad_bias / np.sqrt(g_bias)
    return Model(np.where(common, emb @ (out[:, 1] - out[:, 0]), 0).astype(np.float32), float(bias[1] - bias[0]))


def score_texts(model: Model, texts: Sequence[str]) -> np.ndarray:
    out = np.empty(len(texts))
    for lo, hi in slices(texts):
        bucket, row = ngrams(texts[lo:hi], SIZES, BITS)
        key = np.unique((row << BITS) | bucket)
        row, bucket = key >> BITS, key & ((1 << BITS) - 1)
        weight = model.weight[bucket]
        z = np.bincount(row, weight, hi - lo) / (np.bincount(row, weight != 0, hi - lo) + NEUTRAL) + model.bias
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    return out


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        train_where: Column | None = None) -> Model:
    """Model fitted, in one task, on a seeded sample of the labelled documents (SAMPLE_POSITIVE and SAMPLE_NEGATIVE at most)."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y IN (0, 1) AND _id IS NOT NULL")
    if train_where is not None:
        known = known.withColumnRenamed("_id", id_col).where(train_where).withColumnRenamed(id_col, "_id")
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}       # two rows
    order = [F.xxhash64(F.lit(SEED), F.col("_id")), F.col("_id")]
    picked = known.where("_y = 1").orderBy(*order).limit(SAMPLE_POSITIVE).unionByName(
        known.where("_y = 0").orderBy(*order).limit(SAMPLE_NEGATIVE))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))

    @tidy
    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.fillna({"_t": ""}).sort_values(["_id", "_y", "_t"])
        model = train(rows["_t"].tolist(), rows["_y"].tolist())
        return pd.DataFrame({"weight": [model.weight.tobytes()], "bias": [model.bias]})

    sample = texts.join(F.broadcast(picked), "_id").withColumn("_m", F.lit("model")).groupBy("_m").applyInPandas(learn, "weight binary, bias double")
    found = sample.first()                       # the model: 2**BITS numbers
    if not found:
        return train([], [])
    # the classes are sampled apart: give back the odds of the labels as they are
    odds = np.log(n[1] / n[0]) - np.log(min(n[1], SAMPLE_POSITIVE) / min(n[0], SAMPLE_NEGATIVE)) if len(n) == 2 else 0.0
    return Model(np.frombuffer(found["weight"], np.float32), found["bias"] + float(odds))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, whole texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score_texts(shared.value, b["text"].fillna("").tolist())})

    kind = dict(base.dtypes)["doc_id"]
    return spread(base).mapInPandas(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from ids outside the held-out fold."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, fold(id_col, folds) != held_out)
    return score(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, fold(id_col, 4) != 2))

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        found = pd.Series(score_texts(model.value, text.fillna("").tolist()))
        release()                                # the worker lives on beside the stages that follow
        return found

    return docs.where(toxic(F.col(text_col).cast("string")) < threshold)
