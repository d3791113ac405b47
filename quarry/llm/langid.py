"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every training document (one vector of bucket counts per
language and task, summed by Spark); the log-probability matrix, languages x
buckets, is broadcast and texts are scored in sparse numpy batches.

Defined cases: null text or a text without letters is ``und`` with score 0;
documents whose language is null, or without an id, are scored but not learned
from (rows without an id are not held out); with nothing to learn from every
text is ``und``; ties go to the smallest language name;
repeated rows are scored alike; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, spread, tidy
from quarry.llm._ngrams import ngrams, slices

SIZES = (1, 2, 3)
BITS = 15
SMOOTHING = 0.5
UNKNOWN = "und"


class Model(NamedTuple):
    langs: list[str]
    log_prob: np.ndarray     # languages x buckets
    prior: np.ndarray


def count_ngrams(docs: DataFrame, langs: Sequence[str]) -> DataFrame:
    """(lang, bucket, n, texts) of the rows' texts; columns ``text`` and ``lang`` are read."""
    place = {name: i for i, name in enumerate(langs)}

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        texts = np.zeros(len(langs), np.int64)
        for b in batches:
            text = b["text"].fillna("").tolist()
            lang = b["lang"].map(place).to_numpy(np.int64)
            texts += np.bincount(lang, minlength=len(langs))
            for lo, hi in slices(text):
                bucket, row = ngrams(text[lo:hi], SIZES, BITS)
                total += np.bincount((lang[lo:hi][row] << BITS) | bucket, minlength=total.size).reshape(total.shape)
        for i, name in enumerate(langs):
            at = np.flatnonzero(total[i])
            yield pd.DataFrame({"lang": name, "bucket": at, "n": total[i, at]})
            yield pd.DataFrame({"lang": [name], "bucket": [-1], "n": [texts[i]]})

    return spread(docs.select("text", "lang")).mapInPandas(run, "lang string, bucket long, n long")


def fit(docs: DataFrame) -> Model:
    """Model from all rows of ``docs`` (columns text, lang) with a language."""
    known = docs.where("lang IS NOT NULL")
    langs = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # one row per language
    if not langs:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0))
    sums = count_ngrams(known, langs).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # languages x buckets
    total, texts = np.zeros((len(langs), 1 << BITS)), np.zeros(len(langs))
    place = sums["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy(np.int64)
    bucket, n = sums["bucket"].to_numpy(np.int64), sums["n"].to_numpy(float)
    grams = bucket >= 0
    total[place[grams], bucket[grams]] = n[grams]
    texts[place[~grams]] = n[~grams]
    log_prob = np.log(total + SMOOTHING) - np.log((total + SMOOTHING).sum(1, keepdims=True))
    return Model(langs, log_prob.astype(np.float32), np.log(np.maximum(texts, 1) / max(texts.sum(), 1)))


def predict_texts(model: Model, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
    names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return names, score
    for lo, hi in slices(texts):
        bucket, row = ngrams(texts[lo:hi], SIZES, BITS)
        known = np.flatnonzero(np.bincount(row, minlength=hi - lo))
        z = np.stack([np.bincount(row, lp[bucket], hi - lo) for lp in model.log_prob], 1)[known] + model.prior
        best = z.argmax(1)
        score[lo + known] = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        for i, k in zip((lo + known).tolist(), best.tolist()):
            names[i] = model.langs[k]
    return names, score


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from ids outside the held-out fold."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shared = spark.sparkContext.broadcast(fit(rows.where(fold("doc_id", folds) != held_out)))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names, score = predict_texts(shared.value, b["text"].fillna("").tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": names, "score": score})

    base = rows.select("doc_id", "text")
    return spread(base).mapInPandas(run, f"doc_id {dict(base.dtypes)['doc_id']}, lang_pred string, score double").select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
