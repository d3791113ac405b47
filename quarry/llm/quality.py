"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes in chunks of CHUNK that overlap by at least WIDTH
bytes and cover it whole (the last chunk ends with the text).  Every byte has
a learned vector; FILTERS learned filters of WIDTH bytes slide over a chunk, and
each keeps its greatest response (max-pooling).  A small hidden layer turns the
pooled responses of a chunk into evidence, and the mean evidence of the
chunks gives the one probability of the text.  All layers are learned together
(Adam) on a bounded, seeded sample of the labelled texts, of which at most
DRAWN chunks each, drawn over the whole text, are learned from (now and then
only one of them, cut short, as short texts are rare).  For scoring
bytes and filters fold to one table of a response per (place, byte), so that a
score does not depend on the texts it is computed with.

Defined cases: null text counts as empty; an empty text is one chunk of
padding and scored like any other; invalid surrogates are replaced; documents
without a label, with another label than 0 or 1, or without an id are scored but not learned
from (rows without an id are not held out); several labels of one id, and rows
that repeat an id, are all used; with no label or one class only, every score
is the share of positives (next to 0 with no label); repeated rows are scored alike;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import prepare, spread, tidy

CHUNK = 256
STEP = 224                   # chunks start so far apart: neighbours share 32 bytes
WIDTH = 8                    # bytes a filter sees
FILTERS = 16
DIM = 8                      # numbers a byte is embedded in
HIDDEN = 16
PAD = 256                    # code beside the 256 bytes: after the end of a short text
STEPS = 1000                 # of training, whatever the number of texts
BATCH = 64                   # texts a step
RATE = 0.01
DECAY = 1e-3                 # weight decay of filters and hidden layers
DRAWN = 6                    # chunks of a text learned from
CROPPED = 0.1                # of the texts of a step are learned from as one chunk cut to a random length: short texts are rare
LEAST_CROP = 16
SAMPLE = 3000                # texts of either class learned from, at most
THRESHOLD = 0.3
SEED = 11
SLICE_CHUNKS = 1024          # chunks scored at once: 16 MB of responses


class Model(NamedTuple):
    table: np.ndarray        # (WIDTH, PAD + 1, FILTERS): response that a byte at a place of the filter adds
    bias: np.ndarray         # (FILTERS)
    hidden: np.ndarray       # (FILTERS, HIDDEN)
    hidden_bias: np.ndarray
    out: np.ndarray          # (HIDDEN)
    out_bias: float


def constant(share: float) -> Model:
    """The model that gives every text the same probability."""
    z = float(np.log(share / (1 - share))) if 0 < share < 1 else (50.0 if share == 1 else -np.inf)
    return Model(np.zeros((WIDTH, PAD + 1, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros((FILTERS, HIDDEN), np.float32),
                 np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), z)


def starts(size: int) -> np.ndarray:
    """First bytes of the chunks of a text of ``size`` bytes."""
    if size <= CHUNK:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, size - CHUNK, STEP), size - CHUNK)


def chunks(raw: bytes, at: np.ndarray) -> np.ndarray:
    """(chunk, CHUNK) byte codes of the chunks that start at ``at``."""
    codes = np.full(max(CHUNK, len(raw)), PAD, np.int16)
    codes[:len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(codes, CHUNK)[at]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def evidence(model: Model, codes: np.ndarray) -> np.ndarray:
    """Evidence (log-odds) of every chunk; WIDTH - 1 places of padding follow a chunk's bytes."""
    n = len(codes)
    wide = np.full((n, CHUNK + WIDTH - 1), PAD, np.int16)
    wide[:, :CHUNK] = codes
    got = model.table[0].take(wide[:, :CHUNK], axis=0)
    for j in range(1, WIDTH):
        got += model.table[j].take(wide[:, j: j + CHUNK], axis=0)
    pooled = np.maximum(got.max(1) + model.bias, 0)
    hidden = np.maximum((pooled[:, :, None] * model.hidden).sum(1) + model.hidden_bias, 0)
    return (hidden * model.out).sum(1, dtype=np.float64) + model.out_bias


def score_text(model: Model, text: str | None) -> float:
    raw = encoded(text)
    at = starts(len(raw))
    total = sum(evidence(model, chunks(raw, at[lo: lo + SLICE_CHUNKS])).sum() for lo in range(0, len(at), SLICE_CHUNKS))
    return _probability(total / len(at))


def _probability(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def score_texts(model: Model, texts: Sequence[str | None]) -> np.ndarray:
    """Probabilities of whole texts; short ones share a slice of chunks, a long one is worked off in slices."""
    out = np.empty(len(texts))
    held, owner, waiting = [], [], 0

    def flush() -> None:
        nonlocal waiting
        if held:
            z = evidence(model, np.concatenate(held))
            cut = np.cumsum([0, *map(len, held)])
            for i, a, b in zip(owner, cut[:-1], cut[1:]):
                out[i] = _probability(z[a:b].sum() / (b - a))
        held.clear()
        owner.clear()
        waiting = 0

    for i, text in enumerate(texts):
        raw = encoded(text)
        at = starts(len(raw))
        if len(at) > SLICE_CHUNKS:
            out[i] = score_text(model, text)
            continue
        held.append(chunks(raw, at))
        owner.append(i)
        waiting += len(at)
        if waiting >= SLICE_CHUNKS:
            flush()
    flush()
    return out


class _Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        size = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= size * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def _cropped(codes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One of the chunks, cut to a random length."""
    one = codes[rng.integers(len(codes))][None].copy()
    one[:, rng.integers(LEAST_CROP, CHUNK):] = PAD
    return one


def train(parts: Sequence[np.ndarray], labels: Sequence[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """A model from texts given as (chunk, CHUNK) byte codes."""
    y = np.asarray(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return constant(share)
    rng = np.random.default_rng(seed)

    def random(*shape: int, of: int) -> np.ndarray:
        return (rng.standard_normal(shape) * np.sqrt(2 / of)).astype(np.float32)

    p = {"emb": random(PAD + 1, DIM, of=2), "filters": random(WIDTH * DIM, FILTERS, of=WIDTH * DIM), "bias": np.zeros(FILTERS, np.float32),
         "hidden": random(FILTERS, HIDDEN, of=FILTERS), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": random(HIDDEN, of=HIDDEN),
         "out_bias": np.full(1, np.log(share / (1 - share)), np.float32)}
    adam = _Adam(p, RATE)
    order = np.concatenate([rng.permutation(len(parts)) for _ in range(-(-steps * BATCH // len(parts)))])   # every text in turn
    for step in range(steps):
        picked = order[step * BATCH: (step + 1) * BATCH]
        shown = [_cropped(parts[i], rng) if rng.random() < CROPPED else parts[i] for i in picked]
        codes, sizes = np.concatenate(shown), np.array([len(s) for s in shown])
        doc = np.repeat(np.arange(len(picked)), sizes)
        wide = np.full((len(codes), CHUNK + WIDTH - 1), PAD, np.int64)
        wide[:, :CHUNK] = codes
        seen = np.lib.stride_tricks.sliding_window_view(wide, WIDTH, axis=1)             # (chunk, place, WIDTH)
        resp = (p["emb"][seen].reshape(-1, WIDTH * DIM) @ p["filters"]).reshape(len(codes), CHUNK, FILTERS)
        top = resp.argmax(1)                                                              # (chunk, filter)
        each = np.arange(len(codes))[:, None]
        pooled = np.maximum(resp[each, top, np.arange(FILTERS)] + p["bias"], 0)
        hid = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
        z = np.bincount(doc, hid @ p["out"], len(picked)) / sizes + p["out_bias"][0]
        err = ((_probability(z) - y[picked]) / len(picked))
        back = (err / sizes)[doc].astype(np.float32)                                      # of each chunk's evidence
        g_hid = back[:, None] * p["out"] * (hid > 0)
        g_pool = (g_hid @ p["hidden"].T) * (pooled > 0)
        window = seen[each, top]                                                          # (chunk, filter, WIDTH)
        x = p["emb"][window].reshape(len(codes), FILTERS, WIDTH * DIM)
        g_filters = np.einsum("cf,cfk->kf", g_pool, x)
        g_x = (g_pool[:, :, None] * p["filters"].T).reshape(-1, DIM)
        flat = window.reshape(-1)
        g_emb = np.stack([np.bincount(flat, g_x[:, d], PAD + 1) for d in range(DIM)], 1).astype(np.float32)
        adam.rate = RATE * (1 - step / steps)                                        # falls to 0
        adam.update({"emb": g_emb, "filters": g_filters + DECAY * p["filters"], "bias": g_pool.sum(0),
                     "hidden": pooled.T @ g_hid + DECAY * p["hidden"], "hidden_bias": g_hid.sum(0),
                     "out": hid.T @ back + DECAY * p["out"], "out_bias": np.array([err.sum()], np.float32)})
    table = np.stack([p["emb"] @ p["filters"][j * DIM: (j + 1) * DIM] for j in range(WIDTH)])
    return Model(table, p["bias"], p["hidden"], p["hidden_bias"], p["out"], float(p["out_bias"][0]))


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        train_where: Column | None = None, steps: int = STEPS) -> Model:
    """Model fitted, in one task, on chunks of SAMPLE labelled texts of either class at most, picked by a seeded hash of the id."""
    known = labels.select(F.col(id_col).alias(id_col), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    if train_where is not None:
        known = known.where(train_where)
    known = known.select(F.col(id_col).alias("_id"), "_y").where("_id IS NOT NULL")
    order = [F.xxhash64(F.lit(SEED), F.col("_id")), F.col("_id")]
    picked = known.where("_y = 1").orderBy(*order).limit(SAMPLE).unionByName(known.where("_y = 0").orderBy(*order).limit(SAMPLE))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    counts = known.groupBy("_y").count().collect()                                            # two rows
    n = {r["_y"]: r["count"] for r in counts}

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, y, t in zip(b["_id"], b["_y"], b["_t"]):
                raw = encoded(t if isinstance(t, str) else "")
                at = starts(len(raw))
                if len(at) > DRAWN:   # evenly over the text, one of each stretch
                    at = at[np.linspace(0, len(at) - 1, DRAWN).astype(np.int64)]
                rows.append((str(i), y, chunks(raw, at).tobytes()))
            yield pd.DataFrame(rows, columns=["_id", "_y", "_c"])

    @tidy
    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "_y", "_c"])
        model = train([np.frombuffer(c, np.int16).reshape(-1, CHUNK) for c in rows["_c"]], rows["_y"].tolist(), steps)
        return pd.DataFrame([[np.asarray(v, np.float64).tobytes() for v in model]], columns=Model._fields)

    drawn = texts.join(F.broadcast(picked), "_id").mapInPandas(draw, "_id string, _y int, _c binary")   # 2 * SAMPLE ids at most
    rank = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64(F.lit(SEED), F.col("_id")), "_id", "_c"))
    drawn = drawn.withColumn("_r", rank).where(F.col("_r") <= SAMPLE).drop("_r")               # an id may stand for many rows
    found = drawn.withColumn("_m", F.lit("model")).groupBy("_m").applyInPandas(learn, ", ".join(f"{c} binary" for c in Model._fields)).first()
    if not found:
        return constant(0.0)
    shapes = constant(0.0)
    out = Model(*[np.frombuffer(found[c], np.float64).astype(np.float32).reshape(np.shape(like)) for c, like in zip(Model._fields, shapes)])
    # the two classes were sampled apart: give back the odds of the labels as they are
    odds = 0.0 if len(n) < 2 else np.log(n[1] / n[0]) - np.log(min(n[1], SAMPLE) / min(n[0], SAMPLE))
    return out._replace(out_bias=float(out.out_bias) + float(odds))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row, whole texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": score_texts(shared.value, b["text"].fillna("").tolist())})

    return spread(base).mapInPandas(run, f"doc_id {dict(base.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             folds: int = 5, held_out: int = 0, threshold: float = THRESHOLD, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only from ids outside the held-out fold."""
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, label_col, fold(id_col, folds) != held_out, steps)
    return score(docs, model, id_col, text_col).select(
        "doc_id",
        F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
