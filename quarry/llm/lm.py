"""Language-model scoring by deleted interpolation.

The probability of a word after its predecessor mixes the bigram and unigram
maximum-likelihood estimates with an add-one unigram floor.  The mixture
weights depend on how often the context was seen (one set per power of two)
and are learned by expectation-maximisation on held-out counts: every training
token in turn is deleted from the counts that predict it.

Texts are read once, into chunks of about CHUNK_TOKENS tokens (distinct word
hashes and positions, compressed).  A chunk sends each of its distinct n-grams
with its training count to the partition that owns the n-gram's hash range;
that partition adds up the counts of all chunks and answers each chunk in the
order it asked.  N-grams are hashes, as long as the number of tokens asks for.  Nothing of the corpus's size is
collected: the driver sees totals, a bounded histogram of log-counts for the
mixture weights, and the weights.

Defined cases: null text counts as empty; an empty text is its end token alone;
rows without an id are learned from; repeated rows are separate documents; with
nothing to learn from, every token scores the add-one floor; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import materialise, mix64, partitions, prepare, spread, text_slices, tidy, words

CHUNK_TOKENS = 1_000_000
SPARE_BITS = 21              # bits of an n-gram key beyond the logarithm of the corpus: about one key in 2**SPARE_BITS meets another
BINS = 4                     # cells per power of two in the histogram for the mixture weights
CONTEXTS = 48                # context-frequency buckets: 0, then a power of two each
EM_ROUNDS = 60

_U = np.uint64
_END, _START = (_U(int(x)) for x in mix64(np.array([101, 103], np.uint64)))


def _pack(x: np.ndarray, delta: bool = False) -> bytes:
    """Compressed 64-bit integers: (differences,) bytes of one weight side by side, zstd."""
    x = x.astype(np.uint64)
    if delta:
        x = np.diff(x, prepend=_U(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(raw: bytes, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if delta else x


# ---------------------------------------------------------------- chunks

CHUNK_SCHEMA = "chunk long, ids array<long>, held_out array<boolean>, n_words array<int>, vocabulary binary, tokens binary"


@tidy
def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth = TaskContext.get().partitionId(), 0
    ids, held, hashes, sizes, n = [], [], [], [], 0

    def flush() -> pa.RecordBatch:
        vocabulary, tokens, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.lexsort((vocabulary, -counts))          # frequent words get small numbers, which pack well
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vocabulary, tokens = vocabulary[order], rank[tokens]
        return pa.RecordBatch.from_pylist([{
            "chunk": part << 32 | nth, "ids": pa.concat_arrays(ids).to_pylist(), "held_out": pa.concat_arrays(held).to_pylist(),
            "n_words": np.concatenate(sizes).tolist(), "vocabulary": _pack(vocabulary, True), "tokens": _pack(tokens)}], schema=schema)

    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                        ("n_words", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("tokens", pa.binary())])
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            w = words(data, offsets, lower=True)
            ids.append(batch.column(0).slice(lo, hi - lo))
            held.append(batch.column(1).slice(lo, hi - lo))
            hashes.append(w.hashes)
            sizes.append(np.diff(w.first))
            n += len(w.hashes) + hi - lo
            if n >= CHUNK_TOKENS:
                yield flush()
                ids, held, hashes, sizes, n, nth = [], [], [], [], 0, nth + 1
    if ids:
        yield flush()


class Grams(NamedTuple):
    doc: np.ndarray          # document of each token (words, then the end, of each document)
    known: np.ndarray        # whether the token trains
    uni_keys: np.ndarray     # distinct keys, ascending
    bi_keys: np.ndarray
    uni: np.ndarray          # place of each token in uni_keys
    bi: np.ndarray
    context: np.ndarray      # place of the previous token in uni_keys, -1 at a start


def _grams(n_words: np.ndarray, held_out: np.ndarray, vocabulary: bytes, tokens: bytes, bits: int) -> Grams:
    n_words = np.asarray(n_words, np.int64)
    size = n_words + 1
    last = np.cumsum(size) - 1
    doc = np.repeat(np.arange(len(size)), size)
    cur = np.full(len(doc), _END, np.uint64)
    is_word = np.ones(len(doc), bool)
    is_word[last] = False
    cur[is_word] = _unpack(vocabulary, True)[_unpack(tokens).astype(np.int64)]
    prev = np.empty_like(cur)
    prev[1:] = cur[:-1]
    prev[last - n_words] = _START
    uni_keys, uni = np.unique(cur >> _U(64 - bits), return_inverse=True)
    bi_keys, bi = np.unique(mix64(prev * _U(0x9FB21C651E98DF25) + (cur ^ (cur >> _U(32)))) >> _U(64 - bits), return_inverse=True)
    context = np.empty(len(doc), np.int64)
    context[1:] = uni[:-1]
    context[last - n_words] = -1
    return Grams(doc, ~np.asarray(held_out, bool)[doc], uni_keys, bi_keys, uni, bi, context)


def _ask(parts: int, bits: int):
    """Chunk -> one row per hash range: its keys in order with their training counts."""
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                g = _grams(r.n_words, r.held_out, r.vocabulary, r.tokens, bits)
                out = {"part": np.arange(parts), "chunk": r.chunk}
                for name, keys, at in (("uni", g.uni_keys, g.uni), ("bi", g.bi_keys, g.bi)):
                    counts = np.bincount(at[g.known], minlength=len(keys))
                    # the hash range of a key follows its leading bits
                    cut = np.searchsorted(keys >> _U(bits - 32), (np.arange(parts + 1, dtype=np.uint64) << _U(32)) // _U(parts))
                    out[f"{name}_keys"] = [_pack(keys[x:y], True) for x, y in zip(cut[:-1], cut[1:])]
                    out[f"{name}_counts"] = [_pack(counts[x:y]) for x, y in zip(cut[:-1], cut[1:])]
                yield pd.DataFrame(out)
    return run


ANSWER_SCHEMA = "part int, chunk long, uni binary, bi binary, tokens long, types long"


@tidy
def _answer(g: pd.DataFrame) -> pd.DataFrame:
    """One hash range: add up all chunks' counts and answer each chunk; the row of chunk -1 has the totals."""
    out: dict[str, list] = {"part": g["part"].tolist(), "chunk": g["chunk"].tolist()}
    tokens = types = 0
    for name in ("uni", "bi"):
        keys = [_unpack(x, True) for x in g[f"{name}_keys"]]
        counts = [_unpack(x) for x in g[f"{name}_counts"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate(counts).astype(np.int64))
        if name == "uni":
            tokens, types = int(total.sum()), int((total > 0).sum())
        ends = np.cumsum([len(k) for k in keys])
        out[name] = [_pack(total[at[e - len(k): e]]) for e, k in zip(ends, keys)]
    out["tokens"], out["types"] = [0] * len(g), [0] * len(g)
    for name, value in (("part", int(g["part"].iloc[0])), ("chunk", -1), ("uni", b""), ("bi", b""), ("tokens", tokens), ("types", types)):
        out[name].append(value)
    return pd.DataFrame(out)


# ---------------------------------------------------------------- model


class Totals(NamedTuple):
    tokens: int              # N
    types: int               # V
    documents: int           # training documents: how often a start was seen
    bits: int                # of an n-gram key


def _counts(row, totals: Totals) -> tuple[Grams, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, count of each token, of its bigram, of its context) in training."""
    g = _grams(row.n_words, row.held_out, row.vocabulary, row.tokens, totals.bits)
    parts = sorted(row.answers, key=lambda a: a["part"])
    uni = np.concatenate([_unpack(a["uni"]) for a in parts]).astype(np.int64)
    bi = np.concatenate([_unpack(a["bi"]) for a in parts]).astype(np.int64)
    seen = np.where(g.context >= 0, uni[g.context], totals.documents)
    return g, uni[g.uni], bi[g.bi], seen


def _bucket(context_count: np.ndarray) -> np.ndarray:
    """Context-frequency bucket: 0 for unseen, else 1 + floor(log2)."""
    return np.minimum(np.frexp(context_count.astype(np.float64))[1], CONTEXTS - 1)


def _components(c1: np.ndarray, c2: np.ndarray, seen: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """Bigram, unigram and floor estimates (3 x tokens)."""
    return np.stack([c2 / np.maximum(seen, 1), c1 / max(tokens, 1), (c1 + 1) / (tokens + types + 1)])


def _cell(x: np.ndarray) -> np.ndarray:
    """Histogram cell of a positive number: BINS cells per power of two; -1000 for zero."""
    return np.where(x > 0, np.round(BINS * np.log2(np.maximum(x, 1e-300))), -1000).astype(np.int64)


def _held_out_histogram(totals: Totals):
    """Training tokens by (bucket of the context, cell of the bigram estimate, cell of the token's count), own occurrence deleted."""
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                g, c1, c2, seen = _counts(row, totals)
                t = g.known
                context = seen[t] - 1
                cells = np.stack([_bucket(context), _cell((c2[t] - 1) / np.maximum(context, 1)), _cell(c1[t] - 1)])
                key, n = np.unique(cells[0] * (1 << 40) + (cells[1] + 2000) * (1 << 20) + cells[2] + 2000, return_counts=True)
                yield pd.DataFrame({"context": key >> 40, "bigram": (key >> 20 & 0xFFFFF) - 2000, "count": (key & 0xFFFFF) - 2000, "n": n})
    return run


def mixture_weights(histogram: pd.DataFrame, totals: Totals, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bucket x component) by expectation-maximisation on the held-out histogram."""
    weights = np.tile([0.3, 0.5, 0.2], (CONTEXTS, 1))
    weights[0] = [0.0, 0.7, 0.3]
    level = lambda c: np.where(c > -1000, 2.0 ** (c / BINS), 0.0)
    for b, h in histogram.groupby("context"):
        c1, n = level(h["count"].to_numpy()), h["n"].to_numpy(float)
        p = np.stack([level(h["bigram"].to_numpy()), c1 / max(totals.tokens - 1, 1), (c1 + 1) / (totals.tokens + totals.types)])
        w = weights[int(b)]
        for _ in range(rounds):
            mixed = w @ p
            # a hundred tokens' worth of the starting weights keeps rare buckets sane
            w = (w * (p / mixed * n).sum(1) + 100 * weights[int(b)]) / (n.sum() + 100)
            w = w / w.sum()
        weights[int(b)] = w
    return weights


def _score_rows(totals: Totals, weights: np.ndarray):
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                g, c1, c2, seen = _counts(row, totals)
                p = _components(c1, c2, seen, totals.tokens, totals.types)
                n = len(row.n_words)
                w = weights[_bucket(seen)]
                yield pd.DataFrame({
                    "doc_id": pd.array(row.ids, dtype="Int64"), "held_out": row.held_out,
                    "n_tokens": np.asarray(row.n_words, np.int64) + 1,
                    "n_known": np.bincount(g.doc, c1 > 0, n).astype(np.int64),
                    "train_tokens": totals.tokens,
                    "base_score": np.bincount(g.doc, np.log10(p[2]), n),
                    "score": np.bincount(g.doc, np.log10((w.T * p).sum(0)), n),
                })
    return run


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    prepare(spark)
    parts = partitions(spark)
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(fold(id_col, folds) == held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"))
    chunks = materialise(spread(base).mapInArrow(_chunk_rows, CHUNK_SCHEMA))
    size = chunks.agg(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda a, x: a + x) + F.size("n_words"))).first()[0] or 0
    bits = min(64, max(40, int(size).bit_length() + SPARE_BITS))
    asked = chunks.select("chunk", "held_out", "n_words", "vocabulary", "tokens").mapInPandas(
        _ask(parts, bits), "part int, chunk long, uni_keys binary, uni_counts binary, bi_keys binary, bi_counts binary")
    answers = materialise(asked.groupBy("part").applyInPandas(_answer, ANSWER_SCHEMA))
    sums = answers.where("chunk = -1").agg(F.sum("tokens"), F.sum("types")).first()
    trained = chunks.agg(F.sum(F.size(F.filter("held_out", lambda h: ~h)))).first()[0]
    totals = Totals(sums[0] or 0, sums[1] or 0, trained or 0, bits)
    answered = chunks.join(
        answers.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("part", "uni", "bi")).alias("answers")), "chunk")
    histogram = answered.mapInPandas(_held_out_histogram(totals), "context long, bigram long, count long, n long")
    cells = histogram.groupBy("context", "bigram", "count").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # cells of log-counts: bounded
    weights = mixture_weights(cells, totals)
    return answered.mapInPandas(
        _score_rows(totals, weights),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
