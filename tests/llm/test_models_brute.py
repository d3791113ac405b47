"""Learned models against plain Python, and rows that share an id or have none."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import langid, lm, packing, toxicity
from quarry.llm.queries import vocabulary
from tests.conftest import SMALL
from tests.llm import brute

MASK = (1 << 32) - 1


# ---------------------------------------------------------------- 3: naive Bayes from dictionaries


def bucket(gram: str) -> int:
    """The hash of an n-gram as the model's table has it, in whole numbers."""
    h = 0
    for c in gram:
        h = (h * 0x01000193 + ord(c) * 0x9E3779B1) & MASK
    h ^= len(gram) * 0x85EBCA6B & MASK
    h ^= h >> 16
    h = h * 0x7FEB352D & MASK
    h ^= h >> 15
    h = h * 0x846CA68B & MASK
    h ^= h >> 16
    return h >> 32 - langid.BITS


def grams(text):
    """n-grams of every word between two marks, but the marks alone."""
    found = Counter()
    word = []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(c)
        elif word:
            marked = "\x01" + "".join(word) + "\x01"
            for n in (1, 2, 3):
                found.update(bucket(g) for g in (marked[i: i + n] for i in range(len(marked) - n + 1)) if g != "\x01")
            word = []
    return found


def naive_bayes(rows):
    """id -> (language, probability), learned from the rows outside the fold."""
    counts, texts = {}, Counter()
    bags = {i: grams(t) for i, t, _ in rows}
    for i, _, lang in rows:
        if brute.fold(i, 5) != 0 and lang is not None:
            counts.setdefault(lang, Counter()).update(bags[i])
            texts[lang] += 1
    size, out = 1 << langid.BITS, {}
    for i, _, _ in rows:
        if not bags[i]:
            out[i] = ("und", 0.0)
            continue
        logs = {}
        for lang, own in sorted(counts.items()):
            every = sum(own.values()) + langid.SMOOTHING * size
            logs[lang] = math.log(texts[lang] / sum(texts.values())) + sum(
                n * math.log((own[b] + langid.SMOOTHING) / every) for b, n in bags[i].items())
        best = max(logs, key=lambda k: logs[k])
        out[i] = (best, 1 / sum(math.exp(x - logs[best]) for x in logs.values()))
    return out


def test_language_equals_naive_bayes_from_dictionaries(spark):
    stored = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in stored.collect()]
    top = max(r[0] for r in rows)
    rows += [(top + k, t, lang) for k, (t, lang) in enumerate(
        [(None, "en"), ("", None), ("12 + 3", "fr"), ("É", None), ("the", None), ("a1b, c", None), ("你好 你好", None)], 1)]
    want = naive_bayes(rows)
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    for r in got:
        lang, score = want[r["doc_id"]]
        if 0 < score < 0.501:                                   # a tie within rounding
            assert r["score"] == pytest.approx(score, abs=1e-2)
        else:
            assert (r["lang_pred"], r["score"]) == (lang, pytest.approx(score, abs=2e-3)), r["doc_id"]


# ---------------------------------------------------------------- 8: expectation-maximisation on exact counts


def exact_weights(tokens, train):
    """Weights from each training token's own counts with the token taken out, not from a histogram; and the tokens' estimates."""
    uni, bi, context = Counter(), Counter(), Counter()
    for i in train:
        pairs = list(zip(["<s>", *tokens[i][:-1]], tokens[i]))
        uni.update(b for _, b in pairs)
        bi.update(pairs)
        context["<s>"] += 1
    context.update(uni)
    n, v = sum(uni.values()), len(uni)
    by_bucket = {}
    for i in train:
        for a, b in zip(["<s>", *tokens[i][:-1]], tokens[i]):
            left = context[a] - 1
            by_bucket.setdefault(left.bit_length(), []).append(((bi[a, b] - 1) / max(left, 1), (uni[b] - 1) / (n - 1), uni[b] / (n + v)))
    weights = {}
    for k, estimates in by_bucket.items():
        p = np.array(estimates).T
        start = np.array([0.3, 0.5, 0.2] if k else [0.0, 0.7, 0.3])
        w = start.copy()
        for _ in range(lm.EM_ROUNDS):
            share = (w[:, None] * p / (w @ p)).sum(1)
            w = share + 100 * start
            w /= w.sum()
        weights[k] = w, p
    return weights


def test_mixture_weights_equal_those_of_exact_counts(spark, monkeypatch):
    rng = random.Random(9)
    follow = {f"w{k}": [f"w{rng.randrange(60)}" for _ in range(3)] for k in range(60)}
    texts = {}
    for i in range(300):                                          # words that half the time follow from the one before
        out = ["w0"]
        for _ in range(rng.randint(5, 60)):
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.5 else f"w{int(60 * rng.random() ** 2)}")
        texts[i] = " ".join(out)
    fitted, real = [], lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda h, t, **k: fitted.append(real(h, t, **k)) or fitted[-1])
    lm.score_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    tokens = {i: [*t.split(" "), "</s>"] for i, t in texts.items()}
    exact = exact_weights(tokens, [i for i in texts if brute.fold(i, 7) != 2])
    assert sum(p.shape[1] for _, p in exact.values()) > 5000
    for k, (w, p) in exact.items():
        likely = lambda x: np.log10(x @ p).mean()
        assert likely(fitted[0][k]) >= likely(w) - 0.002          # as good on the held-out tokens as the exact weights
        if p.shape[1] >= 500:
            assert fitted[0][k] == pytest.approx(w, abs=0.05)


# ---------------------------------------------------------------- ids


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(20)), ["en", "fr"][i % 2]) for i in range(40)]
    odd = [(7, "alpha beta alpha", "en"), (7, "alpha beta alpha", "en"), (7, "gamma", None), (None, "alpha beta alpha", "fr"), (None, None, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(40)] + [(None, 1), (7, 0)], "doc_id long, toxic int")

    def scored(df, *columns):
        found = df.collect()
        assert len(found) == len(rows) + len(odd)
        assert not any(r["held_out"] for r in found if r["doc_id"] is None)
        return Counter((r["doc_id"], *[r[c] for c in columns]) for r in found)

    named = langid.identify(docs.where("doc_id IS NOT NULL")).collect()
    found = scored(langid.identify(docs), "lang_pred", "score")
    assert Counter((r["doc_id"], r["lang_pred"], r["score"]) for r in named) == Counter({k: n for k, n in found.items() if k[0] is not None})  # nothing learned from the rest
    assert found[None, "und", 0.0] == 1 and 2 in found.values()
    toxic = scored(toxicity.classify(docs, labels), "score", "predicted")
    assert 2 in toxic.values() and len([k for k in toxic if k[0] is None]) <= 2
    model = scored(lm.score_documents(docs), "n_tokens", "n_known", "score")
    assert sorted(k[1] for k in model if k[0] is None) == [1, 4] and 2 in model.values()
    assert all(k[1] == k[2] for k in model if k[0] is None)         # rows without an id are learned from

    pieces = packing.pack_documents(docs, vocabulary()).collect()
    assert len(pieces) == len(rows) + len(odd)                     # all short: one piece each
    assert Counter(r["doc_id"] for r in pieces)[7] == 4 and Counter(r["doc_id"] for r in pieces)[None] == 2
    by_sequence = {}
    for r in pieces:
        assert r["start"] == 0 and r["length"] == r["doc_tokens"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1]) and sum(n for _, n in own) <= 4096
