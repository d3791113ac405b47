"""Corpus operators against brute force: null, empty, very long and repeated texts, ties, empty tables, clashing columns."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import (
    embedding_dedup, exact_dedup, langid, line_dedup, lm, minhash, mixing, packing, substring, toxicity,
)
from quarry.llm import _common as common
from quarry.llm import _fm_index as fm
from quarry.llm.queries import QUERIES, vocabulary
from tests.conftest import SMALL
from tests.llm import brute

CLASH = "kept boolean, score double, key long, n long, h string, part int, lead long, d long, t long, text_sha256 string, target string, vector string, size int"


def words(rng, n, vocabulary_size=400):
    return [f"w{rng.randrange(vocabulary_size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs():
    """id -> text with copies, near copies, shared passages, edge cases."""
    rng = random.Random(4)
    out = {i: " ".join(words(rng, rng.randint(8, 160))) for i in range(60)}
    passage = " ".join(words(rng, 70))
    for i in range(60, 75):
        out[i] = " ".join(words(rng, 30)) + "\n" + passage + " " + " ".join(words(rng, 20))
    base = words(rng, 120)
    for i in range(75, 100):                      # one base, each copy with a word or two changed
        copy = base.copy()
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"x{i}"
        out[i] = " ".join(copy)
    line = "the quick brown fox jumps over the lazy dog again and again"
    for i in range(100, 130):                     # a common line with small edits, and a common short line
        x = list(line)
        for _ in range(rng.randint(0, 4)):
            x[rng.randrange(len(x))] = rng.choice("abcé")
        out[i] = f"intro {i}\n  {''.join(x)}\t\n\nshort\n" + " ".join(words(rng, 12))
    out |= {130: None, 131: "", 132: " \n\t ", 133: "One", 134: "one", 135: "ONE two", 136: "a b c d e", 137: "A b C d e",
            138: "a  b\tc d\ne", 139: out[3], 140: out[3] + " ", 141: " ".join(["ha"] * 300), 142: " ".join(["ha"] * 280),
            143: "é ü ß 你好 " * 30, 144: " ".join(words(rng, 30_000)), 145: "x" * 60_000, 146: "don't <|endoftext|> 3.5% é!"}
    return out


@pytest.fixture(scope="module")
def table(spark, docs):
    clash = [False, 0.5, 1, 2, "h", 3, 4, 5, 6, "s", "t", "v", 7]
    sources = [None, "", "b", "a", "é"]
    langs = ["en", "fr", None]
    rows = [(i, t, langs[i % 3], sources[i % 5], 0, *clash) for i, t in docs.items()]
    df = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(5)
    return common.materialise(df)


@pytest.fixture(scope="module")
def nothing(table):
    return table.limit(0)


def by_id(df):
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


# ---------------------------------------------------------------- helpers


def test_words_split_at_ascii_space_only_and_at_documents():
    import pyarrow as pa

    texts = ["ab  cd", "", "ef", "\x1c g h\n", "AB"]
    got = []
    for lo, hi, data, offsets in common.text_slices(pa.array(texts), limit=7):
        w = common.words(data, offsets, lower=True)
        for d in range(hi - lo):
            at = slice(w.first[d], w.first[d + 1])
            got.append(([bytes(data[s:e]).decode() for s, e in zip(w.starts[at], w.ends[at])], w.hashes[at].tolist()))
    assert [g[0] for g in got] == [brute.WORD.findall(t) for t in texts]
    assert got[0][1][0] == got[4][1][0]           # A-Z folded


def test_components_of_a_path_a_star_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "b", "a").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200, 202: 200}
    assert common.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_salted_rank_is_dense(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    got = common.salted_rank(df, ["k"], [F.col("id")], "nth", salts=8).collect()
    for k in range(3):
        ranks = sorted(r["nth"] for r in got if r["k"] == k)
        assert ranks == list(range(len(ranks)))


def test_bitmap_holds_its_members(spark):
    keys = [-(1 << 63), -1, 0, 1, 5, (1 << 63) - 1, 123456789012345]
    bitmap = common.membership_bitmap(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert common.in_bitmap(bitmap, np.array(keys)).all()
    assert common.in_bitmap(bitmap, np.arange(1000, 2000)).mean() < 0.1
    assert not common.in_bitmap(common.membership_bitmap(spark.createDataFrame([], "k long"), "k"), np.array(keys)).any()


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_exact_dedup(table, docs, ranges):
    got = exact_dedup.exact_dedup(table, ranges=ranges).collect()
    want = brute.exact(docs.items())
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(want)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup_of_one_hot_group_spans_ranges(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(50)] + [(7, "sametext "), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    parts = exact_dedup.sampled_splitters(df, "doc_id", "text", 16)
    assert len({s[1] for s in parts}) < len(parts)                     # several splitters lie inside the group
    got = exact_dedup.exact_dedup(df, ranges=16).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == sorted((str(a), str(b), c) for a, b, c, _ in brute.exact(rows))
    assert [r["doc_id"] for r in got if r["kept"] and r["group_size"] == 401] == [0] and sum(r["kept"] for r in got) == 52


# ---------------------------------------------------------------- 2, 3


def test_toxicity_learns_unseen_spellings():
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        w = words(rng, rng.randint(20, 120), 3000)
        if i % 3 == 0:
            for _ in range(1 + len(w) // 30):
                w.insert(rng.randrange(len(w)), rng.choice(["grotbag", "snotling", "wretchard"]))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts[:300], labels[:300])
    score = toxicity.score_texts(model, texts[300:])
    y = np.array(labels[300:])
    assert score[y == 1].min() > score[y == 0].max()
    odd = toxicity.score_texts(model, [" ".join(words(rng, 40, 3000)) + " grotbagz grottbag", " ".join(words(rng, 40, 3000)), ""])
    assert odd[0] > 0.3 > odd[1] and 0 <= odd[2] <= 1


def test_toxicity_rows_and_stage(spark, table, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 7 == 0) for i in docs] + [(5, None, None), (None, 1, True), (10**9, 1, True)],
                                   "doc_id long, quality int, t boolean").withColumn("toxic", F.col("t").cast("int"))
    got = by_id(toxicity.classify(table, labels))
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r["held_out"] == (brute.fold(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert got[130]["score"] == got[131]["score"] == got[132]["score"]
    kept = toxicity.drop_toxic(table, labels)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    none = by_id(toxicity.classify(table, labels.limit(0)))
    assert {r["predicted"] for r in none.values()} == {0}
    assert toxicity.classify(nothing, labels).count() == 0 and toxicity.drop_toxic(nothing, labels).count() == 0


def test_language_rows(table, docs, nothing):
    got = by_id(langid.identify(table))
    assert set(got) == set(docs)
    for i, r in got.items():
        letters = any(c.isalpha() for c in docs[i] or "")
        assert r["held_out"] == (brute.fold(i, 5) == 0) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] in ("en", "fr")) if letters else (r["lang_pred"] == "und" and r["score"] == 0)
    unknown = by_id(langid.identify(table.withColumn("lang", F.lit(None).cast("string"))))
    assert {r["lang_pred"] for r in unknown.values()} == {"und"}
    assert langid.identify(nothing).count() == 0


def test_language_model_counts_are_those_of_the_texts(spark, table, docs):
    from quarry.llm._ngrams import ngrams

    model = langid.fit(table)
    assert model.langs == ["en", "fr"]
    total = np.zeros((2, 1 << langid.BITS))
    for i, t in docs.items():
        if i % 3 < 2:
            total[i % 3] += np.bincount(ngrams([t or ""], langid.SIZES, langid.BITS)[0], minlength=1 << langid.BITS)
    want = np.log(total + langid.SMOOTHING) - np.log((total + langid.SMOOTHING).sum(1, keepdims=True))
    assert np.allclose(model.log_prob, want, atol=1e-4)


def test_ngrams_stay_in_their_text():
    from quarry.llm._ngrams import ngrams

    texts = ["Ab, cd", "", "1 2", "é", "ab"]
    bucket, row = ngrams(texts, (1, 2, 3), 20)
    for i, t in enumerate(texts):
        alone = ngrams([t], (1, 2, 3), 20)[0]
        assert sorted(bucket[row == i].tolist()) == sorted(alone.tolist())
    # a word of n letters has n 1-grams, n + 1 2-grams and n 3-grams with its two marks
    assert [int((row == i).sum()) for i in range(5)] == [14, 0, 0, 4, 7]


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("crowd", [8, 1])
def test_line_dedup(table, docs, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "DIRECT_ROWS", crowd)              # 1: every segment goes through the block comparison
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 256 if crowd > 1 else 4)
    gone = brute.line_places(docs, line_dedup.EDITS, line_dedup.MIN_CHARS)
    got = by_id(line_dedup.line_digest(table))
    assert {i: list(r["removed"]) for i, r in got.items()} == gone
    assert all(r["n_lines"] == len((docs[i] or "").split("\n")) and r["n_removed"] == len(gone[i]) for i, r in got.items())


def test_line_dedup_keeps_rows_and_columns(table, docs, nothing):
    gone = brute.line_places(docs, line_dedup.EDITS, line_dedup.MIN_CHARS)
    out = line_dedup.dedup_lines(table)
    assert out.columns == table.columns and out.dtypes == table.dtypes
    for i, r in by_id(out).items():
        want = docs[i] if not gone[i] else "\n".join(x for k, x in enumerate(docs[i].split("\n")) if k not in gone[i])
        assert r["text"] == want and r["size"] == 7
    assert line_dedup.dedup_lines(nothing).count() == 0 and line_dedup.line_digest(nothing).count() == 0


def test_line_dedup_of_repeated_and_nameless_rows(spark):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "b\nc"), (None, "c\nd"), (None, "d\nd")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in got)
    assert texts[1, "a\nb"] == 2 and texts[2, "c"] == 1 and sum(x[0] is None for x in texts.elements()) == 2
    assert sum(t.split("\n").count("d") for (i, t), n in texts.items() if i is None) == 1


@pytest.mark.parametrize("crowd", [8, 1])
def test_line_dedup_of_short_lines(spark, monkeypatch, crowd):
    monkeypatch.setattr(line_dedup, "DIRECT_ROWS", crowd)
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 256 if crowd > 1 else 4)
    rng = random.Random(3)
    lines = ["Share this article on Facebook!", "Share this article on Facebook", "Share this article on Facebook..", "Yes.", "Yes"]
    for n in [18, 19, 20, 21, 25, 33, 38, 39, 40, 41, 42, 60]:
        base = [rng.choice("abcdefgh ") for _ in range(n - 2)]
        for _ in range(12):
            x = base.copy()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x))
                x[k: k + rng.randint(0, 1)] = rng.choice(["", "z", "y"])
            lines.append("<" + "".join(x) + ">")
    lines = list(dict.fromkeys(lines))
    g = brute.Groups()
    for n, x in enumerate(lines):
        for m in range(n):
            size = min(len(x), len(lines[m]))
            if brute.edit_distance(x, lines[m]) <= (2 if size >= 40 else 1 if size >= 20 else 0):
                g.join(n, m)
    got = by_id(line_dedup.line_digest(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)))
    assert {i: r["n_removed"] for i, r in got.items()} == {i: int(g.find(i) != i) for i in range(len(lines))}
    assert [got[i]["n_removed"] for i in range(5)] == [0, 1, 0, 0, 0]


def test_within_edits():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randrange(10))] for _ in range(2))
        for k in (1, 2, 3):
            assert line_dedup.within_edits(np.array(a), np.array(b), k) == (brute.edit_distance(a, b) <= k)


# ---------------------------------------------------------------- 5


def vectors(seed=0, n=400, dim=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for c in range(6):                                   # chains and clouds of near copies
        x[50 * c: 50 * c + 30] = x[50 * c] + rng.standard_normal((30, dim)) * (0.05 + 0.04 * c)
    x[390:] = x[5] * 3
    return x.astype(np.float32)


def brute_links(x, threshold):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    g = brute.Groups()
    for i, j in zip(*np.nonzero(near)):
        g.join(int(i), int(j))
    return near.sum(1), [g.find(i) for i in range(len(x))]


@pytest.mark.parametrize("parts", [None, 16])
def test_embedding_dedup(spark, monkeypatch, parts):
    if parts:                                            # hot lists: many index parts and query parts
        monkeypatch.setattr(embedding_dedup, "INDEX_PART", parts)
        monkeypatch.setattr(embedding_dedup, "QUERY_PART", 3 * parts)
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 40)
    x = vectors()
    links, comp = brute_links(x, 0.95)
    rows = [(i, v.tolist(), 1, 9) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [None] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, 0, 9) for i, v in enumerate(odd)] + [(None, x[60].tolist(), 0, 9), (None, [3.0, -1.0], 0, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    got = embedding_dedup.embedding_dedup(df).collect()
    named = {r["vec_id"]: r for r in got if r["vec_id"] is not None}
    near_null = {i for i in range(400) if i != 60 and x[i] @ x[60] / np.linalg.norm(x[i]) / np.linalg.norm(x[60]) >= 0.95} | {60}
    for i in range(400):
        assert (named[i]["n_links"], named[i]["component_id"]) == (links[i] + (i in near_null), comp[i])
    assert [named[1000 + i]["n_links"] for i in range(8)] == [0] * 6 + [1, 1]
    assert [named[1000 + i]["component_id"] for i in range(8)] == [1000, 1001, 1002, 1003, 1004, 1005, 1006, 1006]
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None} == {(len(near_null), comp[60], False), (0, None, True)}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in named.values())
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim, inner", [(256, 8), (64, 64)])
def test_embedding_dedup_of_vectors_near_a_small_subspace(spark, monkeypatch, dim, inner):
    monkeypatch.setattr(embedding_dedup, "LIST_ROWS", 40)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((500, inner))
    x = np.repeat(base, 4, axis=0) + rng.standard_normal((2000, inner)) * 0.15
    x = (x @ rng.standard_normal((inner, dim)) + rng.standard_normal((2000, dim)) * 0.01).astype(np.float32)
    links, comp = brute_links(x, 0.95)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df).collect()}
    assert links.sum() > 2000 and [got[i]["n_links"] for i in range(2000)] == links.tolist()
    assert [got[i]["component_id"] for i in range(2000)] == comp


# ---------------------------------------------------------------- 6


def test_fit_lengths_reaches_what_can_be_reached():
    rng = random.Random(2)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
        counts = [rng.randint(1, 5) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randint(0, total)
        take = mixing.fit_lengths(lengths, counts, budget)
        reach = {0}
        for n, c in zip(lengths, counts):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        assert all(0 <= k <= c for k, c in zip(take, counts))
        assert sum(a * b for a, b in zip(lengths, take)) == max(r for r in reach if r <= budget)
    assert mixing.fit_lengths([0, 5], [3, 0], 10) == [0, 0]


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * float(sizes[s])
            rest -= target[s]
        open_ -= full
    return target


def test_mixing(table, docs, nothing):
    sources = [None, "", "b", "a", "é"]
    size = {i: len(brute.WORD.findall(t or "")) for i, t in docs.items()}
    of = {i: sources[i % 5] for i in docs}
    sizes = {s: sum(n for i, n in size.items() if of[i] == s) for s in sources}
    targets = brute_targets(sizes)
    got = by_id(mixing.mix_sources(table))
    assert got == by_id(mixing.mix_sources(table.repartition(3)))       # reruns agree
    for i, r in got.items():
        assert r["size"] == size[i] and r["source_size"] == sizes[of[i]] and r["target"] == pytest.approx(targets[of[i]])
        assert r["taken"] in {k * size[i] for k in range(4)}
    for s in sources:
        taken = sum(r["taken"] for i, r in got.items() if of[i] == s)
        # one document of this source is larger than the target: three times the others is the most there is
        most = 3 * sum(size[i] for i in docs if of[i] == s and size[i] <= targets[s])
        assert abs(taken - min(targets[s], most)) <= 2, s
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    assert copies == Counter({i: r["taken"] // r["size"] if r["size"] else 1 for i, r in got.items() if r["taken"] or not r["size"]})
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_mixed_rows_that_share_an_id_or_have_none(spark):
    """Every row is decided on its own: the mix holds the words that were planned."""
    rows = [(7, "a " * 10, "x"), (7, "b " * 200, "x"), (7, "b " * 200, "x"), (None, "c " * 30, "x"), (None, "d " * 31, None), (None, "d " * 31, None), (1, "", "x")]
    rows += [(100 + i, "e " * (20 + i % 5), "yz"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mixing.mixed_documents(df).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    targets, got, each = brute_targets(sizes), Counter(), Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    for (_, text, source), times in each.items():
        got[source] += times * len(text.split())
    for row, times in each.items():
        assert times <= 3 * rows.count(row)
    for source in sizes:
        longest = max(len(text.split()) for _, text, s in rows if s == source)
        assert abs(got[source] - targets[source]) <= longest, source
    assert each[(1, "", "x")] == 1
    again = mixing.mixed_documents(df.repartition(2)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 10, "b": 1000, None: 500, "z": 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got == {s: pytest.approx(t) for s, t in want.items()} and got["a"] == 30 and sum(got.values()) == pytest.approx(1511)


# ---------------------------------------------------------------- 7


def test_minhash(table, docs, nothing):
    want = brute.near(docs, 85)
    got = by_id(minhash.near_dedup(table, percent=85))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    kept = minhash.one_per_group(table, percent=85)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}
    assert minhash.near_dedup(nothing).count() == 0 and minhash.one_per_group(nothing).count() == 0


def test_minhash_of_texts_that_share_an_id(spark):
    """Texts of one id are compared apart, and the id joins what they link with."""
    rng = random.Random(9)
    a, b, c, d = (words(rng, n, 5000) for n in (60, 300, 80, 90))
    near = a.copy()
    near[30] = "changed"
    other = c.copy()
    other[5] = "changed"
    rows = [(1, " ".join(a)), (1, " ".join(b)), (3, " ".join(near)), (5, " ".join(c)), (6, " ".join(other)), (6, " ".join(d)), (8, " ".join(d)), (8, ""), (9, " ".join(d)),
            (None, " ".join(b)), (11, " ".join(words(rng, 40, 5000))), (11, None)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"])
                 for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    root = {"1": 1, "3": 1, "5": 5, "6": 5, "8": 5, "9": 5, "11": 11, "None": 1}
    want = [(str(i), max(0, len(t.split()) - 4) if t else 0, root[str(i)] if t else i, (root[str(i)] if t else i) == i) for i, t in rows]
    assert got == sorted(want)


def test_minhash_of_many_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_NODES", 8)
    rng = random.Random(6)
    base, docs = words(rng, 100, 5000), {}
    for i in range(150):
        copy = base.copy()
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(100)] = f"y{rng.randrange(20)}"
        docs[i] = " ".join(copy)
    rows = list(docs.items()) + [(3, docs[3]), (None, docs[7]), (None, "nothing like any other text here at all")]
    got = minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=80).collect()
    want = brute.near(docs, 80)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == {i: c for i, (_, c) in want.items()}
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == sorted([str(want[7][1]), "None"])


def test_minhash_of_strays_just_below_the_threshold_in_a_group_of_several_blocks(spark):
    rng = random.Random(8)
    base = [f"v{i}" for i in range(3000)]
    docs = {i: " ".join([*base, f"end{i}"]) for i in range(minhash.CELL_NODES + 24)}
    strays = range(1000, 1004)
    for i in strays:
        copy = base.copy()
        for k in rng.sample(range(1, 299), 49):              # 49 single words, 5 shingles each
            copy[10 * k] = f"z{i}_{k}"
        docs[i] = " ".join([*copy, f"end{i}"])
    sets = {i: brute.shingles(t) for i, t in docs.items()}
    assert not any(100 * len(sets[i] & s) >= 85 * len(sets[i] | s) for i in strays for j, s in sets.items() if i != j)
    got = by_id(minhash.near_dedup(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3), percent=85))
    assert {i: r["component_id"] for i, r in got.items()} == {i: i if i in strays else 0 for i in docs}


def test_minhash_finds_pairs_at_80_percent(spark):
    rng = random.Random(21)
    rows = []
    for i in range(1500):
        text = [f"{rng.randrange(10**6)}" for _ in range(184)]         # 180 shingles, 4 words changed: 160 of 200 shared
        copy = text.copy()
        for k in (20, 60, 100, 140):
            copy[k] = f"c{i}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    got = by_id(minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=80))
    assert [i for i in range(3000) if got[i]["component_id"] != i - i % 2] == []
    assert [minhash.bands_for(p) for p in (80, 85)] == [24, 20]


def test_one_row_per_group_keeps_every_text_of_an_id(spark):
    rng = random.Random(5)
    text = [" ".join(words(rng, 60, 5000)) for _ in range(4)]
    rows = [(7, text[0], "a"), (7, text[1], "b"), (7, text[1], "c"), (7, text[2] + " end", "d"), (9, text[2], "e"), (9, text[3], "f"),
            (8, None, "g"), (None, text[3], "h"), (7, text[0], "a")]
    seen = set()
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, more string")
        out = minhash.one_per_group(df.repartition(3))
        assert out.dtypes == df.dtypes
        got = out.collect()
        seen.add(frozenset(map(tuple, got)))
        named = Counter((r["text"] or "").removesuffix(" end") for r in got if r["doc_id"] is not None)
        assert named == Counter([*text, ""]) and [r["more"] for r in got if r["doc_id"] is None] == ["h"]
    assert len(seen) == 1


def test_registers_order_like_the_hashes_and_estimates_are_near():
    v = np.sort(common.mix64(np.arange(1, 5000, dtype=np.uint64)))
    r = minhash._register(v)
    assert ((np.diff(r.astype(int) >> minhash.MANTISSA_BITS)) <= 0).all() and (r > 0).all()
    rng = np.random.default_rng(5)
    h = common.mix64(np.arange(20_000, dtype=np.uint64))
    for shared in (0.2, 0.5, 0.85, 0.95):
        errors = []
        for _ in range(20):
            pick = rng.permutation(20_000)[:2000]
            k = int(2000 * 2 * shared / (1 + shared))
            a, b = np.sort(h[pick[:2000]]), np.sort(np.concatenate([h[pick[:k]], common.mix64(rng.integers(1 << 40, 1 << 60, 2000 - k).astype(np.uint64))]))
            s = minhash.sketches(np.concatenate([a, b]), np.array([0, 2000, 4000]))
            errors.append(minhash.estimate(s[:1], s[1:], np.array([2000]), np.array([2000]))[0] - shared)
        assert abs(np.mean(errors)) < 0.04


# ---------------------------------------------------------------- 8


def brute_lm_base(docs, held):
    tokens = {i: brute.WORD.findall((t or "").translate(brute.LOWER)) + ["</s>"] for i, t in docs.items()}
    count = Counter(x for i, w in tokens.items() if not held(i) for x in w)
    n, v = sum(count.values()), len(count)
    return tokens, count, n, {i: sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) for i, w in tokens.items()}


def brute_lm_score(tokens, train, weights):
    """Score with given mixture weights from plain dictionaries."""
    uni, bi, ctx = Counter(), Counter(), Counter()
    for i in train:
        for a, b in zip(["<s>", *tokens[i][:-1]], tokens[i]):
            uni[b] += 1
            bi[a, b] += 1
    for i in train:
        ctx["<s>"] += 1
    ctx.update(uni)
    n, v = sum(uni.values()), len(uni)
    out = {}
    for i, w in tokens.items():
        total = 0.0
        for a, b in zip(["<s>", *w[:-1]], w):
            bucket = ctx[a].bit_length()
            p = (bi[a, b] / ctx[a] if ctx[a] else 0.0, uni[b] / n, (uni[b] + 1) / (n + v + 1))
            total += math.log10(float(np.dot(weights[bucket], p)))
        out[i] = total
    return out


@pytest.mark.parametrize("chunk", [2_000_000, 500])
def test_language_model(table, docs, nothing, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", chunk)
    fitted = []
    real = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda h, t, **k: fitted.append(real(h, t, **k)) or fitted[-1])
    got = by_id(lm.score_documents(table))
    held = lambda i: brute.fold(i, 7) == 2
    tokens, count, n, base = brute_lm_base(docs, held)
    assert set(got) == set(docs)
    full = brute_lm_score(tokens, [i for i in docs if not held(i)], fitted[0])
    for i, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(tokens[i]), n)
        assert r["n_known"] == sum(count[x] > 0 for x in tokens[i])
        assert r["base_score"] == pytest.approx(base[i]) and r["score"] == pytest.approx(full[i])
    assert fitted[0].sum(1) == pytest.approx(np.ones(lm.CONTEXTS)) and (fitted[0] >= 0).all()
    assert lm.score_documents(nothing).count() == 0


def test_mixture_weights_prefer_what_predicts():
    import pandas as pd

    totals = lm.Totals(1000, 100, 10, 48)
    good = pd.DataFrame({"context": [5, 5], "bigram": [-2, -4], "count": [4, 8], "n": [500, 500]})
    poor = pd.DataFrame({"context": [6, 6], "bigram": [-1000, -1000], "count": [12, 16], "n": [500, 500]})
    w = lm.mixture_weights(pd.concat([good, poor]), totals)
    assert w[5][0] > 0.8 and w[6][0] < 0.1


def test_packed_integers_round_trip():
    x = np.array([0, 5, 5, 1 << 40, (1 << 64) - 1], np.uint64)
    assert (lm._unpack(lm._pack(x)) == x).all() and (lm._unpack(lm._pack(x, True), True) == x).all()
    assert len(lm._unpack(lm._pack(x[:0], True), True)) == 0


# ---------------------------------------------------------------- 9


def test_packing(table, docs, nothing):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs.items()}
    rows = packing.pack_documents(table, vocabulary()).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        part = np.array(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, own in pieces.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1]) and sum(r["length"] for r in own) == len(ids[i])
    assert set(pieces) == set(docs) and sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0, *[r["length"] for r in own]])[:-1]) and sum(r["length"] for r in own) <= 4096
    assert packing.pack_documents(nothing, vocabulary()).count() == 0


def test_shortest_pack_first_holds_every_piece():
    rng = random.Random(7)
    histogram = Counter(min(4096, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(20_000))
    patterns = packing.shortest_pack_first(histogram)
    held = Counter()
    for lengths, packs in patterns:
        assert 0 < sum(lengths) <= 4096 and packs > 0
        for n in lengths:
            held[n] += packs
    assert held == histogram
    assert sum(n * c for n, c in histogram.items()) / (4096 * sum(c for _, c in patterns)) > 0.98
    places = packing._places(patterns)
    taken = Counter()
    for n, c in histogram.items():
        first, sequence, offset = places[n]
        for k in range(c):
            run = np.searchsorted(first, k, "right") - 1
            taken[int(sequence[run] + k - first[run])] += n
    assert max(taken.values()) <= 4096 and len(taken) == sum(c for _, c in patterns)


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("shard_words", [400_000, 200])
def test_substring_dedup(table, docs, nothing, shard_words):
    want = brute.substring(docs, 50)
    got = by_id(substring.substring_dedup(table, shard_words=shard_words))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == want
    assert substring.substring_dedup(nothing).count() == 0


def test_substring_dedup_short_windows_and_nameless_rows(spark):
    rng = random.Random(9)
    rows = {i: " ".join(words(rng, rng.randint(0, 60), 5)) for i in range(40)}       # few words: repeats everywhere
    df = spark.createDataFrame([*rows.items(), (None, rows[3]), (None, "a b")], "doc_id long, text string")
    got = substring.substring_dedup(df, window=12, gram=4, shard_words=150).collect()
    want = brute.substring({**rows, 10**6: rows[3]}, 12)
    assert {r["doc_id"]: r["kept_sha256"] for r in got if r["doc_id"] is not None} == {i: w[2] for i, w in want.items() if i < 10**6}
    assert sorted(r["n_removed"] for r in got if r["doc_id"] is None) == sorted([want[10**6][1], 0])


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(1, 6, rng.integers(1, 60)) for _ in range(12)] + [np.ones(70, np.int64)]
    index = fm.FMIndex(np.concatenate(sequences), np.array([len(s) for s in sequences]), 5)
    for _ in range(200):
        pattern = rng.integers(1, 6, rng.integers(1, 7))
        low, high = np.zeros(1, np.int64), np.full(1, index.size)
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        want = Counter()
        for k, s in enumerate(sequences):
            want[k] += sum((s[p: p + len(pattern)] == pattern).all() for p in range(len(s) - len(pattern) + 1))
        found = Counter(index.sequence[low[0]: high[0]].tolist()) if high[0] > low[0] else Counter()
        assert +found == +want
    values = rng.integers(0, 100, 50)
    mins = fm.RangeMin(values)
    for a in range(50):
        for b in range(a + 1, 51):
            assert mins.of(np.array([a]), np.array([b]))[0] == values[a:b].min()


# ---------------------------------------------------------------- queries and pipeline


def test_every_query_returns_a_row_per_row(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, query in QUERIES.items():
        df = query(spark, SMALL)
        if name.startswith("op5_"):
            assert df.count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
        elif name.startswith("op9_"):
            assert df.select("doc_id").distinct().count() == n
        else:
            assert df.count() == n and df.select("doc_id").distinct().count() == n, name
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 11))


def test_exact_dedup_matches_sql(spark, duck):
    from quarry.llm.queries import ORACLE
    from tests.compare import frames_equal

    for name, sql in ORACLE.items():
        assert frames_equal(QUERIES[name](spark, SMALL).toPandas(), duck.execute(sql).df()) is None, name


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialise(stage(spark, docs, SMALL))
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns, name
        assert out.count() <= rows or name == "mixing"
        if name == "line_dedup":
            assert out.count() == rows
        if name == "minhash":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {r["doc_id"] for r in out.collect()} == {i for i, (_, c) in brute.near(texts, 80).items() if c == i}
        docs, rows = out, out.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash", "mixing", "packing"]
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_rounds_of_components_are_written_in_few_files(spark, monkeypatch):
    """Every round once wrote a file for each shuffle partition, however few edges it had."""
    written = []
    kept = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df: written.append(kept(df)) or written[-1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(60).where("id % 20 <> 19").selectExpr("id AS a", "id + 1 AS b")
        got = {r["node"]: r["root"] for r in common.components(edges, "a", "b").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: n // 20 * 20 for n in range(60)}
    assert len(written) > 2 and all(df.rdd.getNumPartitions() == 1 for df in written[1:])
