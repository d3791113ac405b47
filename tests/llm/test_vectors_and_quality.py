"""Vector codes, centroid clusters and the quality network against plain Python versions, and their edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import centroid_clustering as clusters
from quarry.llm import quality
from quarry.llm import vector_codes as codes
from quarry.llm.queries import ORACLE, QUERIES
from tests.compare import frames_equal
from tests.conftest import SMALL

CLASH = "code string, cluster int, state binary, vec binary, id string, n long, sums array<long>, distance long, at long, ids string"
EXTRA = ["c", 1, b"s", b"v", "i", 2, [3], 4, 5, "j"]
VECTOR = f"vec_id long, embedding array<float>, label int, {CLASH}"


# ---------------------------------------------------------------- plain versions


def floors(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def usable(vector):
    return bool(vector) and all(x is not None and math.isfinite(x) for x in vector)


def square(x, c):
    return sum((a - b) ** 2 for a, b in zip(x, c))


def nearest(x, book):
    return min(range(len(book)), key=lambda j: (square(x, book[j]), j))


def means(points, own, book):
    out = []
    for j, old in enumerate(book):
        mine = [p for p, o in zip(points, own) if o == j]
        out.append([sum(col) // len(mine) for col in zip(*mine)] if mine else old)
    return out


def sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def plain_codes(rows, entries=256, rounds=4):
    """(id, vector, label) -> sorted (id, code, error, label_error, digest)."""
    rows = sorted(((i, floors(v, 1024), lab) for i, v, lab in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // 4
    code, error, final = [""] * len(rows), [0] * len(rows), []
    for p in range(4):
        points = [v[p * width: (p + 1) * width] for _, v, _ in rows]
        book = points[:entries]
        for _ in range(rounds):
            book = means(points, [nearest(x, book) for x in points], book)
        for n, x in enumerate(points):
            j = nearest(x, book)
            code[n] += f"{j:02x}"
            error[n] += square(x, book[j])
        final += [x for entry in book for x in entry]
    by_label = {}
    for (_, _, lab), e in zip(rows, error):
        by_label[lab] = by_label.get(lab, 0) + e
    return sorted((str(i), c, e, by_label[lab], sha(final)) for (i, _, lab), c, e in zip(rows, code, error))


def plain_clusters(rows, k=16, rounds=3):
    rows = [(i, floors(v, 64)) for i, v in rows if usable(v) and len(v) == 64]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    points, book = [v for _, v in rows], [v for _, v in first[:k]]
    for _ in range(rounds):
        book = means(points, [nearest(x, book) for x in points], book)
    own = [nearest(x, book) for x in points]
    far = [square(x, book[j]) for x, j in zip(points, own)]
    inertia = {j: sum(d for o, d in zip(own, far) if o == j) for j in set(own)}
    return sorted((str(i), j, d, inertia[j], sum(far), sha(book[j])) for (i, _), j, d in zip(rows, own, far))


def collected(df, columns):
    return sorted((str(r[0]), *r[1:]) for r in df.select(*columns).collect())


CODE_COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
CLUSTER_COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.fixture(scope="module")
def rows():
    """Vectors in a few heaps, copies, ties, a third under one label, unusable ones, without ids."""
    rng = random.Random(8)
    heaps = [[rng.uniform(-0.4, 0.4) for _ in range(64)] for _ in range(9)]
    out = [(i, [x + rng.gauss(0, 0.05) for x in heaps[i % 9]], None if i % 5 == 0 else 7 if i % 3 else i % 4) for i in range(300)]
    out += [(300 + i, out[i % 3][1], 1) for i in range(40)]                 # copies
    out += [(7, out[8][1], 2), (7, out[7][1], 2), (None, out[9][1], None), (None, out[9][1], 3), (-4, [0.0] * 64, 3), (341, [-0.5] * 64, 3)]
    bad = [None, [], [None] * 64, [0.1] * 63 + [None], [float("nan")] * 64, [float("inf")] + [0.0] * 63, [float("-inf")] * 64]
    return out + [(900 + i, v, 1) for i, v in enumerate(bad)]


def frame(spark, rows, parts=6):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], VECTOR).repartition(parts)


# ---------------------------------------------------------------- vector codes


@pytest.mark.parametrize("entries", [256, 37, 400])
def test_vector_codes(spark, rows, entries):
    entries = min(entries, 256)
    got = codes.compress_vectors(frame(spark, rows), entries=entries)
    assert collected(got, CODE_COLUMNS) == plain_codes(rows, entries)


def test_few_vectors_and_none(spark, rows):
    few = [r for r in rows if r[0] in (3, 5, 905)]
    assert collected(codes.compress_vectors(frame(spark, few)), CODE_COLUMNS) == plain_codes(few)
    assert collected(clusters.cluster_vectors(frame(spark, few)), CLUSTER_COLUMNS) == plain_clusters([r[:2] for r in few])
    for nothing in (frame(spark, rows[-7:]), frame(spark, rows).limit(0)):
        for found, columns in ((codes.compress_vectors(nothing), CODE_COLUMNS), (clusters.cluster_vectors(nothing), CLUSTER_COLUMNS)):
            assert found.columns == columns and found.collect() == []


def test_vectors_of_other_lengths_and_out_of_range_are_left_out(spark, rows):
    odd = [(20_000, [0.1] * 63, 1), (20_001, [0.1] * 32, 1), (20_002, [70_000.0 * 16] + [0.0] * 63, 1), (20_003, [1e30] * 64, 1)]
    got = codes.compress_vectors(frame(spark, rows + odd[:2] + odd[3:]), entries=20)
    assert collected(got, CODE_COLUMNS) == plain_codes(rows, 20)
    got = clusters.cluster_vectors(frame(spark, rows + odd))
    assert collected(got, CLUSTER_COLUMNS) == plain_clusters([r[:2] for r in rows])


@pytest.mark.parametrize("reach", [300, 1 << 25])      # distances in doubles, and beyond their exact range in longs
def test_bounds_never_change_an_assignment(reach):
    rng = np.random.default_rng(reach)
    heart = rng.integers(-reach, reach, (30, 4, 4))
    x = heart[rng.integers(0, 30, 3000)] + rng.integers(-reach // 8, reach // 8, (3000, 4, 4))
    x[:50] = x[50:100]                                  # repeated vectors
    book = x[:100].transpose(1, 0, 2).copy()
    book[:, 60] = book[:, 3]                            # equal entries: the smaller number wins
    books, state, shares = codes.Books(book[None]), None, []
    for _ in range(6):
        state, work = codes.assign(x, state, books)
        shares.append(work / (len(x) * 4 * 100))
        new = books.history[-1].copy()
        for p in range(4):
            d = ((x[:, p, None].astype(object) - books.history[-1][p][None].astype(object)) ** 2).sum(2)
            assert (state["entry"][:, p] == d.argmin(1)).all()
            own = d[np.arange(len(x)), d.argmin(1)]
            exact = state["seen"][:, p] == len(books.history) - 1
            assert (state["square"][exact, p] == own[exact]).all()
            for j in np.unique(state["entry"][:, p]):
                new[p, j] = x[state["entry"][:, p] == j, p].sum(0) // (state["entry"][:, p] == j).sum()
        books = codes.Books(np.concatenate([books.history, new[None]]))
    assert shares[0] == 1 and shares[-1] < 0.3


def test_net_displacement_is_tighter_than_summed_drifts():
    book = np.zeros((4, 1, 2), np.int64)
    there, back = book + np.array([30, 40]), book + np.array([3, 4])
    moves = codes.Books(np.stack([book, there, back])).moves()[:, 0, 0]
    assert moves.tolist() == [5, 45, 0]                 # not 50 + 45 from the first round


def test_whole_roots():
    square = np.concatenate([np.arange(2000), (np.arange(1, 1 << 30, 99_991) ** 2)[:, None].repeat(3, 1).reshape(-1) + np.tile([-1, 0, 1], 10_739)[:
        3 * len(np.arange(1, 1 << 30, 99_991))]]).astype(np.int64)
    assert codes.floor_root(square).tolist() == [math.isqrt(s) for s in square.tolist()]
    assert codes.ceil_root(square).tolist() == [math.isqrt(s) + (math.isqrt(s) ** 2 < s) for s in square.tolist()]


# ---------------------------------------------------------------- centroid clusters


@pytest.mark.parametrize("block", [4096, 7])
def test_centroid_clusters(spark, rows, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    got = clusters.cluster_vectors(frame(spark, rows))
    assert collected(got, CLUSTER_COLUMNS) == plain_clusters([r[:2] for r in rows])


def test_block_distances_are_those_of_the_integers():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-70, 70, (500, 64)), rng.integers(-70, 70, (16, 64))
    x[:, 0] = rng.integers(-(1 << 26), 1 << 26, 500)    # a dimension with a value of its own for every vector
    got = clusters.block_distances(*clusters._encode(x), c)
    assert (got == ((x[:, None] - c[None]) ** 2).sum(2)).all()


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroid_clustering"])
def test_vector_queries_match_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLE[name]).df()
    assert frames_equal(got, want) is None


# ---------------------------------------------------------------- quality


def plain_score(model, text):
    raw = (text or "").encode("utf-8", "replace")
    at = [0] if len(raw) <= quality.CHUNK else [*range(0, len(raw) - quality.CHUNK, quality.STEP), len(raw) - quality.CHUNK]
    z = []
    for s in at:
        one = [*raw[s: s + quality.CHUNK]]
        one += [quality.PAD] * (quality.CHUNK + quality.WIDTH - 1 - len(one))
        pooled = [max(0.0, max(sum(float(model.table[j][one[t + j]][f]) for j in range(quality.WIDTH)) for t in range(quality.CHUNK))
                      + float(model.bias[f])) for f in range(quality.FILTERS)]
        hidden = [max(0.0, sum(pooled[f] * float(model.hidden[f][h]) for f in range(quality.FILTERS)) + float(model.hidden_bias[h]))
                  for h in range(quality.HIDDEN)]
        z.append(sum(h * float(o) for h, o in zip(hidden, model.out)) + float(model.out_bias))
    return 1 / (1 + math.exp(-sum(z) / len(z)))


@pytest.fixture(scope="module")
def corpus():
    """(text, label): sentences against shouted, marked and tabular ones."""
    rng = random.Random(3)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(2, 9)))

    out = []
    for i in range(700):
        text = [word() for _ in range(rng.randint(20, 200))]
        if i % 4:
            out.append((" ".join(text) + ".", 1))
        elif i % 8:
            out.append((" ".join(w.upper() + "!!" for w in text), 0))
        else:
            out.append((" | ".join(text), 0))
    return out


@pytest.fixture(scope="module")
def model(corpus):
    parts = []
    for text, _ in corpus[:500]:
        raw = quality.encoded(text)
        parts.append(quality.chunks(raw, quality.starts(len(raw))))
    return quality.train(parts, [y for _, y in corpus[:500]], steps=150)


def test_chunks_cover_a_text_and_overlap():
    for size in (0, 1, 255, 256, 257, 480, 481, 10_000):
        at = quality.starts(size)
        assert at[0] == 0 and (size <= quality.CHUNK or at[-1] == size - quality.CHUNK)
        assert (np.diff(at) <= quality.STEP).all() and (np.diff(at) > 0).all()
    assert quality.STEP + quality.WIDTH - 1 <= quality.CHUNK


def test_quality_learns_and_equals_the_plain_network(corpus, model, monkeypatch):
    texts = [t for t, _ in corpus[500:]] + [None, "", "x", "é" * 4000, corpus[0][0] * 40]
    got = quality.score_texts(model, texts)
    good = np.array([y for _, y in corpus[500:]]) == 1
    assert (got[:200][good] > 0.5).mean() > 0.97 and (got[:200][~good] < 0.5).mean() > 0.97
    for i in [0, 1, 4, 8, 200, 201, 202, 203]:
        assert got[i] == pytest.approx(plain_score(model, texts[i]), rel=1e-4, abs=1e-9)
    assert [quality.score_text(model, t) for t in texts] == got.tolist()          # no text depends on its neighbours
    monkeypatch.setattr(quality, "SLICE_CHUNKS", 3)
    assert quality.score_texts(model, texts) == pytest.approx(got, rel=1e-12)


def test_one_class_or_none():
    assert (quality.score_texts(quality.train([], []), ["a", None]) < 1e-9).all()
    assert quality.score_texts(quality.train([quality.chunks(b"a", np.zeros(1, int))], [1]), ["a"])[0] == pytest.approx(1)


def test_quality_rows(spark, corpus):
    texts = {i: t for i, (t, _) in enumerate(corpus)} | {800: None, 801: "", 802: "a\ud800b".encode("utf-8", "replace").decode(), 803: "word " * 60_000}
    data = [(i, t, "s", 0.5, 1, b"c") for i, t in texts.items()] + [(5, corpus[6][0], "t", 0.1, 2, b"d")] + [(None, corpus[0][0], None, None, None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, score double, _y int, _c binary").repartition(4)
    marks = [(i, y, "a") for i, (_, y) in enumerate(corpus)] + [(3, 0, "a"), (4, None, "a"), (None, 1, "a"), (9, 5, "a"), (5_000, 1, "a")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text string")
    got = quality.classify(docs, labels, steps=100)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in data)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    first = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] != 5}
    assert first[None] == first[0] and first[800] == first[801]
    assert np.mean([(first[i] > 0.5) == (y == 1) for i, (_, y) in enumerate(corpus) if i in first]) > 0.97
    again = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels, steps=100).collect() if r["doc_id"] != 5}
    assert again == first
    # labels of held-out rows are not looked at
    flipped = labels.withColumn("quality", F.when(quality.fold("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.classify(docs, flipped, steps=100).collect() if r["doc_id"] != 5} == first
    none = quality.classify(docs, labels.limit(0)).collect()
    assert max(r["score"] for r in none) < 1e-9 and quality.classify(docs.limit(0), labels).count() == 0


def test_quality_on_the_given_tables(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = QUERIES["op11_quality"](spark, SMALL).join(labels, "doc_id").where("NOT held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
