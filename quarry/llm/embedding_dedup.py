"""Embedding near-dedup: inverted lists with product-quantised residuals and exact cosine rerank.

Unit vectors are assigned to the nearest of a few hundred to a few thousand
coarse centroids; an inverted list holds their residuals as one code per
subspace, together with the length of what the codes miss.  Centroids and
codebooks are trained on a bounded sample, every vector is indexed.

The probes are sufficient: the distances of two vectors of different lists to
the border between the two centroids add up along the line of the centroids,
so for a linked pair they add up to no more than the link radius, and the
nearer of the two lies within half of it.  Each vector therefore asks every
list, lower or higher, whose border lies within half the link radius; a pair
that both sides find is counted in the lower list.  A pair is dropped by its
table-lookup distance only if the distance, less what the codes miss, exceeds
the radius, and links are confirmed by cosine in double precision.  So the
search loses no link up to rounding, whatever the vectors' directions.

A list's rows are cut into index parts and query parts and every pair of
parts is one group, so a hot list spreads over many tasks; a group returns one
row per linked vector (number of links, smallest vector of its local
component), never its pairs.

Defined cases: null, empty and zero vectors and vectors with null or
non-finite components link with nothing; vectors of different lengths are
never compared; equal vectors are one node; rows without an id link like
others but name no component; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._common import components, materialise, prepare, tidy

SAMPLE = 20_000              # vectors that centroids and codebooks are trained on, at most
LIST_ROWS = 256              # wished rows of a list
MAX_LISTS = 4096
SUBSPACES = 8
CODES = 64
INDEX_PART = 2048            # rows of a list's index part and query part in one group
QUERY_PART = 8192
ROUNDS = 8
NO_ID = 1 << 62


class Quantiser(NamedTuple):
    centroids: np.ndarray                # lists x dimensions
    books: list[np.ndarray]              # per subspace: codes x its dimensions
    cuts: list[slice]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _square_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_square_distances(part, c).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def train(sample: np.ndarray, total: int, seed: int = 9) -> Quantiser:
    """Coarse centroids and residual codebooks from unit rows."""
    rng = np.random.default_rng(seed)
    centroids = _k_means(sample, int(max(1, min(MAX_LISTS, total // LIST_ROWS, len(sample) // 4))), ROUNDS, rng)
    rest = sample - centroids[_square_distances(sample, centroids).argmin(1)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    cuts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]
    return Quantiser(centroids, [_k_means(rest[:, s], CODES, ROUNDS, rng) for s in cuts], cuts)


ENTRY = "list int, own int, role int, node long, copies long, code binary, missed double, lower binary, vector binary"


def _entries(q: Quantiser, radius: float, kind: str):
    """Vectors -> one entry in their own list (role 3) and one query entry (role 2) per further list to search."""
    gap = np.sqrt(_square_distances(q.centroids, q.centroids))
    cells = np.arange(len(q.centroids))[None, :]

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.iloc[at: at + 1024]
                x = unit_rows(np.stack([np.asarray(v, kind) for v in part["embedding"]]))
                d2 = _square_distances(x, q.centroids)
                own = d2.argmin(1)
                nearest = d2[np.arange(len(x)), own]
                rest = x - q.centroids[own]
                code = np.stack([_square_distances(rest[:, s], book).argmin(1) for s, book in zip(q.cuts, q.books)], 1).astype(np.uint8)
                decoded = np.concatenate([book[code[:, m]] for m, book in enumerate(q.books)], 1)
                missed = np.sqrt(((rest - decoded) ** 2).sum(1))
                # distance to the border with another cell is (d2 - nearest) / (2 gap); of a linked pair one is within radius / 2
                reach = d2 - nearest[:, None] <= (radius + 1e-6) * gap[own] + 1e-9
                reach[np.arange(len(x)), own] = True
                lower = [np.flatnonzero(r).astype("<u2").tobytes() for r in reach & (cells < own[:, None])]
                row, cell = np.nonzero(reach)
                home = cell == own[row]
                raw = [np.asarray(v, kind).tobytes() for v in part["embedding"]]
                codes = [v.tobytes() for v in code]
                yield pd.DataFrame({
                    "list": cell.astype(np.int32), "own": own[row].astype(np.int32), "role": np.where(home, 3, 2).astype(np.int32),
                    "node": part["node"].to_numpy()[row], "copies": part["copies"].to_numpy()[row],
                    "code": [codes[r] if h else b"" for r, h in zip(row, home)], "missed": missed[row],
                    "lower": [lower[r] if h else b"" for r, h in zip(row, home)], "vector": [raw[r] for r in row]})
    return run


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search(q: Quantiser, threshold: float, radius: float, kind: str):
    @tidy
    def run(g: pd.DataFrame) -> pd.DataFrame:
        role, node, copies = g["role"].to_numpy(), g["node"].to_numpy(), g["copies"].to_numpy()
        indexed, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        found_q, found_x = [], []
        if len(indexed) and len(asked):
            x = unit_rows(np.frombuffer(b"".join(g["vector"]), kind).reshape(len(g), -1))
            code = np.frombuffer(b"".join(g["code"].to_numpy()[indexed]), np.uint8).reshape(len(indexed), -1)
            limit = radius + g["missed"].to_numpy()[indexed] + 1e-6
            home, own = g["home"].to_numpy(), g["own"].to_numpy().astype(np.int64)
            here, lists = int(g["list"].iloc[0]), len(q.centroids)
            centre = q.centroids[here]
            asks = [np.frombuffer(v, "<u2") for v in g["lower"].to_numpy()[indexed]]      # lower lists that each indexed vector asks itself
            asks = np.repeat(indexed, [len(v) for v in asks]) * lists + np.concatenate(asks)
            for at in range(0, len(asked), 256):
                rows = asked[at: at + 256]
                rest = x[rows] - centre
                distance = np.zeros((len(rows), len(indexed)))
                for m, (s, book) in enumerate(zip(q.cuts, q.books)):
                    distance += _square_distances(rest[:, s], book)[:, code[:, m]]
                near = distance <= limit * limit
                # in its own list a vector meets each pair twice: keep the larger as the query
                near &= ~home[rows][:, None] | (node[rows][:, None] > node[indexed][None, :])
                i, j = np.nonzero(near)
                i, j = rows[i], indexed[j]
                ok = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[ok], j[ok]
                ok = (own[i] >= here) | ~np.isin(j * lists + own[i], asks)               # else the lower list counts it
                found_q.append(i[ok])
                found_x.append(j[ok])
        if not sum(map(len, found_q)):
            return pd.DataFrame({"node": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "lead": pd.Series(dtype="int64")})
        a, b = np.concatenate(found_q), np.concatenate(found_x)
        order = np.argsort(node, kind="stable")                       # local labels in the order of nodes
        place = np.empty(len(node), np.int64)
        place[order] = np.arange(len(node))
        lead = node[order][_local_components(len(node), place[a], place[b])[place]]
        links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
        hit = np.flatnonzero(links)
        return pd.DataFrame({"node": node[hit], "links": links[hit].astype(np.int64), "lead": lead[hit]})
    return run


def _links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, links, lead) partial results of the vectors of one length."""
    own = classes.where(F.size("embedding") == dim)
    total = own.count()
    sample = own.orderBy(F.xxhash64(F.lit(3), "node"), "node").limit(SAMPLE).select("embedding").toArrow().column(0).to_pylist()
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    kind = "<f4" if isinstance(own.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    q = train(unit_rows(np.stack([np.asarray(v, kind) for v in sample])), total)
    shared = own.sparkSession.sparkContext.broadcast(q)                # at most MAX_LISTS centroids and the codebooks
    entries = materialise(own.select("node", "copies", "embedding").mapInPandas(lambda it: _entries(shared.value, radius, kind)(it), ENTRY))
    sizes = entries.groupBy("list").agg(F.count_if(F.col("role") == 3).alias("i"), F.count(F.lit(1)).alias("q"))
    sizes = sizes.select("list", F.ceil(F.col("i") / INDEX_PART).cast("int").alias("i"), F.ceil(F.col("q") / QUERY_PART).cast("int").alias("q")).where("i > 0")
    mine = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cell = lambda i, j, role: F.struct(i.alias("a"), j.alias("b"), role.alias("as"))
    as_index = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda j: cell(mine("i"), j, F.when(mine("q") == j, 3).otherwise(1)))
    as_query = F.transform(F.sequence(F.lit(0), F.col("i") - 1), lambda i: cell(i, mine("q"), F.when((mine("i") == i) & (F.col("role") == 3), 0).otherwise(2)))
    dealt = entries.join(sizes, "list").withColumn(
        "cell", F.explode(F.when(F.col("role") == 3, F.concat(as_index, as_query)).otherwise(as_query))).where("cell.as > 0")
    dealt = dealt.select("list", "cell.a", "cell.b", F.col("cell.as").alias("role"), (F.col("role") == 3).alias("home"),
                         "own", "node", "copies", "code", "missed", "lower", "vector")
    return dealt.groupBy("list", "a", "b").applyInPandas(lambda g: _search(shared.value, threshold, radius, kind)(g), "node long, links long, lead long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    prepare(vectors.sparkSession)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    good = v.isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good, v).alias("embedding")))
    usable = rows.where("embedding IS NOT NULL")
    classes = materialise(
        usable.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
        .withColumn("node", F.coalesce("node", F.lit(NO_ID) + F.shiftright(F.abs(F.xxhash64("embedding")), 2))))
    found = None
    for r in sorted(classes.select(F.size("embedding").alias("n")).distinct().collect()):   # vector lengths: one, as a rule
        part = _links(classes, r["n"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        named = classes.select("embedding", "node", "copies").withColumns({"links": F.lit(0).cast("long"), "root": F.col("node")})
    else:
        found = materialise(found)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(found.where("node <> lead"), "node", "lead")
        named = classes.join(links, "node", "left").join(roots, "node", "left").select(
            "embedding", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    out = rows.join(named, "embedding", "left")
    component = F.when(F.col("embedding").isNull(), F.col("vec_id")).when(F.col("root") < NO_ID, F.col("root"))
    return out.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"),
    )
