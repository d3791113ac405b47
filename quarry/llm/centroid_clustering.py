"""Centroid clustering of vectors by scalar lookup tables.

Components become integers, and vectors are packed into blocks that hold each
dimension's occurring integer values once and, for every vector, the places of
its components among them.  A round tabulates the squared difference of every
(dimension, occurring value, centroid) of a block; the distances of its vectors
are gathers from that table and sums over dimensions, all in integers.  Per
task and cluster one partial sum moves on; the driver sees the centroids only.

Memory: a block holds BLOCK vectors, its table at most dims x BLOCK x clusters
numbers (fewer where values recur, as they do for integers of bounded vectors).

Defined cases: vectors that are null, of another length, or with null or
non-finite components are left out, and so are those whose integers reach
2**26 in size (their distances do not fit a long); rows without an id take part
but start a centroid only after all others; rows that repeat an id or a vector
are all kept, equal hashes are ordered by the vector; with fewer vectors than
clusters each starts one; no vector at all gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from quarry.llm._common import materialise, prepare
from quarry.llm._vectors import doubles, integers, packed, sums_by, unpacked, usable

DIMS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
BLOCK = 4096


def _encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(occurring values of all dimensions end to end, first place of each dimension, place of every component)."""
    values, codes, first = [], np.empty(x.shape, np.uint16), np.zeros(x.shape[1] + 1, np.int64)
    for d in range(x.shape[1]):
        seen, codes[:, d] = np.unique(x[:, d], return_inverse=True)
        values.append(seen)
        first[d + 1] = first[d] + len(seen)
    return np.concatenate(values), first, codes


def block_distances(values: np.ndarray, first: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(vectors, centroids) squared distances of a block, from its table of squared differences."""
    dim = np.repeat(np.arange(len(first) - 1), np.diff(first))
    table = values[:, None] - centroids.T[dim]
    table *= table
    out = np.zeros((len(codes), len(centroids)), np.int64)
    for d in range(codes.shape[1]):
        out += table.take(codes[:, d] + first[d], axis=0)
    return out


def _blocks(vectors: DataFrame, scale: int, dims: int) -> DataFrame:
    """Blocks of (id, vec): ids, values, first, codes (places as 16-bit numbers)."""
    ids = ArrayType(vectors.schema["id"].dataType)
    schema = StructType([StructField("ids", ids), StructField("values", BinaryType()), StructField("first", BinaryType()),
                         StructField("codes", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                values, first, codes = _encode(integers(part.column("vec"), scale, dims))
                held = part.column("id")
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                     packed(values[None]), packed(first[None]), packed(codes.reshape(1, -1))],
                    ["ids", "values", "first", "codes"])

    return vectors.mapInArrow(run, schema)


def _opened(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        values, first, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), t)
                                for c, t in (("values", np.int64), ("first", np.int64), ("codes", np.uint16)))
        yield batch.column("ids")[i].values, values, first, codes.reshape(-1, dims)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """cluster -> (vectors, sums of their components and, last, of their distances)."""
    k, dims = centroids.shape
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, values, first, codes in _opened(batch, dims):
                d = block_distances(values, first, codes, shared.value)
                own = d.argmin(1)
                n += np.bincount(own, minlength=k)
                np.add.at(total[:, dims], own, d[np.arange(len(own)), own])
                for j in range(dims):
                    np.add.at(total[:, j], own, values[codes[:, j] + first[j]])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    found = sums_by(blocks.mapInArrow(run, "cluster long, n long, sums array<long>"), ["cluster"], dims + 1)
    return {r["cluster"]: (r["n"], np.array(r["total"])) for r in found.collect()}   # one row a cluster


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
                    rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, first: Column | None = None) -> DataFrame:
    """One row per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``clusters`` vectors that come first by
    ``first`` (by default the sha256 of ``1:<id>``).
    """
    spark = vectors.sparkSession
    prepare(spark)
    base = vectors.select(F.col(id_col).alias("id"), doubles(vector_col).alias("vec"))
    base = base.where(usable(F.col("vec"), scale) & (F.size("vec") == dims))
    order = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256) if first is None else first
    start = base.orderBy(order.asc_nulls_last(), "vec").limit(clusters).collect()       # ``clusters`` rows
    kind = vectors.schema[id_col].dataType
    schema = StructType([StructField(id_col, kind), *[StructField(c, LongType()) for c in ("cluster", "distance")]])
    if not start:
        found = spark.createDataFrame([], schema)
        return found.selectExpr(f"`{id_col}`", "CAST(cluster AS INT) AS cluster", "distance", "0L AS cluster_inertia", "0L AS inertia",
                                "'' AS centroid_sha256")
    centroids = np.floor(np.array([r["vec"] for r in start]) * float(scale)).astype(np.int64)
    blocks = materialise(_blocks(base, scale, dims))
    for _ in range(rounds):
        for c, (n, total) in _sums(blocks, centroids).items():
            centroids[c] = total[:dims] // n
    last = _sums(blocks, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, values, first, codes in _opened(batch, dims):
                d = block_distances(values, first, codes, shared.value)
                own = d.argmin(1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(d[np.arange(len(own)), own])],
                                                 [id_col, "cluster", "distance"])

    within = {c: int(total[dims]) for c, (_, total) in last.items()}
    names = [(c, within[c], hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in within]
    about = spark.createDataFrame(names, "cluster long, cluster_inertia long, centroid_sha256 string")   # one row a cluster
    return blocks.mapInArrow(run, schema).join(F.broadcast(about), "cluster").select(
        id_col, F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia",
        F.lit(sum(within.values())).cast("long").alias("inertia"), "centroid_sha256")


_ASSIGN = """
  a{r} AS MATERIALIZED (SELECT vid, rn, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT x.vid, x.rn, x.v, c.cluster, CAST(x.norm - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v) AS BIGINT) AS d
    FROM kept x, c{r} c) GROUP BY ALL)"""

_MOVE = """
  m{r} AS MATERIALIZED (SELECT cluster, list(m ORDER BY j) AS v FROM (
    SELECT cluster, j, floor(sum(x) / count(*)) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS j FROM a{r}) GROUP BY cluster, j)
    GROUP BY cluster),
  c{s} AS MATERIALIZED (SELECT cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""

ORACLE_SQL = """
WITH
  kept AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS norm FROM (
    SELECT vec_id AS vid, row_number() OVER (ORDER BY sha256('1:' || vec_id), embedding) AS rn,
           [floor(CAST(x AS DOUBLE) * 64) FOR x IN embedding] AS v
    FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
  c0 AS MATERIALIZED (SELECT rn - 1 AS cluster, v FROM kept WHERE rn <= 16),""" + ",".join(
    _ASSIGN.format(r=r) + "," + _MOVE.format(r=r, s=r + 1) for r in range(ROUNDS)) + "," + _ASSIGN.format(r=ROUNDS) + """
SELECT vid AS vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN c.v], ',')) AS centroid_sha256
FROM a3 JOIN c3 c USING (cluster)"""
