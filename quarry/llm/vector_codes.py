"""Vector code compression: product quantisation in integers, with norm-of-sum bounds.

Components become integers, vectors are cut into PARTS equal parts, and each
part gets a codebook by k-means: the nearest entry, then the floor of the mean.
The codebooks of all rounds are kept.  For every part of a vector the table of
vectors holds its entry with the exact distance, and for every group of GROUP
entries a lower bound of the distance to the group's other entries, each with
the round it was found in.  In a later round a bound loosens by the true net
displacement of the entries since that round (the norm of the summed moves, not
the sum of their norms).  Groups whose bound cannot rule out a change are
scanned again exactly; all others are not touched.  Bounds are whole numbers
rounded the safe way, so assignments equal those of a full scan.

Per task one partial sum per part and entry moves on; the driver sees codebooks
only.  The table of vectors is written once a round in ``spark.checkpoint.dir``
and the round before is dropped then.

Defined cases: a vector is left out when it is null, holds null or non-finite
components, has no PARTS equal parts, another length than the kept vector with
the smallest id, or integers of 2**26 and more (its distances do not fit a
long); rows without an id start a codebook only after all others; rows that
repeat an id or a vector are all kept, equal ids are ordered by the vector;
with fewer vectors than entries the codebooks are shorter; no vector at all
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from quarry.llm._common import prepare
from quarry.llm._vectors import doubles, integers, packed, sums_by, unpacked, usable
from quarry.session import checkpoint_dir
from quarry.sources.store import drop_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
GROUP = 16                     # entries that share a lower bound
SLICE = 4096                   # vectors worked on at once
_FAR = np.int64(1) << 62       # no other entry: farther than any distance
_MOST = np.iinfo(np.int32).max

# entry and the round its distance was found in, that squared distance, lower bounds by group and their rounds
def _state(groups: int) -> np.dtype:
    return np.dtype([("entry", "u1", PARTS), ("seen", "u1", PARTS), ("square", "<i8", PARTS),
                     ("low", "<i4", (PARTS, groups)), ("found", "u1", (PARTS, groups))])


def floor_root(square: np.ndarray) -> np.ndarray:
    root = np.sqrt(square.astype(np.float64)).astype(np.int64)
    root -= root * root > square
    return root + ((root + 1) * (root + 1) <= square)


def ceil_root(square: np.ndarray) -> np.ndarray:
    root = floor_root(square)
    return root + (root * root < square)


class Squares:
    """Exact squared distances of rows of ``x`` to entries: in doubles where every term is exact there, else in longs."""

    def __init__(self, x: np.ndarray, entries: np.ndarray):
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
        kind = np.float64 if 4 * x.shape[1] * most * most < 1 << 53 else np.int64
        self.x, self.entries = x.astype(kind), entries.astype(kind)
        self.norm, self.entry_norm = (self.x ** 2).sum(1), (self.entries ** 2).sum(1)

    def to(self, rows, lo: int, hi: int) -> np.ndarray:
        d = self.norm[rows, None] - 2 * (self.x[rows] @ self.entries[lo:hi].T) + self.entry_norm[lo:hi]
        return d.astype(np.int64)

    def own(self, rows, entry: np.ndarray) -> np.ndarray:
        return ((self.x[rows] - self.entries[entry]) ** 2).sum(1).astype(np.int64)


class Books(NamedTuple):
    """Codebooks of all rounds so far, (round, part, entry, component)."""

    history: np.ndarray

    def moves(self) -> np.ndarray:
        """(round, part, entry) net displacement from that round to the last one, rounded up."""
        step = self.history[-1][None] - self.history
        return ceil_root((step * step).sum(3))


def _best_two(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the least of every row (the first of equal ones), it, and the least of the others."""
    at, rows = d.argmin(1), np.arange(len(d))
    least = d[rows, at]
    d[rows, at] = _FAR
    return at, least, d.min(1)


def _root_low(square: np.ndarray) -> np.ndarray:
    return np.minimum(floor_root(square), _MOST)


def assign(x: np.ndarray, state: np.ndarray | None, books: Books) -> tuple[np.ndarray, int]:
    """New state of the vectors ``x`` (rows, PARTS, components) for the last codebooks, and the number of distances taken."""
    now, (_, _, k, _) = len(books.history) - 1, books.history.shape
    starts = list(range(0, k, GROUP))
    out = np.zeros(len(x), _state(len(starts))) if state is None else state.copy()
    moves = books.moves()
    work = 0
    for p in range(PARTS):
        squares = Squares(x[:, p], books.history[-1][p])
        entry, square = out["entry"][:, p].astype(np.int64), out["square"][:, p].copy()
        low, found = out["low"][:, p], out["found"][:, p]
        if state is None:
            need = np.ones((len(x), len(starts)), bool)
            entry[:], square[:] = -1, _FAR
        else:
            seen = out["seen"][:, p]
            widest = np.maximum.reduceat(moves[:, p], starts, axis=1)            # (round, group)
            bound = low - widest[found, np.arange(len(starts))]
            at_most = ceil_root(square) + moves[seen, p, entry]
            rows = np.flatnonzero((bound.min(1) <= at_most) & (moves[seen, p, entry] > 0))
            square[rows] = squares.own(rows, entry[rows])
            work += len(rows)
            out["seen"][rows, p] = now
            at_most[rows] = ceil_root(square[rows])
            need = bound <= at_most[:, None]
        # winners over the scanned groups, and the entry so far
        before, best, best_square = entry.copy(), entry.copy(), square.copy()
        scanned = []
        for g, lo in enumerate(starts):
            rows = np.flatnonzero(need[:, g])
            if not len(rows):
                continue
            at, least, second = _best_two(squares.to(rows, lo, min(lo + GROUP, k)))
            work += len(rows) * (min(lo + GROUP, k) - lo)
            at += lo
            better = (least < best_square[rows]) | ((least == best_square[rows]) & (at < best[rows]))
            best[rows[better]], best_square[rows[better]] = at[better], least[better]
            scanned.append((g, rows, at, least, second))
        for g, rows, at, least, second in scanned:
            low[rows, g] = _root_low(np.where(at == best[rows], second, least))
            found[rows, g] = now
        moved = np.flatnonzero((best != before) & (before >= 0))
        left = before[moved] // GROUP                          # the entry left is one of its group's others now
        fresh = need[moved, left]
        stay, left = moved[~fresh], left[~fresh]
        low[stay, left] = np.minimum(bound[stay, left], _root_low(square[stay])) if len(stay) else 0
        found[stay, left] = now
        out["entry"][:, p], out["square"][:, p] = best, best_square
        out["seen"][best != before, p] = now
    return out, work


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, SLICE):
        yield batch.slice(lo, SLICE)


def _next_round(vectors: DataFrame, books: Books, dims: int, first: bool) -> DataFrame:
    """(id, label, vec, state) with the state for the last codebooks."""
    groups = -(-books.history.shape[2] // GROUP)
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = StructType([*vectors.select("id", "label").schema.fields, StructField("vec", BinaryType()), StructField("state", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                vec = part.column("vec")
                if first:
                    x, state = integers(vec, SCALE, dims).astype(np.int32), None
                    vec = packed(x)
                else:
                    x = unpacked(vec, "<i4", dims)
                    state = unpacked(part.column("state"), _state(groups), 1)[:, 0]
                state, _ = assign(x.reshape(len(x), PARTS, -1).astype(np.int64), state, shared.value)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), vec, packed(state)],
                                                 ["id", "label", "vec", "state"])

    return vectors.mapInArrow(run, schema)


def _means(table: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebooks: floors of the means of each entry's parts; unused entries stay."""
    _, k, width = book.shape
    groups, dims = -(-k // GROUP), PARTS * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(PARTS * k, np.int64), np.zeros((PARTS * k, width), np.int64)
        for batch in batches:
            for part in _slices(batch):
                x = unpacked(part.column("vec"), "<i4", dims).reshape(-1, PARTS, width)
                entry = unpacked(part.column("state"), _state(groups), 1)[:, 0]["entry"]
                for p in range(PARTS):
                    at = entry[:, p].astype(np.int64) + p * k
                    n += np.bincount(at, minlength=len(n))
                    np.add.at(total, at, x[:, p])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         ["at", "n", "sums"])

    found = sums_by(table.select("vec", "state").mapInArrow(run, "at long, n long, sums array<long>"), ["at"], width)
    new = book.copy().reshape(PARTS * k, width)
    for r in found.collect():                                   # PARTS * ENTRIES rows at most
        new[r["at"]] = np.array(r["total"]) // r["n"]
    return new.reshape(book.shape)


def _digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.reshape(-1))).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                     entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: id, code, error, label_error, codebooks_sha256 (``entries`` is 256 at most)."""
    spark = vectors.sparkSession
    prepare(spark)
    kinds = [(id_col, vectors.schema[id_col].dataType), ("code", StringType()), ("error", LongType()), ("label_error", LongType()),
             ("codebooks_sha256", StringType())]
    base = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), doubles(vector_col).alias("vec"))
    base = base.where(usable(F.col("vec"), SCALE) & (F.size("vec") % PARTS == 0))
    order = [F.col("id").asc_nulls_last(), F.col("vec")]
    head = base.orderBy(*order).limit(1).collect()
    if not head:
        return spark.createDataFrame([], StructType([StructField(*f) for f in kinds]))
    dims = len(head[0]["vec"])
    base = base.where(F.size("vec") == dims)
    start = np.array([r["vec"] for r in base.orderBy(*order).limit(entries).collect()])
    book = np.floor(start * float(SCALE)).astype(np.int64).reshape(-1, PARTS, dims // PARTS).transpose(1, 0, 2)
    books = Books(book[None])
    folder, before, table = f"{checkpoint_dir(spark)}/vector-codes-{uuid.uuid4().hex}", None, base
    for r in range(rounds + 1):
        out = f"{folder}/{r}"
        _next_round(table, books, dims, r == 0).write.parquet(out)
        table = spark.read.parquet(out)
        if before:
            drop_folder(spark, before)
        before = out
        if r < rounds:
            books = Books(np.concatenate([books.history, _means(table, books.history[-1])[None]]))
    groups = -(-books.history.shape[2] // GROUP)
    shared = spark.sparkContext.broadcast(books.history[-1])

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                x = unpacked(part.column("vec"), "<i4", dims).reshape(part.num_rows, PARTS, -1).astype(np.int64)
                entry = unpacked(part.column("state"), _state(groups), 1)[:, 0]["entry"]
                step = x - shared.value[np.arange(PARTS), entry]
                hexed = [bytes(e).hex() for e in entry]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(hexed, pa.string()),
                                                  pa.array((step * step).sum((1, 2)))], ["id", "label", "code", "error"])

    schema = StructType([*table.select("id", "label").schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    coded = table.mapInArrow(codes, schema)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_l")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_l"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(_digest(books.history[-1])).alias("codebooks_sha256"))


_ASSIGN = """
  a{r} AS MATERIALIZED (SELECT part, rn, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT x.part, x.rn, c.entry, list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, c.v) + list_dot_product(c.v, c.v) AS d
    FROM parts x JOIN c{r} c USING (part)) GROUP BY part, rn)"""

_MOVE = """
  m{r} AS MATERIALIZED (SELECT part, entry, list(m ORDER BY j) AS v FROM (
    SELECT part, entry, j, floor(sum(x) / count(*)) AS m
    FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{r} JOIN parts USING (part, rn)) GROUP BY ALL) GROUP BY part, entry),
  c{s} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (part, entry))"""

ORACLE_SQL = """
WITH
  kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS rn,
      [floor(CAST(x AS DOUBLE) * 1024) FOR x IN embedding] AS v
    FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
  parts AS MATERIALIZED (SELECT rn, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM kept, range(4) AS t(part)),
  c0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, v FROM parts WHERE rn <= 256),""" + ",".join(
    _ASSIGN.format(r=r) + "," + _MOVE.format(r=r, s=r + 1) for r in range(ROUNDS)) + "," + _ASSIGN.format(r=ROUNDS) + """,
  coded AS MATERIALIZED (SELECT rn, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM a4 GROUP BY rn),
  book AS (SELECT sha256(string_agg(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN v], ','), ',' ORDER BY part, entry)) AS digest FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (rn), book"""
