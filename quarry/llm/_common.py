"""Helpers shared by the corpus operators: checkpoints, vectorised words, salted ranks, components."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, ship_package

# The white space of every word rule here: space and the controls 0x09-0x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
# Documents are cut into slices of about this many bytes before numpy work, so
# temporaries stay a few tens of MB whatever the Arrow batch holds.
SLICE_BYTES = 1 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Register the shared checkpoint folder and make the package importable by Python workers."""
    checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's own value: whole texts make such batches large
        spark.conf.set(ARROW_ROWS, "4000")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give freed memory back to the system; glibc would keep it for as long as the Python worker lives."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to trim


def tidy(work):
    """``work`` (of one argument, a generator or not) with :func:`release` after it."""
    def wrapped(given):
        out = work(given)
        if inspect.isgenerator(out):
            return _drained(out)
        release()
        return out

    return wrapped


def _drained(out: Iterator) -> Iterator:
    yield from out
    release()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """Deal few, large input splits over all cores before CPU-heavy work (nothing moves when there are enough)."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


# ---------------------------------------------------------------- hashing

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over uint64 (three xor-shift / multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a rule."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) | _U(1)


_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * SLICE_BYTES)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            p = np.multiply.accumulate(p)
        _POWERS[name] = have = p
    return have


class Rolling:
    """Hashes of arbitrary sub-ranges of one sequence of 64-bit codes, from a single prefix sum.

    The hash of ``[s, e)`` is ``sum(code[j] * B**(j - s))`` modulo 2**64, mixed.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes * _powers(_BASE, "up", n)[:n], out=self.prefix[1:])
        self.inverse = _powers(_BASE_INV, "down", n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64))
_BYTE_CODE_LOWER = _BYTE_CODE.copy()
_BYTE_CODE_LOWER[ord("A"): ord("Z") + 1] = _BYTE_CODE[ord("a"): ord("z") + 1]


class Words(NamedTuple):
    """Words of a slice of documents (byte positions in ``data``)."""

    data: np.ndarray   # uint8 text of the slice
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each document, plus the total at the end
    hashes: np.ndarray
    roll: Rolling      # hashes of other byte ranges of the slice


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of slices of about ``limit`` bytes; a longer text is one slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Split a slice into words and hash each (64 bits); ``lower`` folds A-Z before hashing."""
    inside = ~_IS_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets, "left")
    codes = (_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data]
    roll = Rolling(codes)
    return Words(data, starts, ends, first, roll.of(starts, ends), roll)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- distributed helpers


def salted_rank(df: DataFrame, keys: list[str], ties: list[Column], name: str, seed: int = 17, salts: int = 256) -> DataFrame:
    """Dense 0-based rank inside each group of ``keys`` in a seeded hash order of ``ties``.

    A group is cut into ``salts`` hash buckets that are numbered apart and put
    end to end by their counts, so a hot group never meets in one task.  ``df``
    must be deterministic (checkpointed) and the keys non-null.
    """
    t = df.withColumn("_h", F.xxhash64(F.lit(seed), *ties)).withColumn("_b", F.pmod(F.col("_h"), F.lit(salts)).cast("int"))
    counts = t.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_b", F.coalesce(F.sum("_c").over(prior), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *ties)
    return (
        t.join(offsets, [*keys, "_b"])
        .withColumn(name, F.col("_o") + F.row_number().over(inside) - 1)
        .drop("_h", "_b", "_o")
    )


EDGES_A_FILE = 200_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected edge list: one row (node, root) per node, root = smallest node.

    Alternating large-star / small-star contraction: every round is two joins
    of edges with per-node minima (partially aggregated), checkpointed; it ends
    when a round changes nothing, when each edge points at its root.  A round
    is written in as many files as its edges need, whatever the number of
    shuffle partitions: on a local file system every file costs two processes.
    """
    cur = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    files = 1 + cur.count() // EDGES_A_FILE       # a round never adds edges
    last = None
    while True:
        # large star: neighbours above a node move to the node's smallest neighbour
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        cur = materialise(small.where("u <> v").distinct().coalesce(files))
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


LEAST_BITS, MOST_BITS = 16, 26


def membership_bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bit of every 64-bit key set: about 16 bits a key, 2**MOST_BITS bits (8 MB) at most.

    Used to drop most rows that an exact semi-join would drop anyway, before
    they are shuffled; a full bitmap only drops fewer of them.
    """
    keys = materialise(keys.select(F.col(column).alias("k")))
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(16 * keys.count() + 1)))))
    word = F.shiftright(F.pmod("k", F.lit(1 << bits)), 5).cast("int")
    found = keys.select(word.alias("w"), F.expr("shiftleft(1L, CAST(pmod(k, 32) AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << bits - 5, np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.astype(np.uint32)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each (signed or unsigned) 64-bit key is set: always for a member."""
    bit = np.ascontiguousarray(keys).view(np.uint64) & _U(32 * len(bitmap) - 1)
    return (bitmap[(bit >> _U(5)).astype(np.int64)] >> (bit & _U(31)).astype(np.uint32) & 1).astype(bool)


def rows_in_bitmap(df: DataFrame, column: str, bitmap, inside: bool = True) -> DataFrame:
    """The rows of ``df`` whose key's bit is set (or not) in a broadcast bitmap; the key is a non-null long."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(at).to_numpy()) == inside))

    return df.mapInArrow(run, df.schema)
