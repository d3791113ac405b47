"""MinHash near-dedup with HyperMinHash registers.

Texts become sets of word shingles (64-bit hashes).  A sketch has REGISTERS
buckets; each keeps, of the smallest hash that falls into it, the count of
leading zeros and MANTISSA_BITS bits after the leading one.  Empty buckets of
short texts borrow by a fixed order of buckets.  Bands of compressed registers
give candidates; a Jaccard estimate corrected for chance collisions of
registers thins them out, with a margin of several standard errors; links are
confirmed on the full shingle sets.

Equal sets are one class and only classes are compared.  In a band bucket the
members are first compared with one lead, the class with the most and largest
buckets; after that only the classes outside a lead's largest component are
compared with its other members, in blocks that return no more than the links
that join components.

Defined cases: null text counts as empty; texts without words have an empty
set and link with nothing; fewer words than a shingle make one shingle of the
whole sequence; different texts that share an id are compared apart and joined by the
id; rows without an id link like others but never name a component, and stand
alone with component null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._common import (
    components, in_bitmap, materialise, membership_bitmap, mix64, odd_constants, partitions, prepare, signed, spread, text_slices, tidy, words,
)

SHINGLE = 5
REGISTERS = 120
BANDS = 20                   # at least
BAND_LOSS = 1e-4             # largest chance that a pair at the threshold shares no band
MANTISSA_BITS = 10
MARGIN = 5.0                 # standard errors below the threshold that an estimate may lie
CELL_NODES = 256             # classes of one side of a comparison block
NO_ID = 1 << 62              # nodes of rows without an id lie above it

_MULT = odd_constants(SHINGLE + 2, 3)
_U = np.uint64


def _shingles(w, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes sorted and distinct inside each document, first position of each document)."""
    n_docs = len(w.first) - 1
    counts = np.diff(w.first)
    n = len(w.hashes)
    mult = _MULT if size <= SHINGLE else odd_constants(size + 2, 3)
    full = max(n - size + 1, 0)
    h = np.zeros(full, np.uint64)
    for k in range(size):
        h += (w.hashes[k: k + full] ^ (w.hashes[k: k + full] >> _U(29))) * mult[k]
    last = np.repeat(w.first[1:], counts)[:full]
    inside = np.arange(full) + size <= last
    h = mix64(h[inside])
    per_doc = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        per_doc[short] = 1
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):                       # the k-th word of each short text, where it has one
            at = np.flatnonzero(counts[short] > k)
            whole[at] = whole[at] * mult[size] + w.hashes[w.first[short[at]] + k] * mult[k] + _U(k + 1)
        begin = np.cumsum(per_doc) - per_doc
        h = np.insert(h, begin[short] - np.arange(len(short)), mix64(whole))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][per_doc > 0]] = True
    doc = np.repeat(np.arange(n_docs), per_doc)[new]
    return h[new], np.searchsorted(doc, np.arange(n_docs + 1))


def _register(v: np.ndarray) -> np.ndarray:
    """(leading zeros, mantissa) of 64-bit values in 16 bits; 0 stands for an empty bucket."""
    high = v >> _U(11)                                     # 53 bits: exact as a double
    mantissa, exponent = np.frexp(high.astype(np.float64))
    zeros = np.where(high > 0, 53 - exponent, 53)
    bits = np.where(high > 0, (mantissa * (2 << MANTISSA_BITS)).astype(np.int64) - (1 << MANTISSA_BITS), 0)
    return ((zeros + 1) << MANTISSA_BITS | bits).astype(np.uint16)


@lru_cache(maxsize=None)
def _borrow(registers: int) -> np.ndarray:
    rng = np.random.default_rng(97)
    return np.stack([rng.permutation(registers) for _ in range(registers)])


def sketches(h: np.ndarray, first: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (documents x registers, uint16) of sorted shingle sets."""
    n_docs = len(first) - 1
    out = np.zeros((n_docs, registers), np.uint16)
    if len(h):
        # the bucket follows the leading bits, so a sorted set has its buckets in a row
        cell = np.repeat(np.arange(n_docs), np.diff(first)) * registers + ((h >> _U(32)) * _U(registers) >> _U(32)).astype(np.int64)
        begin = np.flatnonzero(np.diff(cell, prepend=-1))
        out.ravel()[cell[begin]] = _register(np.minimum.reduceat(mix64(h ^ _U(0x5851F42D4C957F2D)), begin))
    order = _borrow(registers)
    row, col = np.nonzero((out == 0) & (np.diff(first) > 0)[:, None])
    own = out.copy()
    for attempt in range(registers):
        if not len(row):
            break
        value = own[row, order[col, attempt]]
        hit = value > 0
        out[row[hit], col[hit]] = value[hit]
        row, col = row[~hit], col[~hit]
    return out


@lru_cache(maxsize=None)
def _chance(log_n: int) -> float:
    """Probability that two independent buckets with about 2**log_n hashes each hold equal registers."""
    zeros = np.arange(54)[:, None]
    step = np.arange(1 << MANTISSA_BITS)[None, :] / (1 << MANTISSA_BITS)
    low = 2.0 ** -(zeros + 1) * (1 + step)
    high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA_BITS)
    n = 2.0 ** log_n
    p = np.exp(n * np.log1p(-low)) - np.exp(n * np.log1p(-np.minimum(high, 1 - 1e-16)))
    return float((p * p).sum())


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate of sketches (rows), corrected for chance collisions of registers."""
    share = (a == b).mean(1)
    log_n = np.maximum(np.log2(np.maximum((n_a + n_b) / 2 / a.shape[1], 1)).round().astype(int), 0)
    chance = np.array([_chance(int(k)) for k in log_n])
    return np.clip((share - chance) / (1 - chance), 0, 1)


def fingerprints(h: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """Two independent 64-bit sums over each shingle set; equal sets have equal sums."""
    out = []
    for salt in (0xA5A5A5A5A5A5A5A5, 0x3C6EF372FE94F82B):
        total = np.concatenate([[_U(0)], np.cumsum(mix64(h ^ _U(salt)), dtype=np.uint64)])
        out.append(pa.array(signed(total[first[1:]] - total[first[:-1]])))
    return out


def _sketch_rows(shingle: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                h, first = _shingles(words(data, offsets, lower=True), shingle)
                n = np.diff(first)
                regs = sketches(h, first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n.astype(np.int64)), *fingerprints(h, first),
                     pa.array([r.tobytes() for r in regs], pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "sketch"])
    return run


def _set_rows(shingle: int, bitmap):
    """Full shingle sets of the rows whose id may be wanted (bitmap over ids)."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            wanted = in_bitmap(bitmap.value, ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(wanted))
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                h, first = _shingles(words(data, offsets, lower=True), shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(h)))],
                    names=["node", "shingles"])
    return run


def bands_for(percent: int, registers: int = REGISTERS) -> int:
    """Fewest bands (a divisor of ``registers``, BANDS or more) that a pair at ``percent`` fails to share with a chance of BAND_LOSS at most."""
    for bands in range(min(BANDS, registers), registers):
        if registers % bands == 0 and (1 - (percent / 100) ** (registers // bands)) ** bands <= BAND_LOSS:
            return bands
    return registers


@F.pandas_udf(T.BooleanType())
def _may_link(sketch_a: pd.Series, sketch_b: pd.Series, n_a: pd.Series, n_b: pd.Series, percent: pd.Series) -> pd.Series:
    a = np.frombuffer(b"".join(sketch_a), np.uint16).reshape(len(sketch_a), -1)
    b = np.frombuffer(b"".join(sketch_b), np.uint16).reshape(len(sketch_b), -1)
    t = percent.to_numpy() / 100
    least = np.minimum(n_a, n_b).to_numpy()
    error = np.sqrt(t * (1 - t) / np.minimum(a.shape[1], np.maximum(least, 1)))
    return pd.Series(estimate(a, b, n_a.to_numpy(), n_b.to_numpy()) >= t - MARGIN * error - 0.02)


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    side = lambda k: classes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    near = sized.where(_may_link("sketch_a", "sketch_b", "n_a", "n_b", F.lit(percent))).select("a", "b", "n_a", "n_b")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")
    shared = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("shared"))
    return shared.where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def _cells(percent: int):
    """One group: per lead, strays (role 1 or 3) against members (role 2 or 3) of other parts, on full sets -> links that join parts."""
    @tidy
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, rows in g.groupby("lead", sort=False):
            role, node, part, n = (rows[c].to_numpy() for c in ("role", "node", "part", "n"))
            asked, members = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
            if not len(asked) or not len(members):
                continue
            sets = rows["shingles"].to_list()
            every, code = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
            sizes = n[members]
            begin = np.cumsum([0, *[len(sets[i]) for i in members]])[:-1]
            root = {p: p for p in part.tolist()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            mark = np.zeros(len(every), np.int32)
            for i in asked.tolist():
                at = np.searchsorted(every, sets[i])
                inside = at < len(every)
                own = at[inside][every[at[inside]] == sets[i][inside]]
                mark[own] = 1
                shared = np.add.reduceat(mark[code], begin)
                mark[own] = 0
                near = (100 * shared >= percent * (n[i] + sizes - shared)) & (part[members] != part[i])
                for j in members[near].tolist():
                    p, q = find(part[i]), find(part[j])
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out_a.append(node[i])
                        out_b.append(node[j])
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})
    return run


def _stray_links(groups: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links between different parts of a lead's members; ``groups``: (lead, node, part, n).

    The nodes outside the lead's largest part are compared with all its
    members, block by block; only links that join two parts come out.
    """
    count = groups.groupBy("lead", "part").agg(F.count(F.lit(1)).alias("c"))
    open_ = count.groupBy("lead").agg(F.max_by("part", F.struct("c", "part")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).where("all > most")
    blocks = open_.select("lead", "main", F.ceil((F.col("all") - F.col("most")) / CELL_NODES).cast("int").alias("na"), F.ceil(F.col("all") / CELL_NODES).cast("int").alias("nb"))
    rows = groups.join(materialise(blocks), "lead")   # written first: Spark can split a skewed lead in a join of plain exchanges
    place = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    entry = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    stray, small = F.col("part") != F.col("main"), (F.col("na") == 1) & (F.col("nb") == 1)
    as_member = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: entry(i, place("nb"), F.lit(2)))
    as_stray = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda j: entry(place("na"), j, F.lit(1)))
    whole = F.array(entry(F.lit(0), F.lit(0), F.when(stray, 3).otherwise(2)))
    rows = rows.withColumn("e", F.explode(F.when(small, whole).when(stray, F.concat(as_member, as_stray)).otherwise(as_member)))
    cell = F.when(small, F.pmod(F.xxhash64("lead"), F.lit(4 * parts))).otherwise(F.xxhash64("lead", "e.i", "e.j"))
    dealt = rows.select(cell.alias("cell"), "lead", "node", "part", "n", F.col("e.role").alias("role")).join(sets, "node")
    return dealt.groupBy("cell").applyInPandas(_cells(percent), "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
               shingle: int = SHINGLE, bands: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked at ``percent`` Jaccard similarity or more."""
    spark = docs.sparkSession
    bands = bands or bands_for(percent)
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(spread(texts).mapInArrow(_sketch_rows(shingle), "doc_id long, n long, f1 long, f2 long, sketch binary"))

    # a class is named by its smallest id, unless that id stands for other texts as well: then, as without any id, by its text
    nameless = F.lit(NO_ID) + F.shiftright(F.abs(F.xxhash64("f1", "f2")), 2)
    named_rows = rows.where("n > 0 AND doc_id IS NOT NULL")
    text = F.struct("f1", "f2", "n")
    shared = materialise(named_rows.groupBy("doc_id").agg(F.min(text).alias("least"), F.max(text).alias("most")).where("least <> most").select("doc_id"))
    several = not shared.isEmpty()
    classes = rows.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"))
    if several:
        classes = classes.join(shared.select(F.col("doc_id").alias("node"), F.lit(True).alias("_shared")), "node", "left").withColumn(
            "node", F.when(F.col("_shared").isNull(), F.col("node"))).drop("_shared")
    classes = materialise(classes.withColumn("node", F.coalesce("node", nameless)).select("f1", "f2", "n", "node", "sketch"))

    # buckets with several classes; a class in many and large buckets is the best one to lead its buckets
    width = 2 * REGISTERS // bands
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(bands)])
    banded = classes.select("node", F.explode(keys).alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("n0"), F.max("node").alias("n1")).where("n0 < n1").select("key", "c")
    members = materialise(banded.join(materialise(crowded), "key"))
    weight = members.groupBy("node").agg(F.sum("c").alias("w"))
    led = members.join(weight, "node")
    leads = led.groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("l")).select("key", F.col("l.w").alias("lw"), (-F.col("l.m")).alias("lead"))
    led = materialise(members.select("key", "node").join(leads, "key").select("lead", "lw", "node").distinct())

    named = led.where(F.col("node") < NO_ID).select(F.col("node").alias("doc_id")).distinct()
    bitmap = spark.sparkContext.broadcast(membership_bitmap(named, "doc_id"))
    sets = spread(texts).mapInArrow(_set_rows(shingle, bitmap), "node long, shingles array<long>")
    sets = sets.join(named, sets["node"] == named["doc_id"], "left_semi")
    if not led.where(F.col("node") >= NO_ID).isEmpty():
        # rows without an id of their own are found by their text: classes are recognised by their fingerprints
        unnamed = texts.where("doc_id IS NULL")
        if several:
            unnamed = unnamed.unionByName(texts.join(shared, "doc_id", "left_semi"))
        sets = sets.unionByName(_nameless_sets(unnamed, led, shingle))
    sets = materialise(sets.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("shingles")))
    sized = classes.groupBy("node").agg(F.max("n").alias("n"), F.first("sketch").alias("sketch"))

    # each class with the weightiest lead of its buckets, then what is still apart
    best = led.groupBy("node").agg(F.max(F.struct("lw", (-F.col("lead")).alias("m"))).alias("l")).select((-F.col("l.m")).alias("lead"), "node").where("lead <> node")
    pairs = best.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    links = materialise(_links(pairs, sized, sets, percent))
    part = components(links, "a", "b").select("node", F.col("root").alias("part"))
    groups = materialise(
        led.select("lead", "node").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
        .join(sized.select("node", "n"), "node"))
    links = materialise(links.unionByName(_stray_links(groups, sets, percent, partitions(spark))))

    if several:   # texts that share an id are joined by it
        by_id = named_rows.join(shared, "doc_id", "left_semi").join(classes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
        links = links.unionByName(by_id.where("a <> b").distinct())
    root = components(links, "a", "b")
    out = rows.join(classes.select("f1", "f2", "n", "node"), ["f1", "f2", "n"], "left").join(root, "node", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.coalesce("root", "node") < NO_ID, F.coalesce("root", "node"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _nameless_sets(texts: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    wanted = members.where(F.col("node") >= NO_ID).select("node").distinct()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                h, first = _shingles(words(data, offsets, lower=True), shingle)
                yield pa.RecordBatch.from_arrays(
                    [*fingerprints(h, first), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(h)))], names=["f1", "f2", "shingles"])

    own = spread(texts).mapInArrow(run, "f1 long, f2 long, shingles array<long>")
    node = F.lit(NO_ID) + F.shiftright(F.abs(F.xxhash64("f1", "f2")), 2)
    return own.select(node.alias("node"), "shingles").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _own_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``_node``: the id, and a new id above all others for each further text of an id (by the order of text hashes)."""
    rows = docs.withColumns({"_node": F.col(id_col).cast("long"), "_text": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    texts = rows.where("_node IS NOT NULL").select("_node", "_text").distinct()
    several = texts.groupBy("_node").agg(F.min("_text").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    more = materialise(texts.join(materialise(several), "_node").where("_text <> first").select("_node", "_text"))
    if more.isEmpty():
        return rows.drop("_text")
    above = rows.agg(F.max("_node")).first()[0] + 1
    more = more.repartition(partitions(docs.sparkSession), "_node", "_text").sortWithinPartitions("_node", "_text")
    more = materialise(more.withColumn("_new", F.lit(above) + F.monotonically_increasing_id()))
    return rows.join(more, ["_node", "_text"], "left").withColumn("_node", F.coalesce("_new", "_node")).drop("_text", "_new")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per component, and rows without an id; columns unchanged.

    Different texts that share an id stand for themselves; of rows that share
    id and text one stays, by the order of the hash of the whole row.
    """
    prepare(docs.sparkSession)
    rows = _own_ids(docs, id_col, text_col)
    found = near_dedup(rows, "_node", text_col, percent)
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_node")).where("_node IS NOT NULL").distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = rows.where("_node IS NOT NULL").join(dropped, "_node", "left_anti").groupBy("_node").agg(
        F.min_by(whole, F.xxhash64(whole)).alias("_row")).select("_row.*")
    return kept.unionByName(rows.where("_node IS NULL").select(*[F.col(f"`{c}`") for c in docs.columns]))
