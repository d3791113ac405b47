"""Line dedup by a segment-partition edit join.

A line is compared without the white space at its ends.  Equal lines are one
node (64-bit hashes of the whole and of its first half).  Two lines are linked
within EDITS edits if both have MIN_CHARS characters or more; below that the
allowed edits follow the length of the shorter one (one edit in MIN_CHARS /
EDITS characters, so with 2 and 40 one edit from 20 characters on).  Lines are
cut into a segment more than the edits; two lines within them share at least one
segment, near its place, and their lengths differ by the edits at most.  So every line is
indexed by its segments and probes the segments of the lengths it can match,
at the shifts that the multi-match rule leaves.  Lines that meet on a segment
are verified by a banded bit-parallel edit distance.  Of the lines of a linked
group the first one, by document id and place, stays everywhere else it goes.

Defined cases: null text counts as empty; blank lines always stay; lines
too short for an edit are duplicates only if equal; rows that share id and text are one
document and keep the same lines; rows without an id come last; a text whose
lines all go becomes empty, its row stays; an empty table gives an empty
result.  Documents keep all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import (
    Rolling, components, in_bitmap, materialise, membership_bitmap, mix64, partitions, prepare, signed, spread, text_slices, tidy,
)

EDITS = 2
MIN_CHARS = 40
DIRECT_ROWS = 8              # lines of one segment whose pairs are made in place; larger segments are compared block by block
BLOCK_LINES = 256
SEEN_LINES = 1_000_000
HELD_ROWS = 100_000          # rows of one segment that a task holds
LAST = (1 << 63) - 1

_U = np.uint64


@lru_cache(maxsize=None)
def _code_table() -> np.ndarray:
    return mix64(np.arange(7, 0x110007, dtype=np.uint64))


class Lines:
    """Lines of a slice: code points, document, place in it, and range without white space at the ends (blank ones left out)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        text = data.tobytes().decode("utf-8", "replace")
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        n = len(self.codes)
        feed = np.flatnonzero(self.codes == 10)
        doc_of_feed = np.searchsorted(chars, feed, "right") - 1
        start = np.concatenate([chars[:-1], feed + 1])
        doc = np.concatenate([np.arange(len(chars) - 1), doc_of_feed])
        order = np.lexsort((start, doc))
        start, doc = start[order], doc[order]
        end = np.empty_like(start)
        end[:-1] = start[1:] - 1
        last_of_doc = np.ones(len(start), bool)
        last_of_doc[:-1] = doc[1:] != doc[:-1]
        end[last_of_doc] = chars[1:][doc[last_of_doc]]
        first_line = np.searchsorted(doc, np.arange(len(chars)))
        place = np.arange(len(start)) - first_line[doc]
        solid = np.flatnonzero(~((self.codes == 32) | (self.codes - np.uint32(9) <= 4)))
        begin = np.append(solid, n)[np.searchsorted(solid, start)]
        stop = np.append(solid, -1)[np.searchsorted(solid, end) - 1] + 1
        keep = begin < end
        self.n_lines = np.bincount(doc, minlength=len(chars) - 1)
        self.doc, self.place, self.start, self.end = doc[keep], place[keep], begin[keep], stop[keep]
        self.roll = Rolling(_code_table()[self.codes])
        self.hash = signed(self.roll.of(self.start, self.end))


@tidy
def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_slices(batch.column(2)):
            x = Lines(data, offsets)
            row = pa.array(lo + x.doc)
            check = signed(x.roll.of(x.start, (x.start + x.end) // 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(x.place.astype(np.int32)), pa.array(x.hash), pa.array(check)],
                names=["d", "t", "pos", "h", "g"])


def allowed_edits(size, edits: int = EDITS, min_chars: int = MIN_CHARS):
    """Edits allowed between two lines, by the length of the shorter one."""
    return np.minimum(edits, edits * size // max(min_chars, 1))


def _levels(edits: int, min_chars: int) -> list[tuple[int, int, int]]:
    """(edits, least length, length that it ends before) of the lengths that allow an edit."""
    least = [-(-e * min_chars // max(edits, 1)) for e in range(edits + 1)] + [LAST]
    return [(e, least[e], least[e + 1]) for e in range(1, edits + 1)]


def signatures(x: Lines, rows: np.ndarray, edits: int = EDITS, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment key, row, role) of the lines ``rows``, by the edits that the length of the indexed line allows."""
    parts = [_level_signatures(x, rows, *level) for level in _levels(edits, min_chars)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _level_signatures(x: Lines, rows: np.ndarray, edits: int, least: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment key, row, role) for indexed lines of ``least`` to ``end`` - 1 characters: role 1 indexes a line under a segment of its own length, 2 looks one up, 3 does both."""
    start, size = x.start[rows], x.end[rows] - x.start[rows]
    keys, owners, roles = [], [], []
    for shorter in range(edits + 1):
        length = size - shorter                                   # of the indexed line
        fits = (length >= least) & (length < end)
        for i in range(edits + 1):
            q = length // (edits + 1) + (i >= edits + 1 - length % (edits + 1))
            p = i * (length // (edits + 1)) + np.maximum(i - (edits + 1 - length % (edits + 1)), 0)
            for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1):
                at = p + shift
                ok = fits & (at >= 0) & (at + q <= size)
                s = start[ok] + at[ok]
                label = mix64((length[ok].astype(np.uint64) << _U(4)) | _U(i))
                keys.append(x.roll.of(s, s + q[ok]) ^ label)
                owners.append(np.flatnonzero(ok))
                roles.append(np.full(len(s), 3 if shorter == 0 and shift == 0 else 2, np.int8))
    return signed(np.concatenate(keys)), rows[np.concatenate(owners)], np.concatenate(roles)


def _signature_rows(edits: int, min_chars: int):
    shortest = min((least for _, least, _ in _levels(edits, min_chars)), default=LAST)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()                                # lines this task has sent already, a bounded memory of them
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                x = Lines(data, offsets)
                rows = np.unique(x.hash, return_index=True)[1]
                rows = rows[x.end[rows] - x.start[rows] >= shortest]
                fresh = [h not in seen for h in x.hash[rows].tolist()]
                rows = rows[np.array(fresh, bool)]
                if len(seen) > SEEN_LINES:
                    seen.clear()
                seen.update(x.hash[rows].tolist())
                if len(rows):
                    key, owner, role = signatures(x, rows, edits, min_chars)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x.hash[owner]), pa.array(role)], names=["key", "h", "role"])
    return run


MEET_SCHEMA = "key long, a long, b long, role int"


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> pairs (a, b, role 0) that meet on a segment; rows (a, role) of segments with many lines."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))
    rest, hot = empty, None

    def batch_of(key, a, b, role) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b), pa.array(role.astype(np.int32))], names=["key", "a", "b", "role"])

    def settle(key, h, role) -> Iterator[pa.RecordBatch]:
        """Whole groups: lines of a segment, each once with its roles joined."""
        if len(key) < 2:
            return
        same = key[1:] == key[:-1]
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))   # segments of one row meet nothing
        at = at[np.lexsort((h[at], key[at]))]
        key, h, role = key[at], h[at], role[at]
        head = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]))) if len(key) else at
        if not len(head):
            return
        role, key, h = np.bitwise_or.reduceat(role, head), key[head], h[head]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        open_ = (size > 1) & (np.add.reduceat((role & 1).astype(np.int64), head) > 0)
        crowd = np.repeat(open_ & (size > DIRECT_ROWS), size)
        if crowd.any():
            yield batch_of(key[crowd], h[crowd], np.zeros(crowd.sum(), np.int64), role[crowd])
        for n in np.unique(size[open_ & (size <= DIRECT_ROWS)]):
            cell = head[open_ & (size == n)][:, None] + np.arange(n)[None, :]
            i, j = np.triu_indices(n, 1)
            a, b = cell[:, i].ravel(), cell[:, j].ravel()
            ok = ((role[a] | role[b]) & 1) > 0
            a, b = a[ok], b[ok]
            yield batch_of(key[a], np.minimum(h[a], h[b]), np.maximum(h[a], h[b]), np.zeros(len(a), np.int8))

    for batch in batches:
        cur = tuple(np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, batch.columns))
        if hot is not None:                                   # a segment too common to hold: its rows pass on as they come
            same = cur[0] == hot
            if same.any():
                yield batch_of(cur[0][same], cur[1][same], np.zeros(same.sum(), np.int64), cur[2][same])
            cur = tuple(c[~same] for c in cur)
            hot = None if len(cur[0]) else hot
        tail = int(np.searchsorted(cur[0], cur[0][-1])) if len(cur[0]) else 0
        yield from settle(*(c[:tail] for c in cur))
        rest = tuple(c[tail:] for c in cur)
        if len(rest[0]) > HELD_ROWS:
            hot = rest[0][0]
            yield batch_of(rest[0], rest[1], np.zeros(len(rest[0]), np.int64), rest[2])
            rest = empty
    yield from settle(*rest)


def within_edits(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether two sequences are within ``edits`` insertions, deletions and substitutions.

    One bit per diagonal of the band and number of errors: bit j stands for
    the prefix of ``a`` of length i - edits + j after i symbols of ``b``.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    if not len(differ):
        return True
    a, b = a[differ[0]:], b[differ[0]:]
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:m] != b[::-1][:m])
    cut = differ[0] if len(differ) else m
    a, b = a[: len(a) - cut].tolist(), b[: len(b) - cut].tolist()
    width = 2 * edits + 1
    full = (1 << width) - 1
    state = [((1 << (e + 1)) - 1) << edits & full for e in range(edits + 1)]
    for i, c in enumerate(b):
        match = 0
        for j in range(width):
            k = i - edits + j
            if 0 <= k < len(a) and a[k] == c:
                match |= 1 << j
        new = [state[0] & match]
        for e in range(1, edits + 1):
            new.append(((state[e] & match) | state[e - 1] | (state[e - 1] >> 1) | (new[e - 1] << 1)) & full)
        if not any(new):
            return False
        state = new
    goal = len(a) - len(b) + edits
    return bool(state[edits] >> goal & 1)


def _line_texts(bitmap):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                x = Lines(data, offsets)
                at = np.unique(x.hash, return_index=True)[1]
                at = at[in_bitmap(bitmap.value, x.hash[at])]
                raw = x.codes.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.hash[at]), pa.array([raw[4 * s: 4 * e] for s, e in zip(x.start[at].tolist(), x.end[at].tolist())], pa.binary())],
                    names=["h", "line"])
    return run


def _crowd_links(edits: int, min_chars: int):
    """One group: per segment, the lines of block i against those of block j -> links that join lines not joined yet."""
    @tidy
    def run(g: pd.DataFrame) -> pd.DataFrame:
        out_a, out_b = [], []
        for _, rows in g.groupby("key", sort=False):
            h, role, side = (rows[c].to_numpy() for c in ("a", "role", "side"))
            lines = [np.frombuffer(x, "<u4") for x in rows["line"]]
            size = np.array([len(x) for x in lines])
            most = allowed_edits(size, edits, min_chars).tolist()
            root = {x: x for x in h.tolist()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            right = np.flatnonzero(side & 2)
            for i in np.flatnonzero(side & 1).tolist():
                near = right[(np.abs(size[right] - size[i]) <= edits) & (((role[right] | role[i]) & 1) > 0) & (h[right] != h[i])]
                if side[i] == 3:                              # block against itself: each pair once
                    near = near[h[near] > h[i]]
                for j in near.tolist():
                    p, q = find(int(h[i])), find(int(h[j]))
                    if p != q and within_edits(lines[i], lines[j], min(most[i], most[j])):
                        root[max(p, q)] = min(p, q)
                        out_a.append(h[i])
                        out_b.append(h[j])
        return pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})
    return run


def near_lines(texts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame | None:
    """(h, root): groups of different lines within the allowed edits, directly or over others; None if there are none."""
    spark = texts.sparkSession
    parts = partitions(spark)
    dealt = spread(texts.select("text")).mapInArrow(_signature_rows(edits, min_chars), "key long, h long, role byte")
    met = materialise(dealt.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_meet, MEET_SCHEMA))
    pairs = met.where("role = 0").select("a", "b").distinct()
    crowd = met.where("role <> 0").groupBy("key", "a").agg(F.bit_or("role").alias("role"))
    wanted = materialise(pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(crowd.select(F.col("a").alias("h"))).distinct())
    bitmap = spark.sparkContext.broadcast(membership_bitmap(wanted, "h"))
    content = spread(texts.select("text")).mapInArrow(_line_texts(bitmap), "h long, line binary").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    content = materialise(content)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [within_edits(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), int(allowed_edits(min(len(x), len(y)) // 4, edits, min_chars)))
                  for x, y in zip(b["line_a"], b["line_b"])]
            yield b.loc[ok, ["a", "b"]]

    both = pairs.join(content.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a").join(
        content.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    links = both.select("a", "b", "line_a", "line_b").mapInPandas(check, "a long, b long")

    # segments with many lines: blocks of lines meet in groups that return only links that join lines
    blocks = crowd.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_LINES).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("a"), F.col("n")).cast("int")
    entry = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.when(i == j, 3).when(mine == i, 1).otherwise(2).alias("side"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: entry(F.least(mine, k), F.greatest(mine, k)))
    spread_out = crowd.join(blocks, "key").withColumn("e", F.explode(cells))
    group = F.when(F.col("n") == 1, F.pmod(F.xxhash64("key"), F.lit(4 * parts))).otherwise(F.xxhash64("key", "e.i", "e.j"))
    cell_rows = spread_out.select(group.alias("cell"), "key", "a", "role", F.col("e.side").alias("side")).join(
        content.withColumnRenamed("h", "a"), "a")
    links = links.unionByName(cell_rows.groupBy("cell").applyInPandas(_crowd_links(edits, min_chars), "a long, b long"))
    links = materialise(links)
    return None if links.isEmpty() else components(links, "a", "b").select(F.col("node").alias("h"), "root")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"), *more)


def removed_lines(texts: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, t, removed): places of the lines that go, for documents that lose any."""
    places = materialise(spread(texts.select("d", "t", "text")).mapInArrow(_occurrences, "d long, t long, pos int, h long, g long"))
    near = near_lines(texts, edits, min_chars)
    if near is not None:
        places = places.join(near, "h", "left").select(
            "d", "t", "pos", F.coalesce("root", "h").alias("line"), F.when(F.col("root").isNull(), F.col("g")).otherwise(F.lit(0)).alias("g"))
    else:
        places = places.withColumnRenamed("h", "line")
    # written first, so that the join has plain exchanges on both sides, whose skewed parts Spark can split
    first = materialise(places.groupBy("line", "g").agg(
        F.min(F.struct("d", "t", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    gone = places.join(first, ["line", "g"]).where(F.struct("d", "t", "pos") != F.col("first"))
    return gone.groupBy("d", "t").agg(F.collect_set("pos").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with the columns of ``docs``; repeated lines are gone from ``text_col``, and null text is kept."""
    prepare(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    gone = removed_lines(texts, edits, min_chars)
    rows = _keyed(docs, id_col, text_col, F.struct("*").alias("doc"))
    left = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    text = F.when(F.col("removed").isNull(), F.col(f"doc.{text_col}")).otherwise(F.array_join(left, "\n"))
    return rows.join(gone, ["d", "t"], "left").select(
        *[text.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def line_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places, ascending), kept_sha256 (of the text that is left) of every row."""
    prepare(docs.sparkSession)
    texts = _keyed(docs, id_col, text_col)
    rows = _keyed(docs, id_col, text_col, F.col(id_col).alias("doc_id")).join(removed_lines(texts, edits, min_chars), ["d", "t"], "left")
    removed = F.coalesce(F.array_sort("removed"), F.array().cast("array<int>"))
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.array_contains(F.col("gone"), i))
    return rows.withColumn("gone", removed).select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"),
        F.col("gone").alias("removed"), F.sha2(F.array_join(left, "\n"), 256).alias("kept_sha256"))
