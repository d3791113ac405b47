"""Substring dedup: windows of words that also start in a document with a smaller id.

Every window goes to the shards by its minimiser, the smallest hash of its
GRAM-word grams: equal windows share it, and consecutive windows of a document
that share it form one passage.  Passages whose minimiser occurs in one
document only are done.  Equal passages fold to one with the smallest id that
holds it; the different passages of a minimiser meet in a shard, which builds
an FM-index (wavelet matrix) of them and streams them against it: backward
search gives the matching statistic of each position, stopped at the window
length, and the smallest id in the suffix range.  A minimiser with many words
is cut into several shards, each passage being searched in all of them.

Defined cases: null text has no words; texts shorter than a window lose
nothing; rows sharing an id are never duplicates of each other; rows without
an id rank after all ids; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import Rolling, materialise, membership_bitmap, prepare, rows_in_bitmap, signed, spread, text_slices, tidy, words
from quarry.llm._fm_index import FMIndex, RangeMin

WINDOW = 50
GRAM = 8
SHARD_WORDS = 400_000        # words of passages that one index holds
LAST = (1 << 63) - 1         # stands for a missing id

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _passages(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(key, document, first word, windows, hash of the whole passage) of all passages of a slice."""
    n = len(hashes)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, none
    roll = Rolling(hashes)
    at = np.arange(n - gram + 1)
    low = _sliding_min(roll.of(at, at + gram), window - gram + 1)     # of the window that starts here
    ends = np.repeat(first[1:], np.diff(first))
    start = np.flatnonzero(np.arange(len(low)) + window <= ends[: len(low)])
    if not len(start):
        return none, none, none, none, none
    key = low[start]
    new = np.ones(len(start), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(start)))
    begin = start[head]
    doc = np.searchsorted(first, begin, "right") - 1
    return signed(key[head]), doc, begin - first[doc], count, signed(roll.of(begin, begin + count + window - 1))


def _passage_rows(window: int, gram: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                w = words(data, offsets, lower=False)
                key, doc, start, count, whole = _passages(w.hashes, w.first, window, gram)
                row = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(key), pa.array(start.astype(np.int32)),
                     pa.array(count.astype(np.int32)), pa.array(whole)],
                    names=["d", "t", "key", "start", "n", "whole"])
    return run


@tidy
def _passage_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the wanted passages (columns text, wanted: structs of key, whole, first, start, last)."""
    for batch in batches:
        text, wanted = batch.column(0), batch.column(1)
        begin = np.concatenate([[0], np.cumsum(pc.list_value_length(wanted).to_numpy(zero_copy_only=False))])
        items = wanted.flatten()
        start, last = items.field("start").to_numpy(), items.field("last").to_numpy()
        content: list[bytes] = []
        for lo, hi, data, offsets in text_slices(text):
            w = words(data, offsets, lower=False)
            raw, base = w.hashes.tobytes(), np.repeat(w.first[:-1], np.diff(begin[lo: hi + 1]))
            for s, e in zip((8 * (base + start[begin[lo]: begin[hi]])).tolist(), (8 * (base + last[begin[lo]: begin[hi]])).tolist()):
                content.append(raw[s:e])
        yield pa.RecordBatch.from_arrays(
            [items.field("key"), items.field("whole"), items.field("lowest"), pa.array(content, pa.binary())],
            names=["key", "whole", "lowest", "words"])


def _search(window: int):
    """Shard: passages in the index (role 1 or 3) and passages to look up (role 2 or 3) -> matched runs of windows."""
    empty = pd.DataFrame({"key": pd.Series(dtype="int64"), "whole": pd.Series(dtype="int64"), "lo": pd.Series(dtype="int32"),
                          "hi": pd.Series(dtype="int32"), "lowest": pd.Series(dtype="int64")})

    @tidy
    def run(g: pd.DataFrame) -> pd.DataFrame:
        role = g["role"].to_numpy()
        indexed, asked = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(indexed) or not len(asked):
            return empty
        parts = [np.frombuffer(b, np.uint64) for b in g["words"]]
        lengths = np.array([len(p) for p in parts])
        alphabet, code = np.unique(np.concatenate([parts[i] for i in indexed]), return_inverse=True)
        index = FMIndex(code.astype(np.int64) + 1, lengths[indexed], len(alphabet))
        low_id = g["lowest"].to_numpy()
        smallest = RangeMin(low_id[indexed][index.sequence])
        query = np.concatenate([parts[i] for i in asked])
        place = np.searchsorted(alphabet, query)
        place = np.where((place < len(alphabet)) & (alphabet[np.minimum(place, len(alphabet) - 1)] == query), place + 1, 0)
        windows = lengths[asked] - window + 1
        owner = np.repeat(np.arange(len(asked)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        base = (np.cumsum(lengths[asked]) - lengths[asked])[owner] + nth
        own = (role[asked] == 3)[owner]          # the passage itself is in this index: one row is no match
        live = np.arange(len(owner))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), index.size, np.int64)
        for back in range(window - 1, -1, -1):
            symbol = place[base[live] + back]
            low, high = index.extend(symbol, low, high)
            ok = (symbol > 0) & (high - low > own[live])
            live, low, high = live[ok], low[ok], high[ok]
            if not len(live):
                return empty
        found = smallest.of(low, high)
        ok = found < g["highest"].to_numpy()[asked][owner[live]]   # else no holder of this passage has a smaller id before it
        live, found = live[ok], found[ok]
        if not len(live):
            return empty
        new = np.ones(len(live), bool)
        new[1:] = (np.diff(live) != 1) | (owner[live][1:] != owner[live][:-1]) | (found[1:] != found[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(live)) - 1
        rows = asked[owner[live[head]]]
        return pd.DataFrame({"key": g["key"].to_numpy()[rows], "whole": g["whole"].to_numpy()[rows], "lo": nth[live[head]].astype(np.int32),
                             "hi": nth[live[tail]].astype(np.int32), "lowest": found[head]})

    return run


@tidy
def _kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the digest of the kept words (columns doc_id, text, spans: structs of lo, hi)."""
    for batch in batches:
        spans = batch.column(2)
        count = pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(count)])
        items = spans.drop_null().flatten() if spans.null_count < len(spans) else None
        left = items.field("lo").to_numpy().astype(np.int64) if items is not None else np.zeros(0, np.int64)
        right = items.field("hi").to_numpy().astype(np.int64) if items is not None else np.zeros(0, np.int64)
        for lo, hi, data, offsets in text_slices(batch.column(1)):
            w = words(data, offsets, lower=False)
            n = len(w.starts)
            base = np.repeat(w.first[:-1], np.diff(begin[lo: hi + 1]))
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, base + left[begin[lo]: begin[hi]], 1)
            np.add.at(cover, base + right[begin[lo]: begin[hi]], -1)
            keep = np.cumsum(cover[:-1]) == 0
            # bytes of kept words, each followed by one space where its document goes on
            starts, ends = w.starts[keep], w.ends[keep]
            stop = np.repeat(offsets[1:], np.diff(w.first))[keep]
            edge = np.zeros(len(data) + 1, np.int64)
            edge[starts] += 1
            np.add.at(edge, np.minimum(ends + 1, stop), -1)
            chosen = np.cumsum(edge[:-1]) > 0
            clean = np.where(_IS_SPACE[data], 0x20, data).astype(np.uint8)
            size = np.concatenate([[0], np.cumsum(chosen)])[offsets]
            raw = memoryview(clean[chosen].tobytes())
            kept = np.concatenate([[0], np.cumsum(keep)])[w.first]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)), pa.array(np.diff(w.first) - np.diff(kept)),
                 pa.array([hashlib.sha256(bytes(raw[a:b]).rstrip(b" ")).hexdigest() for a, b in zip(size[:-1].tolist(), size[1:].tolist())])],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def duplicate_spans(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(d, t, lo, hi): word ranges of documents covered by windows found under a smaller id; ``texts`` has d, t and text."""
    spark = texts.sparkSession
    rows = materialise(spread(texts.select("d", "t", "text")).mapInArrow(
        _passage_rows(window, gram), "d long, t long, key long, start int, n int, whole long"))
    distinct = rows.groupBy("key", "whole", "n").agg(F.min("d").alias("lowest"), F.max("d").alias("highest"))
    keys = distinct.groupBy("key").agg(
        F.min("lowest").alias("k_low"), F.max("highest").alias("k_high"), F.count(F.lit(1)).alias("passages"),
        F.sum(F.col("n") + (window - 1)).alias("k_words"),
    ).where("k_low < k_high").select("key", "passages", "k_words")
    shared = materialise(distinct.join(keys, "key"))

    # a passage itself under its smallest id: every other holder loses all of it
    whole = shared.where("lowest < highest").select(
        "key", "whole", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"), "lowest")

    several = shared.where("passages > 1")
    total = several.agg(F.sum(F.col("n") + (window - 1))).first()[0] or 0
    runs = whole
    if total:
        wanted = rows.join(several.select("key", "whole", "n", "lowest"), ["key", "whole", "n"]).where("d = lowest")
        wanted = wanted.dropDuplicates(["key", "whole"]).groupBy("d", "t").agg(F.collect_list(F.struct(
            "key", "whole", "lowest", "start", (F.col("start") + F.col("n") + (window - 1)).alias("last"))).alias("wanted"))
        wanted = materialise(wanted)
        holders = spark.sparkContext.broadcast(membership_bitmap(wanted, "t"))
        content = rows_in_bitmap(spread(texts.select("d", "t", "text")), "t", holders).join(wanted, ["d", "t"]).dropDuplicates(["d", "t"]).select("text", "wanted").mapInArrow(
            _passage_words, "key long, whole long, lowest long, words binary")
        facts = several.select("key", "whole", "highest", "k_words")
        shards = max(1, int(total // shard_words))
        cuts = F.ceil(F.col("k_words") / shard_words).cast("int")
        mine = F.pmod(F.xxhash64("whole"), cuts).cast("int")
        part = lambda i: F.xxhash64("key", i)
        # an ordinary minimiser lives in one shard; a hot one in cuts x cuts cells of index part and query part
        cells = F.when(cuts <= 1, F.array(F.struct(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(3).alias("role"))))
        hot = F.flatten(F.transform(F.sequence(F.lit(0), cuts - 1), lambda c: F.array(
            F.struct(part(mine).alias("a"), (c + 1).cast("long").alias("b"), F.when(mine == c, F.lit(3)).otherwise(F.lit(1)).alias("role")),
            F.struct(part(c).alias("a"), (mine + 1).cast("long").alias("b"), F.when(mine == c, F.lit(0)).otherwise(F.lit(2)).alias("role")))))
        dealt = content.join(facts, ["key", "whole"]).withColumn("cell", F.explode(cells.otherwise(hot))).where("cell.role > 0").select(
            F.col("cell.a").alias("a"), F.col("cell.b").alias("b"), F.col("cell.role").alias("role"), "key", "whole", "lowest", "highest", "words")
        matched = dealt.groupBy("a", "b").applyInPandas(_search(window), "key long, whole long, lo int, hi int, lowest long")
        runs = materialise(whole.unionByName(matched))
    hits = rows.join(runs.withColumnRenamed("lowest", "under"), ["key", "whole"]).where("under < d")
    return hits.select("d", "t", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + window).alias("hi"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    spans = materialise(duplicate_spans(texts, window, gram, shard_words).distinct().groupBy("d", "t").agg(
        F.collect_list(F.struct("lo", "hi")).alias("spans")))
    # only texts that may lose something are shuffled to meet their spans
    losers = docs.sparkSession.sparkContext.broadcast(membership_bitmap(spans, "t"))
    whole = spread(texts.select("doc_id", "d", "t", "text"))
    cut = rows_in_bitmap(whole, "t", losers).join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    rest = rows_in_bitmap(whole, "t", losers, inside=False).select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return cut.mapInArrow(_kept_rows, kind).unionByName(rest.mapInArrow(_kept_rows, kind))
