"""Packing token sequences with shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of the sequence length plus a
remainder.  The packing itself sees only the histogram of piece lengths (at
most ``seq_len`` rows, on the driver): lengths are placed longest first, each
into the packs that are shortest so far and still have room, and packs are
kept as patterns with counts.  Pieces then find their place by their rank
among the pieces of their length.

Defined cases: null text counts as empty; an empty document is its end token
alone; repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import materialise, prepare, salted_rank, spread, text_slices, tidy, words

SEQ_LEN = 4096
END_ID = 2
CACHE_WORDS = 400_000    # distinct words whose ids a Python worker remembers
SLICE_BYTES = 1 << 20    # documents are tokenised in slices of about this many bytes

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _byte_alphabet() -> dict[int, str]:
    """Byte-level alphabet of the vocabulary: a printable byte is its own Latin-1 character, the others follow from 256."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = sorted(set(range(256)) - set(printed))
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()
_LATIN_BYTES = {c: "".join(map(_ALPHABET.get, chr(c).encode())) for c in range(0xC0, 0x100)}


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_MARKS = ".,!?;:"            # a run of these after a letter, at the end of a word, is a piece of its own
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS.encode())] = True
_LATIN = regex.compile(r"[a-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


class WordTokenizer:
    """Ids of whole texts through a memory of words.

    The vocabulary never spans white space and folds case, so a text's ids are
    those of its words in a row; words are found by a 64-bit hash of their
    bytes (A-Z folded) and each distinct one is encoded once.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.end_id = end_id
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)               # ascending
        self.place = np.zeros(0, np.int64)                 # of each hash in begin and count
        self.flat = np.full(1 << 16, self.end_id, np.uint32)
        self.begin, self.count = np.zeros(1, np.int64), np.ones(1, np.int64)   # place 0: the end of a text
        self.used = 1

    def _learn(self, hashes: np.ndarray, spelled: list[str]) -> None:
        lists, tokenize, latin = [], self.model.tokenize, _LATIN.fullmatch
        for word in spelled:
            low = word.lower()
            if latin(low) and len(low) == len(word):       # Latin letters go straight to the model
                lists.append([t.id for t in tokenize(low if low.isascii() else low.translate(_LATIN_BYTES))])
            else:                                          # any other word through the whole tokenizer
                lists.append(self.tok.encode(word, add_special_tokens=False).ids)
        count = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(count.sum()))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.uint32)])
        self.flat[self.used: self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.place = np.insert(self.place, at, len(self.begin) + np.arange(len(lists)))
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a slice in a row, each with its end; number of ids of each text)."""
        if len(self.hashes) > CACHE_WORDS:
            self.clear()
        w = words(data, offsets, lower=True)
        starts, ends, text = w.starts, w.ends, np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
        # cut the marks off the end of words whose last other character is a Latin letter
        last = np.maximum.accumulate(np.where(_IS_MARK[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, np.int64)
        core = np.maximum(last[ends - 1] + 1, starts)
        tail, tail_2 = data[np.maximum(core - 1, 0)], data[np.maximum(core - 2, 0)]
        cut = (core < ends) & (core > starts) & (
            _LETTER[tail] | ((core - starts > 1) & (tail_2 == 0xC3) & (tail >= 0x80) & (tail != 0x97) & (tail != 0xB7)))
        order = np.argsort(np.concatenate([starts, core[cut]]), kind="stable")
        ends = np.concatenate([np.where(cut, core, ends), ends[cut]])[order]
        starts, text = np.concatenate([starts, core[cut]])[order], np.concatenate([text, text[cut]])[order]
        hashes = w.roll.of(starts, ends)

        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        if len(self.hashes):
            known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes
        found = np.zeros(len(hashes), np.int64)
        found[known] = self.place[at[known]]
        if not known.all():
            missing = np.flatnonzero(~known)
            new, nth, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw, nth = data.tobytes(), missing[nth]
            found[missing] = len(self.begin) + inverse
            self._learn(new, [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[nth].tolist(), ends[nth].tolist())])
        # every text's words, then its end
        size = np.bincount(text, minlength=len(offsets) - 1) + 1
        place = np.zeros(len(hashes) + len(size), np.int64)
        is_word = np.ones(len(place), bool)
        is_word[np.cumsum(size) - 1] = False
        place[is_word] = found
        counts = self.count[place]
        stop = np.cumsum(counts)
        ids = self.flat[np.repeat(self.begin[place] - (stop - counts), counts) + np.arange(stop[-1])]
        return ids, np.diff(stop[np.cumsum(size) - 1], prepend=0)


_TOKENIZERS: dict[tuple[str, int], WordTokenizer] = {}


def _pieces(vocabulary: str, seq_len: int, end_id: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _TOKENIZERS.get((vocabulary, end_id))
        if tok is None:
            tok = _TOKENIZERS[vocabulary, end_id] = WordTokenizer(vocabulary, end_id)
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, hi, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                ids, counts = tok.encode(data, offsets)
                raw, base = ids.astype("<u4").tobytes(), np.cumsum(counts) - counts
                pieces = -(-counts // seq_len)
                row = np.repeat(np.arange(hi - lo), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * seq_len
                length = np.minimum(counts[row] - start, seq_len)
                at = 4 * (base[row] + start)
                view = memoryview(raw)
                crc = [zlib.crc32(view[a: a + 4 * n]) for a, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(lo + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def shortest_pack_first(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[list[int], int]]:
    """Patterns (piece lengths in order, number of packs) that hold every piece of the histogram.

    Lengths are placed longest first.  ``room`` maps the free space of packs to
    their patterns; the packs with the most free space, the shortest ones, get
    the next piece as long as it fits, else it opens a pack.
    """
    room: dict[int, list[tuple[list[int], int]]] = {seq_len: []}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            most = max(room, default=0)
            if most < length or not room[most]:
                if room.get(most) == []:
                    del room[most]
                    continue
                most, pattern, packs = seq_len, [], left
            else:
                pattern, packs = room[most].pop()
            n = min(packs, left)
            if packs > n and pattern:
                room[most].append((pattern, packs - n))
            elif most in room and not room[most]:
                del room[most]
            room.setdefault(most - length, []).append(([*pattern, length], n))
            left -= n
    return [p for free in room.values() for p in free]


def _places(patterns: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of ranks that a pattern holds."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, packs in patterns:
        offset = 0
        for length in pattern:
            rank = ranks.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, offset))
            ranks[length] = rank + packs
            offset += length
        sequence += packs
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in out.items()}


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   seq_len: int = SEQ_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(spread(texts).mapInArrow(_pieces(vocabulary, seq_len, end_id), PIECE_SCHEMA))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= seq_len rows
    places = spark.sparkContext.broadcast(_places(shortest_pack_first(histogram, seq_len)))
    ranked = salted_rank(pieces, ["length"], [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "nth")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for length, at in b.groupby("length").indices.items():
                ranks, sequences, offsets = places.value[int(length)]
                rank = b["nth"].to_numpy()[at]
                run = np.searchsorted(ranks, rank, "right") - 1
                sequence[at], offset[at] = sequences[run] + rank - ranks[run], offsets[run]
            yield b.drop(columns="nth").assign(sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth").mapInPandas(
        place, PIECE_SCHEMA + ", sequence_id long, offset long")
