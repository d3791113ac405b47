"""Hashed character n-grams of whole texts, word by word, in numpy.

A text is its runs of letters, lower-cased, with one boundary mark between
words; an n-gram may hold a mark only as its first or last character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

MARK = 1                  # code of the word boundary
SLICE_CHARS = 1 << 18

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def letter_stream(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes with marks between words, at the start and at the end; row of each code)."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(low)), np.fromiter(map(len, low), np.int64, len(low)))
    letter = letters()[codes]
    keep = np.flatnonzero(letter)
    if not len(keep):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    # a new word starts after a gap in positions or with another text
    first = np.ones(len(keep), bool)
    first[1:] = (np.diff(keep) > 1) | (np.diff(row[keep]) > 0)
    place = np.arange(len(keep)) + np.cumsum(first)
    out = np.full(place[-1] + 2, MARK, dtype=np.uint32)
    rows = np.empty(len(out), np.int64)
    out[place] = codes[keep]
    rows[place] = row[keep]
    marks = place[first] - 1
    rows[marks] = rows[marks + 1]
    rows[-1] = rows[-2]
    return out, rows


def ngrams(texts: Sequence[str], sizes: Sequence[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its row) of whole texts."""
    codes, rows = letter_stream(texts)
    n_codes = len(codes)
    mark = codes == MARK
    inner = np.concatenate([[0], np.cumsum(mark)])
    found, owner = [], []
    h = np.zeros(n_codes, np.uint32)
    for n in range(1, max(sizes) + 1):
        m = n_codes - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) + codes[n - 1:] * np.uint32(0x9E3779B1)
        if n not in sizes:
            continue
        if n > 2:   # no mark inside
            ok = inner[n - 1: n - 1 + m] == inner[1: m + 1]
        else:       # a mark alone, or two in a row, is no n-gram
            ok = ~mark[:m] if n == 1 else ~(mark[:m] & mark[1: m + 1])
        at = np.flatnonzero(ok)
        x = h[at] ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        found.append((x >> np.uint32(32 - bits)).astype(np.int32))
        owner.append(rows[at + mark[at]])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner)
