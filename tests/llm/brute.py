"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\v\f\r"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Groups:
    """Union-find whose root is the smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y):
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def exact(rows):
    """(doc_id, text) -> sorted (doc_id, keep_id, group_size, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, g in groups.items():
        keep = min(g)[3]
        out += [(i, keep, len(g), hashlib.sha256(norm.encode()).hexdigest()) for *_, i in g]
    return out


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[k:] for k in range(size)])) if len(w) >= size else ({tuple(w)} if w else set())


def near(docs, percent):
    """{id: text} -> {id: (set size, component)}."""
    sets, g = {i: shingles(t) for i, t in docs.items()}, Groups()
    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for x in s for j in holders[x])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                g.join(i, j)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), g.find(i)) for i, s in sets.items()}


def substring(docs, window):
    """{id: text} -> {id: (words, removed, sha of the kept ones)}."""
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k: k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k: k + window])] < i:
                gone[k: k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_places(docs, edits, min_chars):
    """{id: text} -> {id: places of lines that go}."""
    places = [(i, k, x.strip(SPACE)) for i in sorted(docs) for k, x in enumerate((docs[i] or "").split("\n")) if x.strip(SPACE)]
    lines, g = sorted({x for *_, x in places}), Groups()
    long = [x for x in lines if len(x) >= min_chars]
    for n, x in enumerate(long):
        for y in long[n + 1:]:
            if abs(len(x) - len(y)) <= edits and sum(((Counter(x) - Counter(y)) + (Counter(y) - Counter(x))).values()) <= 2 * edits:
                if edit_distance(x, y) <= edits:
                    g.join(x, y)
    seen, out = set(), {i: [] for i in docs}
    for i, k, x in places:
        root = g.find(x)
        if root in seen:
            out[i].append(k)
        seen.add(root)
    return out


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n
