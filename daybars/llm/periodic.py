"""Periodic run detection: where a text repeats itself word by word.

A run is a stretch of consecutive words with smallest period q, at least
``max(6, 4 q)`` words long, that neither neighbouring word extends. All runs
of a text are found through its Lyndon roots: in one of the two orders of the
alphabet every run holds a Lyndon word as long as its period, which reaches
to the next smaller suffix. Each such pair of places is extended to the right
and to the left by longest common extensions, which suffix trees of the text
and of its reversal (Ukkonen) answer in constant time: the extension of two
suffixes is the depth of their lowest common ancestor, the least depth
between their leaves on the Euler tour.

Words that cannot lie in a run are cut out first: in a run every word occurs
at least four times, every three words three times and every five twice, so a
word that is in no such windows ends the stretch. This loses no run (each lies
within one stretch), and most prose has no stretch left; the rest, glued by
separators that occur once, makes one tree. Time and memory grow in proportion to a text, so very long ones are
processed whole. A row is independent of all others: no shuffle.

Defined results: null text has no words (0 runs, digests of the empty
string); a null id rewrites nothing; repeated rows each give a row; an empty
table gives an empty one. ``collapse`` keeps all columns of the input and puts
its own beside them under free names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from daybars.llm.common import fresh

MIN_WORDS, MIN_POWER = 6, 4
#: (words, times): a window of so many words within a run occurs so often in
#: it, as floor((length - words + 1) / q) >= times for every q.
WINDOWS = ((1, 4), (3, 3), (5, 2))
#: Rounds of cutting out rare windows; more would only make the trees smaller.
CUT_ROUNDS = 12

FOUND = ("struct<n_runs:bigint,start:bigint,length:bigint,period:bigint,exponent_milli:bigint,"
         "runs_sha256:string,collapsed_sha256:string,collapsed:string>")


class SuffixTree:
    """Ukkonen's suffix tree of ``s``, whose last symbol is 0 and occurs once."""

    def __init__(self, s: list[int]):
        self.s, self.width = s, max(s) + 1
        self._build()

    def _build(self) -> None:
        s, n, width = self.s, len(self.s), self.width
        first, last, link = [0], [0], [0]       # of the edge into each node; suffix links
        edges: dict[int, int] = {}              # node * width + symbol -> child
        node, at, length, open_ = 0, 0, 0, 0    # active point; suffixes not yet entered
        for i in range(n):
            c, open_, inner = s[i], open_ + 1, 0
            while open_:
                if not length:
                    at = i
                key = node * width + s[at]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if inner:
                        link[inner] = node
                    inner = 0
                else:
                    size = last[child] - first[child]
                    if length >= size:
                        node, at, length = child, at + size, length - size
                        continue
                    f = first[child]
                    if s[f + length] == c:
                        if inner:
                            link[inner] = node
                        length += 1
                        break
                    mid = len(first)
                    edges[key] = mid
                    first += (f, i)
                    last += (f + length, n)
                    link += (0, 0)
                    first[child] = f + length
                    edges[mid * width + s[f + length]] = child
                    edges[mid * width + c] = mid + 1
                    if inner:
                        link[inner] = mid
                    inner = mid
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - open_ + 1
        self.size = np.array(last, np.int64) - np.array(first, np.int64)
        self.keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self.child = np.fromiter(edges.values(), np.int64, len(edges))

    def tour(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the Euler tour's leaves, and the least depth
        on the way from each leaf to the next: that of their common ancestor.

        ``descending`` reverses the order of all symbols but 0.
        """
        parent, symbol = np.divmod(self.keys, self.width)
        rank = np.where(symbol == 0, 0, self.width - symbol) if descending else symbol
        order = np.lexsort((-rank, parent))             # popped from a stack: the smallest last
        child, parent = self.child[order].tolist(), parent[order]
        nodes = len(self.size)
        begin = np.searchsorted(parent, np.arange(nodes + 1)).tolist()
        size, depth, n = self.size.tolist(), [0] * nodes, len(self.s)
        leaves, turns, turn, stack = [], [], 0, [0]
        while stack:
            v = stack.pop()
            if v < 0:                                   # not its parent's first child: reached by way of the parent
                v = ~v
                turn = depth[v] - size[v]
            a, b = begin[v], begin[v + 1]
            if a == b:
                leaves.append(n - depth[v])
                turns.append(turn)
                continue
            d = depth[v]
            for w in child[a:b - 1]:
                depth[w] = d + size[w]
                stack.append(~w)
            w = child[b - 1]
            depth[w] = d + size[w]
            stack.append(w)
        return np.array(leaves, np.int64), np.array(turns[1:], np.int32)


class CommonExtension:
    """Longest common prefixes of suffixes, each in constant time."""

    def __init__(self, leaves: np.ndarray, turns: np.ndarray):
        self.place = np.empty(len(leaves), np.int64)
        self.place[leaves] = np.arange(len(leaves))
        self.least = [turns]
        while (step := 1 << (len(self.least) - 1)) * 2 <= len(turns):
            row = self.least[-1]
            self.least.append(np.minimum(row[:-step], row[step:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i and j of equal number; i and j differ everywhere."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.least[k]
            out[at] = np.minimum(row[a[at]], row[b[at] - (1 << int(k))])
        return out


def next_smaller(place: np.ndarray) -> np.ndarray:
    """For each suffix the start of the next one that is smaller."""
    rank, waiting = place.tolist(), []
    out = np.zeros(len(rank), np.int64)
    for j, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = j
        waiting.append(j)
    return out


def all_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of numbers from 1."""
    s = words.tolist()
    n = len(s)
    tree = SuffixTree(s + [0])
    leaves, turns = tree.tour()
    right = CommonExtension(leaves, turns)
    other = np.empty(n + 1, np.int64)
    other[tree.tour(descending=True)[0]] = np.arange(n + 1)
    del tree
    left = CommonExtension(*SuffixTree(s[::-1] + [0]).tour())
    found = []
    for place in (right.place, other):
        j = next_smaller(place)[:n]
        i = np.flatnonzero(j < n)                       # a root that ends at the text's end has nothing to its right
        j = j[i]
        end = j + right(i, j)
        start = i.copy()
        k = np.flatnonzero(i > 0)
        start[k] -= left(n - i[k], n - j[k])            # the places before i and j, read backwards
        found.append(np.stack([start, end - start, j - i], 1))
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(MIN_WORDS, MIN_POWER * runs[:, 2])]
    runs = np.unique(runs, axis=0)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def stretches(words: np.ndarray) -> np.ndarray:
    """Places of the words that may lie in a run, as far as counting tells.

    A word stays if some window of each kind in WINDOWS that holds it occurs
    often enough in its stretch, a stretch if it has MIN_WORDS words; what goes
    splits stretches.
    """
    at = np.flatnonzero(np.bincount(words)[words] >= MIN_POWER)
    for _ in range(CUT_ROUNDS):
        before = len(at)
        for width, least in WINDOWS:
            stretch = _stretch(at)
            at = at[(np.bincount(stretch) >= MIN_WORDS)[stretch]] if len(at) else at
            if not len(at):
                return at
            stretch = _stretch(at)
            whole = stretch[width - 1:] == stretch[:len(at) - width + 1]
            window = stretch[:len(whole)]
            for k in range(width):
                pairs = window * (int(words.max()) + 1) + words[at[k:k + len(whole)]]
                window = np.unique(pairs, return_inverse=True)[1]
            often = whole & (np.bincount(window, whole)[window] >= least)
            cover = np.zeros(len(at) + 1, np.int64)
            cover[:len(often)] += often
            cover[width:] -= often
            at = at[np.cumsum(cover)[:-1] > 0]
        if len(at) == before:
            break
    return at


def _stretch(at: np.ndarray) -> np.ndarray:
    """Number of the stretch of each place."""
    return np.cumsum(np.diff(at, prepend=at[:1]) > 1)


def runs_of(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of a whole text."""
    at = stretches(words)
    if len(at) < MIN_WORDS:
        return np.zeros((0, 3), np.int64)
    kept, numbers = np.unique(words[at], return_inverse=True)
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    glued = np.insert(numbers + 1, gaps, len(kept) + 1 + np.arange(len(gaps)))
    origin = np.insert(at, gaps, -1)
    start, length, period = all_runs(glued)
    runs = np.stack([origin[start], length, period], 1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.array([seen[w] for w in words], np.int64)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the contract's periodic tail, which one document in ten has."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a:a + p]
    return words[:a] + (root * ((n - a) // p + 1))[:n - a]


def _digest(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def found_in(words: list[bytes]) -> dict:
    """Runs of a text, its strongest one, and the text with each run reduced to
    its first period."""
    runs = runs_of(numbered(words)) if len(words) >= MIN_WORDS else np.zeros((0, 3), np.int64)
    best = (None,) * 4
    if len(runs):
        start, length, period = runs.T
        # a quotient of numbers below 2^26 is rounded to another double than any other quotient of such
        top = np.lexsort((period, start, -(length / period)))[0]
        best = (int(start[top]), int(length[top]), int(period[top]), int(1000 * int(length[top]) // int(period[top])))
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, start + length, -1)
        dropped = np.cumsum(cover)[:-1] > 0
        words = [w for w, gone in zip(words, dropped.tolist()) if not gone]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    collapsed = b" ".join(words)
    return {"n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": best[3],
            "runs_sha256": _digest(listed.encode()), "collapsed_sha256": _digest(collapsed),
            "collapsed": collapsed.decode()}


def _finder(with_text: bool, rewrite: bool):
    fields = [(f.split(":")[0], pa.string() if f.endswith("string") else pa.int64())
              for f in FOUND[len("struct<"):-1].split(",")]
    fields = fields if with_text else fields[:-1]
    kind = FOUND if with_text else FOUND.replace(",collapsed:string", "")

    @arrow_udf(kind)
    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            out = []
            for k in range(len(texts)):
                text = texts[k].as_py()
                words = text.encode().split() if text else []
                out.append(found_in(planted(words, ids[k].as_py()) if rewrite else words))
            yield pa.StructArray.from_arrays([pa.array([r[n] for r in out], t) for n, t in fields], [n for n, _ in fields])
    return find


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and a struct ``runs``: number of runs, the
    strongest one, digests, and ``collapsed``, the text in which each run keeps
    only its first period."""
    return docs.withColumn(fresh(docs, "runs"), _finder(True, False)(F.lit(None).cast("bigint"), F.col(text)))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document under the contract, periodic tails planted."""
    found: Column = _finder(False, True)(F.col(doc_id).cast("bigint"), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), found.alias("r"))
    return rows.select("doc_id", "r.*")
