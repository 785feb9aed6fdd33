"""Benchmark decontamination: a broadcast set of normalised test n-grams.

Words are folded (A-Z lower-cased, ASCII punctuation splits). A benchmark
item gives every window of ``n`` consecutive words, or its whole word
sequence if it is shorter. Each task numbers the words of the test set,
slides a polynomial hash over a document's word numbers, looks the hashes up
and verifies every hit word by word. Documents are never shuffled.

The broadcast side is bounded: the test set is dealt into slices of about
``SLICE_BYTES`` of text (some 410 bytes of memory a word: 300 MB, on the driver
and in each Python worker), one after the other. Each is a pass over the
documents that writes the rows with hits, keyed by where the row is stored, and
is released before the next; the spans of all passes are merged per document
before anything is decided or cut. An item longer than a slice makes one of its own.

Null or empty texts have no words and are clean; a null item text is no
window; a window of an item without id marks words but names no item; repeated
items count once; repeated documents are each scanned; very long texts are scanned
whole, in time proportional to their length; an empty table gives an empty
result; columns of the input that have our names stay as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybars.llm.common import fresh, materialize, placed, words_of

N = 10
SLICE_BYTES = 4 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
SCAN = "n_words long, spans array<struct<start:long,end:long>>, items array<string>"


class NgramSet:
    """Windows of some benchmark items, ready for lookup."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.ids: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str | None]] = defaultdict(set)
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)]
            size = min(n, len(w))
            for i in range(len(w) - size + 1 if w else 0):
                self.windows[tuple(w[i:i + size])].add(item)
        self.lengths = sorted({len(w) for w in self.windows})
        self.hashes = {k: np.unique(_rolled(np.array([w for w in self.windows if len(w) == k], np.uint64).ravel(), k)[::k])
                       for k in self.lengths}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Words, merged hit spans (word positions, end exclusive), item ids."""
        words = words_of(text)
        n = len(words)
        if not n or not self.lengths:
            return n, [], []
        get = self.ids.get
        w = np.fromiter((get(x, 0) for x in words), np.uint64, n)
        spans, items = [], set()
        for k in self.lengths:
            for at in self._candidates(w, k):
                found = self.windows.get(tuple(w[at:at + k].tolist()))
                if found:
                    spans.append((at, at + k))
                    items |= found
        return n, merged(spans), sorted(x for x in items if x is not None)

    def _candidates(self, w: np.ndarray, k: int) -> list[int]:
        """Starts of k words, all known to the test set, whose hash it has."""
        if len(w) < k:
            return []
        unknown = np.concatenate(([0], np.cumsum(w == 0)))
        starts = np.flatnonzero(unknown[k:] == unknown[:-k])
        if not len(starts):
            return []
        hashes = _rolled(w, k)[starts]
        table = self.hashes[k]
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return starts[table[at] == hashes].tolist()


def _rolled(w: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each k consecutive numbers."""
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h = h * _B + w[j:len(w) - k + 1 + j]
    return h


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scanner(grams: Broadcast) -> Column:
    @F.pandas_udf(SCAN)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g = grams.value
        for texts in batches:
            rows = [g.scan(t) for t in texts]
            yield pd.DataFrame({
                "n_words": [r[0] for r in rows],
                "spans": [[{"start": a, "end": b} for a, b in r[1]] for r in rows],
                "items": [r[2] for r in rows]}, columns=["n_words", "spans", "items"])
    return run.asNondeterministic()


def ngram_slices(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N,
                 slice_bytes: int | None = None) -> Iterator[NgramSet]:
    """N-gram sets, each over about ``slice_bytes`` of text, made one at a time."""
    items = bench.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("body"))
    total = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = -(-total // (slice_bytes or SLICE_BYTES)) or 1
    part = F.pmod(F.xxhash64("item", "body"), F.lit(parts))
    for i in range(parts):
        yield NgramSet([tuple(r) for r in items.where(part == i).distinct().collect()], n)


def scan(docs: DataFrame, bench: DataFrame, text_col: str = "text", out: str = "hits", n: int = N,
         slice_bytes: int | None = None) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, spans, items."""
    sc, slices = docs.sparkSession.sparkContext, ngram_slices(bench, n=n, slice_bytes=slice_bytes)
    first = next(slices)
    second = next(slices, None)
    if second is None:
        return docs.withColumn(out, _scanner(sc.broadcast(first))(F.col(text_col)))
    docs, place = placed(docs)
    key = [F.col(c) for c in place]
    hits = []
    for grams in chain([first, second], slices):
        held = sc.broadcast(grams)
        found = docs.select(*key, _scanner(held)(F.col(text_col)).alias("h")).where(F.size("h.spans") > 0)
        hits.append(materialize(found.select(*key, "h.spans", "h.items"), "slice-hits"))
        held.destroy()
    spans, items, words = (fresh(docs, c) for c in ("_spans", "_items", "_words"))
    # one row per document with hits: small, and written, so broadcast while its size allows
    every = materialize(reduce(DataFrame.unionByName, hits).groupBy(*place).agg(
        _merge(F.array_sort(F.flatten(F.collect_list("spans")))).alias(spans),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items)), "all-hits")
    none = F.array()
    return docs.join(every, place, "left").withColumn(words, _scanner(sc.broadcast(NgramSet([], n)))(F.col(text_col))).withColumn(
        out, F.struct(F.col(f"{words}.n_words").alias("n_words"),
                      F.coalesce(spans, none.cast("array<struct<start:long,end:long>>")).alias("spans"),
                      F.coalesce(items, none.cast("array<string>")).alias("items"))).drop(*place, spans, items, words)


def _merge(spans: Column) -> Column:
    """Merge sorted, perhaps overlapping spans."""
    kind = "array<struct<start:long,end:long>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), grown).otherwise(
            F.concat(acc, F.array(s)))
    return F.aggregate(spans, F.array().cast(kind), step)


def report(docs: DataFrame, bench: DataFrame, n: int = N, slice_bytes: int | None = None) -> DataFrame:
    """Per document: n_words, n_hit, n_items, the items' digest, contaminated."""
    hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return scan(docs.select("doc_id", "text"), bench, n=n, slice_bytes=slice_bytes).select(
        "doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    """Documents without any hit; all columns kept, clean rows untouched."""
    mark = fresh(docs, "_hits")
    return scan(docs, bench, out=mark, n=n).where(F.size(f"{mark}.spans") == 0).select(docs.columns)


def cut_spans(docs: DataFrame, bench: DataFrame, n: int = N, slice_bytes: int | None = None) -> DataFrame:
    """Documents with the hit words cut out of the text; clean texts untouched.

    A cut runs from the first hit word of a span to its last one, spans as found
    by all slices together; what stands around it is joined by one blank.
    """
    mark = fresh(docs, "_hits")
    found = scan(docs, bench, out=mark, n=n, slice_bytes=slice_bytes)
    return found.withColumn("text", _cut("text", f"{mark}.spans")).select(docs.columns)


@F.pandas_udf(T.StringType())
def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut_text(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(texts, spans)], dtype=object)


def cut_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` (word numbers, end exclusive)."""
    if not spans:
        return text
    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    pieces, at = [], 0
    for a, b in spans:
        pieces.append(text[at:places[a][0]].rstrip())
        at = places[b - 1][1]
    pieces.append(text[at:].lstrip())
    return " ".join(p for p in pieces if p)
