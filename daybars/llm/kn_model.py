"""Interpolated modified Kneser-Ney of order 4 over code points, as tables.

An n-gram is (h, c): its last symbol and the up to three before it, 21 bits
each, so every code point is a symbol of its own and a context fits a long.
Symbol 0 is the boundary, any other a code point plus one. Counts are summed
by n-gram after a map-side combine, lower orders are continuation counts of
the next higher one; the tables grow with the corpus and are sharded by
n-gram. Only counts of counts reach the driver; Spark may broadcast a side of
a join that is below its own size limit.

There is one model for each fold of the trusted documents, counted on the
text of the other folds, so that no document is scored by a model that has
seen it, and one (``WHOLE``) on all trusted text, for all other documents.

To score, documents are read in the order of their files and dealt into chunks
of consecutive rows. The distinct n-grams of each chunk are collected where the
rows are read and joined with the tables of all models, and each chunk is scored
with the log probabilities that came back for it. A text crosses the network
once, to meet them, and compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from daybars.llm.common import fresh, materialize

ORDER = 4
FOLDS = 2
ALPHABET = 0x110000 + 1     # every code point, and the boundary
WHOLE = FOLDS               # the model that leaves nothing out
#: Counts of counts of little text may call for no discount at all; then nothing
#: would be left for what was never seen.
MIN_DISCOUNT = 0.1
#: A chunk ends before it has more characters or rows than this; a longer text is
#: one of its own.
CHUNK_CHARS, CHUNK_ROWS = 16_000_000, 1 << 16
_BITS = 21
_SYMBOL = (1 << _BITS) - 1
_LOW = 0xFFFF | 0xFFFF << _BITS | 0xFFFF << 2 * _BITS
_PIECE = 1 << 20


def fold_of(doc_id: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(f"fold{salt}"), doc_id), F.lit(FOLDS)).cast("int")


def windows(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(h, c) at every character and at the end, in pieces."""
    for at in range(0, len(text) + 1, _PIECE):
        part = text[max(0, at - ORDER + 1):at + _PIECE]
        s = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
        s = np.concatenate((np.zeros(max(0, ORDER - 1 - at), np.int64), s, np.zeros(int(at + _PIECE > len(text)), np.int64)))
        yield s[:-3] << 2 * _BITS | s[1:-2] << _BITS | s[2:-1], s[3:]


def _key(h: np.ndarray, c: np.ndarray) -> np.ndarray | None:
    """The n-gram in 64 bits, if all of its symbols are below 2^16."""
    if int(np.bitwise_or.reduce(h)) & ~_LOW or int(np.bitwise_or.reduce(c)) >> 16:
        return None
    return (h >> 2 * _BITS << 48 | (h >> _BITS & 0xFFFF) << 32 | (h & 0xFFFF) << 16 | c).view(np.uint64)


def distinct(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each n-gram once, and how often it is there."""
    key = _key(h, c)
    if key is None:
        contexts, at = np.unique(h, return_inverse=True)
        u, n = np.unique(at.astype(np.int64) << _BITS | c, return_counts=True)
        return contexts[u >> _BITS], u & _SYMBOL, n
    u, n = np.unique(key, return_counts=True)
    a, b, d, e = ((u >> np.uint64(k) & np.uint64(0xFFFF)).astype(np.int64) for k in (48, 32, 16, 0))
    return a << 2 * _BITS | b << _BITS | d, e, n


class Lookup:
    """Log probabilities, by model, of the n-grams that a chunk asked for."""

    def __init__(self, h: np.ndarray, c: np.ndarray, logp: list[np.ndarray]) -> None:
        key = _key(h, c)
        self.small = key is not None
        if key is None:
            self.contexts = np.unique(h)
            key = self._wide(h, c)
        order = np.argsort(key)
        self.key, self.logp = key[order], [x[order] for x in logp]

    def _wide(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.contexts, h).astype(np.int64) << _BITS | c

    def total(self, h: np.ndarray, c: np.ndarray, fold: int) -> float:
        key = _key(h, c) if self.small else self._wide(h, c)
        return float(self.logp[fold][np.searchsorted(self.key, key)].sum())

    def perplexity(self, text: str | None, fold: int) -> float | None:
        """Per symbol, over the whole text; None without characters."""
        if not text:
            return None
        return math.exp(-sum(self.total(h, c, fold) for h, c in windows(text)) / (len(text) + 1))


def count_grams(texts: DataFrame) -> DataFrame:
    """(fold, h, c, n) of (text, fold): ``fold`` is the one left out, n counts
    the others; ``WHOLE`` counts all."""
    schema = pa.schema([("own", pa.int32()), ("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])

    def batch(own: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, c, n = distinct(*map(np.concatenate, zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), own, np.int32)), *map(pa.array, (h, c, n))], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[int, int] = {}
        for b in batches:
            for text, own in zip(b.column(0), b.column(1).to_pylist()):
                for w in windows(text.as_py()):
                    held.setdefault(own, []).append(w)
                    size[own] = size.get(own, 0) + len(w[0])
                    if size[own] > _PIECE:
                        yield batch(own, held.pop(own))
                        size[own] = 0
        for own, rest in held.items():
            yield batch(own, rest)

    rows = texts.select("text", "fold").mapInArrow(count, "own int, h long, c long, n long")
    every = rows.groupBy("h", "c").agg(F.sum("n").alias("n"), *[
        F.coalesce(F.sum(F.when(F.col("own") == f, F.col("n"))), F.lit(0)).alias(f"n{f}") for f in range(FOLDS)])
    models = [F.struct(F.lit(f).alias("fold"), (F.col("n") - F.col(f"n{f}")).alias("n")) for f in range(FOLDS)]
    left = F.explode(F.array(*models, F.struct(F.lit(WHOLE).alias("fold"), F.col("n").alias("n"))))
    return every.select("h", "c", left.alias("x")).select("x.fold", "h", "c", "x.n").where("n > 0")


def _shorter(order: int) -> Column:
    """The context of an n-gram cut to ``order`` symbols with its last."""
    return F.col("h").bitwiseAND(F.lit((1 << _BITS * (order - 1)) - 1)).alias("h")


def levels(counts: DataFrame) -> dict[int, DataFrame]:
    """Counts of the highest order, continuation counts of the others."""
    out = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        out[k] = materialize(out[k + 1].groupBy("fold", _shorter(k), "c").agg(F.count("*").alias("n")), "kn-level")
    return out


def _discount(counts: DataFrame) -> Column:
    """What is taken off ``n``, by the fold's counts of counts."""
    seen = {r["fold"]: [r[f"n{k}"] for k in (1, 2, 3, 4)] for r in counts.groupBy("fold").agg(
        *[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()}
    by_fold = []
    for f in range(FOLDS + 1):
        n = seen.get(f, [0] * 4)
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        by_fold.append(F.array(*[
            F.lit(min(k, max(MIN_DISCOUNT, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5).cast("double") for k in (1, 2, 3)]))
    return F.array(*by_fold)[F.col("fold")][(F.least(F.col("n"), F.lit(3)) - 1).cast("int")]


def probabilities(tables: dict[int, DataFrame], wanted: DataFrame) -> DataFrame:
    """(fold, h, c, p) of the distinct (fold, h, c)."""
    asked = {ORDER: wanted}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select("fold", _shorter(k), "c").distinct()
    out = None
    for k in range(1, ORDER + 1):
        rows = tables[k].withColumn("d", _discount(tables[k]))
        # sums by size class, so that the order of addition changes nothing
        contexts = rows.groupBy("fold", "h", "d").agg(F.sum("n").alias("n"), F.count("*").alias("k")).groupBy("fold", "h").agg(
            F.sum("n").alias("total"), F.array_sort(F.collect_list(F.col("d") * F.col("k"))).alias("held"))
        contexts = contexts.select("fold", "h", "total", F.aggregate("held", F.lit(0.0), lambda a, x: a + x).alias("held"))
        got = asked[k].join(rows, ["fold", "h", "c"], "left").join(contexts, ["fold", "h"], "left")
        if out is None:
            got = got.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            low = out.select("fold", F.col("h").alias("h_low"), "c", F.col("p").alias("lower"))
            got = got.withColumn("h_low", _shorter(k - 1)).join(low, ["fold", "h_low", "c"])
        own = F.coalesce((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0))
        back = F.coalesce(F.col("held") / F.col("total"), F.lit(1.0))
        out = got.select("fold", "h", "c", (own + back * F.col("lower")).alias("p"))
    return out


def asked_of(docs: DataFrame, place: list[str]) -> DataFrame:
    """(file, start, h, c): the distinct n-grams of each chunk, a chunk being the
    rows of a file from ``start`` to the next start. Pass rows as they are read;
    every chunk has a row, be it without text."""
    schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = start = None
        chars = rows = loose = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            h, c, _ = distinct(*map(np.concatenate, zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), x, np.int64)) for x in (file, start)]
                                              + [pa.array(h), pa.array(c)], schema=schema)
        for b in batches:
            for of, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py() or ""
                if of != file or rows == CHUNK_ROWS or chars + len(text) > CHUNK_CHARS:
                    if file is not None:
                        yield emit()
                    file, start, chars, rows, loose = of, row, 0, 0, 0
                    held = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
                chars, rows = chars + len(text), rows + 1
                for w in windows(text) if text else ():
                    held.append(w)
                    loose += len(w[0])
                    if loose > _PIECE:
                        held, loose = [distinct(*map(np.concatenate, zip(*held)))[:2]], 0
        if file is not None:
            yield emit()
    return materialize(docs.select(*place, "text").mapInArrow(ask, "file long, start long, h long, c long"), "kn-asked")


@arrow_udf(T.BinaryType())
def _packed(texts: pa.Array) -> pa.Array:
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(t.as_py().encode()) if t.is_valid else None for t in texts], pa.binary())


def score(docs: DataFrame, tables: dict[int, DataFrame], name: str, fold: str, place: list[str], asked: DataFrame,
          columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with the perplexity of ``text`` as column ``name``, by
    the model that ``fold`` names. ``docs`` are rows of what ``asked`` was collected
    from, perhaps joined since, with the columns ``place`` of ``common.placed``."""
    file, row = place
    sent = [c for c in columns if c != "text"]
    pack = fresh(docs, "_packed")
    key, starts, start = (fresh(docs, c) for c in ("_file_of", "_starts", "_start"))
    # one row per file, so broadcast while its size allows
    chunks = materialize(asked.groupBy(F.col("file").alias(key)).agg(F.sort_array(F.collect_set("start")).alias(starts)), "kn-chunks")
    own = F.element_at(F.filter(starts, lambda s: s <= F.col(row)), -1)
    dealt = docs.join(chunks, F.col(file) == F.col(key)).withColumn(start, own).select(*sent, _packed("text").alias(pack), fold, file, start)

    models = range(FOLDS + 1)
    wanted = materialize(asked.select("h", "c").distinct().select(F.explode(F.array(*map(F.lit, models))).alias("fold"), "h", "c"), "kn-wanted")
    known = probabilities(tables, wanted).groupBy("h", "c").agg(
        *[F.max(F.when(F.col("fold") == k, F.log("p"))).cast("float").alias(f"p{k}") for k in models])
    back = asked.join(materialize(known, "kn-known"), ["h", "c"])

    def apply(table: pa.Table, got: pa.Table) -> pa.Table:
        look = Lookup(got.column("h").to_numpy(), got.column("c").to_numpy(),
                      [got.column(f"p{k}").to_numpy().astype(np.float64) for k in models])
        press = zstandard.ZstdDecompressor()
        texts = [press.decompress(t.as_py()).decode() if t.is_valid else None for t in table.column(pack)]
        values = [look.perplexity(t, f) for t, f in zip(texts, table.column(fold).to_pylist())]
        out = [pa.array(texts, pa.string()) if c == "text" else table.column(c) for c in columns]
        return pa.Table.from_arrays([*out, pa.array(values, pa.float64())], [*columns, name])
    schema = T.StructType([*docs.select(columns).schema.fields, T.StructField(name, T.DoubleType())])
    return dealt.groupBy(file, start).cogroup(back.groupBy("file", "start")).applyInArrow(apply, schema)
