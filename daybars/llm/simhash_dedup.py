"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint of 64 majority bits over the XXH64 hashes of word shingles.
For a radius r and m segments on a ring, two fingerprints within r bits have
a segment from which every chain of l consecutive segments differs by at most
floor(l * r / m) bits. The chains of one and two segments become join keys
(first segment equal, second at most one bit off); the longer chains are
checked on the pair before the full bit count.

Nulls and empty texts have fingerprint 0 and link like any other; equal rows
share their fingerprint; a null doc_id never names a component unless no
row of the component has an id. Very long texts are hashed whole, slice by slice.
An empty table gives an empty result; columns of the input that have our names
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybars.llm.common import fresh, materialize, tokens_of
from daybars.llm.components import bits, connected_components, hamming_links

SHINGLE = 4
RADIUS = 4
SEED = 42
STARTS = (0, 13, 26, 39, 52)       # first bits of five segments on the ring
WIDTHS = (13, 13, 13, 13, 12)
HOT = 500
_SLICE = 65_536


def simhash(text: str | None, k: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes, as a signed 64-bit integer."""
    words = tokens_of(text)
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < k:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = list(zip(starts[: n - k + 1].tolist(), ends[k - 1:].tolist(), strict=True))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), _SLICE):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[at:at + _SLICE]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, k: int = SHINGLE) -> Column:
    """Column of fingerprints, computed in Arrow batches."""
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t, k) for t in texts], dtype="int64")
    return run.asNondeterministic()(text)


def _chain(fp: Column, i: int) -> Column:
    """Segments i and i+1 of the ring, tagged with i."""
    pair = bits(STARTS[i], WIDTHS[i] + WIDTHS[(i + 1) % 5])
    return F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(pair)))


def ring_index(fp: Column) -> Column:
    return F.array(*[_chain(fp, i) for i in range(5)])


def ring_probes(fp: Column) -> Column:
    """Each chain as it is, and with one bit of its second segment changed."""
    keys = []
    for i in range(5):
        j = (i + 1) % 5
        masks = [0] + [bits(STARTS[j] + b, 1) for b in range(WIDTHS[j])]
        keys += [_chain(fp.bitwiseXOR(F.lit(m)), i) for m in masks]
    return F.array(*keys)


def ring_budget(radius: int = RADIUS) -> Column:
    """Some segment starts chains of every length within proportional budgets."""
    x = F.col("fp").bitwiseXOR(F.col("other"))
    fits = F.lit(False)
    for i in range(5):
        chains = F.lit(True)
        for length in range(1, 6):
            width = sum(WIDTHS[(i + k) % 5] for k in range(length))
            chains &= F.bit_count(x.bitwiseAND(F.lit(bits(STARTS[i], width)))) <= length * radius // 5
        fits |= chains
    return fits


def near_components(fps: DataFrame) -> DataFrame:
    """(fp, root_fp) for the fingerprints of ``fps`` that are linked to another."""
    fp = F.col("fp")
    links = hamming_links(fps.select("fp").distinct(), ring_probes(fp), ring_index(fp), RADIUS, HOT, ring_budget())
    return connected_components(links).select(F.col("node").alias("fp"), F.col("root").alias("root_fp"))


def _grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (id, fp, h): (fp, root_fp), and per root the first row (no id last)."""
    groups = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("void"), "id", "h"))
                                                .alias("first")), "simhash-groups")
    linked = groups.join(near_components(groups), "fp", "left").withColumn("root_fp", F.coalesce("root_fp", "fp"))
    return linked.select("fp", "root_fp"), linked.groupBy("root_fp").agg(F.min("first").alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per document: id, fp, component_id (smallest id reachable)."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), k).alias("fp"),
                                   F.lit(0).alias("h")), "simhash")
    linked, firsts = _grouped(rows)
    by_fp = linked.join(firsts, "root_fp").select("fp", F.col("first.id").alias("component_id"))
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """Keep one document of each component: the one with its smallest id.

    Of several different rows with that id, the one with the smallest row
    hash stays; of equal rows, one. A row without id stays only where no row
    of its component has an id.
    """
    whole = F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind])
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), k).alias("fp"),
                                   whole.alias("h")), "simhash")
    _, firsts = _grouped(rows)
    keep_id, keep_h, mark = fresh(docs, "_keep_id"), fresh(docs, "_keep_h"), fresh(docs, "_row_hash")
    keep = firsts.select(F.col("first.id").alias(keep_id), F.col("first.h").alias(keep_h))
    tagged = docs.withColumn(mark, whole)
    on = lambda side: tagged[id_col].eqNullSafe(side[keep_id]) & (tagged[mark] == side[keep_h])
    repeated = materialize(rows.groupBy(F.col("id").alias(keep_id), F.col("h").alias(keep_h)).count()
                           .where("count > 1").drop("count"), "simhash-repeated")
    kept = tagged.join(keep, on(keep), "left_semi")
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, on(repeated), "left_anti")
    one = kept.join(repeated, on(repeated), "left_semi").dropDuplicates([id_col, mark])
    return once.unionByName(one).select(docs.columns)
