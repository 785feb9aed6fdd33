"""Connected components and Hamming links over 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybars.llm.common import materialize

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge.

    Alternating large-star and small-star rounds; each round is two
    aggregations with map-side combine, and its edges are written to the
    shared folder, so a lost executor never replays earlier rounds. Ends when
    a round changes nothing. Self loops and repeated edges are allowed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc")
    before = _digest(e)
    for _ in range(MAX_ROUNDS):
        e = materialize(_small_star(_large_star(e)), "cc")
        now = _digest(e)
        if now == before:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        before = now
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    linked = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def bits(offset: int, width: int) -> int:
    """Mask of ``width`` bits from ``offset``, going round at 64, as a signed long."""
    mask = sum(1 << ((offset + k) % 64) for k in range(width))
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def flips(fp: Column, most: int) -> Column:
    """Every value at most ``most`` (0-2) bits away from ``fp``."""
    masks = [0] + [bits(i, 1) for i in range(64)] * (most > 0)
    if most > 1:
        masks += [bits(i, 1) ^ bits(j, 1) for i, j in combinations(range(64), 2)]
    return F.transform(F.array(*map(F.lit, masks)), lambda m: fp.bitwiseXOR(m))


def hamming_links(fps: DataFrame, probes: Column, index: Column, radius: int, hot: int,
                  keep: Column | None = None) -> DataFrame:
    """Links (a, b) that connect all fingerprints at most ``radius`` bits apart.

    fps       distinct ``fp`` (long)
    probes    array of the keys under which a fingerprint looks for others
    index     array of the keys under which it is found; any two fingerprints
              within the radius must meet in at least one key
    keep      filter on columns ``fp`` and ``other`` before the bit count
    hot       a key found by more fingerprints than this is not joined pair by
              pair. Everything that meets such a key goes to a second, linear
              path instead: fingerprints at most radius/2 flips away from a
              common value are within the radius of each other, and at most
              2,081 values are that near, so a star per value links them all
              and no group can grow.

    Every link is real; a pair may be linked through others in a hot group, so
    the links have the same components as all pairs, which is what callers use.
    """
    if radius not in (2, 4):
        raise ValueError("radius must be 2 or 4")
    found = fps.select("fp", F.explode(index).alias("key"))
    sought = fps.select("fp", F.explode(probes).alias("key"))
    crowded = materialize(found.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-keys")
    some_hot = not crowded.isEmpty()
    if some_hot:
        found_cold = found.join(crowded, "key", "left_anti")
        sought_cold = sought.join(crowded, "key", "left_anti")
    else:
        found_cold, sought_cold = found, sought
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    cond = (F.col("fp") < F.col("other")) & (near if keep is None else keep & near)
    links = (sought_cold.join(found_cold.select(F.col("fp").alias("other"), "key"), "key").where(cond)
             .select(F.col("fp").alias("a"), F.col("other").alias("b")))
    if some_hot:
        members = found.unionByName(sought).join(crowded, "key", "left_semi").select("fp").distinct()
        values = members.select("fp", F.explode(flips(F.col("fp"), radius // 2)).alias("value"))
        first = values.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        stars = values.join(first, "value").where("fp <> a").select("a", F.col("fp").alias("b"))
        links = links.unionByName(stars)
    return links.distinct()
