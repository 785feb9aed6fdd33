"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating;
   they share 100 % of all words, no target exceeds ``MAX_REPEAT`` times its
   source, the excess goes to the others by weight (water filling in closed
   form).
2. Sources get blocks of ``BLOCK`` words by highest quotients; each source's
   blocks are apportioned again to its shards. The highest-quotient result is
   reached from the rounded shares by adding or taking the few blocks that
   rounding left over, so no row per block is made.
3. Inside a shard the documents stand in seeded order and are cut into
   blocks; the quota takes whole passes over the shard and then its first
   blocks. A document may be taken in part, and at most MAX_REPEAT times.

A source is split into shards of about ``SHARD_DOCS`` documents, so a hot
source never meets in one task. The tables with one row per source or shard
are windows over that many rows.

Null texts have size 0. The draw is by id and text, so rows without doc_id spread
over the shards like any other; ties are broken by all columns, so only rows that
are equal in every one may swap their ``taken``, and reruns agree. Copies of one
row share a shard: that many rows, of a few numbers each, meet in its window.
Very long texts are read once, for their size. If no text has a word, every
target is 0. Columns of ``docs`` named like an added one are replaced. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybars.llm.common import materialize

BLOCK = 16
SHARD_DOCS = 2_000
MAX_REPEAT = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "taken")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, cycle: int = 3, cap: int = MAX_REPEAT) -> DataFrame:
    """Of (source, source_size, n_docs): the same with weight and target."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    s = (sources.withColumn("weight", F.pmod(F.row_number().over(order) - 1, F.lit(cycle)).cast("long") + 1)
         .withColumn("most", F.col("source_size") * cap)
         .withColumn("total", F.sum("source_size").over(every)))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumn("place", F.row_number().over(full))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("rate", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0)))
                     / F.sum("weight").over(after))
    open_ = F.when(F.col("most") >= F.col("weight") * F.col("rate"), F.struct("place", "rate"))
    s = s.withColumn("level", F.min(open_).over(every)["rate"])
    return s.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.col("level"))).select(
        "source", "source_size", "n_docs", "weight", "target", "total")


def sainte_lague(rows: DataFrame, group: list[str], key: list[str], weight: str, seats: Column, out: str) -> DataFrame:
    """Add ``out``: the seats of each row, by highest quotients w / (2k + 1).

    Within a group the seats of its rows add up to ``seats``, a column that is
    the same for all rows of the group (0 if all weights are 0). Ties go by
    ``key``.
    """
    g = Window.partitionBy(*group)
    r = (rows.withColumn("_w", F.col(weight).cast("double")).withColumn("_all", F.sum("_w").over(g))
         .withColumn("_seats", F.when(F.col("_all") > 0, seats).otherwise(F.lit(0)).cast("long"))
         .withColumn("_s", F.when(F.col("_all") > 0, F.floor(F.col("_w") * F.col("_seats") / F.col("_all") + 0.5))
                     .otherwise(F.lit(0)).cast("long"))
         .withColumn("_n", F.count(F.lit(1)).over(g))
         .withColumn("_off", F.col("_seats") - F.sum("_s").over(g)))
    # a row gains or loses at most its share of what is left over, and one
    most = F.when(F.col("_off") == 0, 0).otherwise(
        F.ceil(F.col("_w") / F.col("_all") * (F.abs("_off") + F.col("_n"))) + 1)
    most = F.when(F.col("_off") < 0, F.least(most, F.col("_s"))).otherwise(most).cast("int")
    step = F.explode_outer(F.when(most > 0, F.sequence(F.lit(0), most - 1)))
    c = r.select("*", step.alias("_k"))
    # of equal quotients the first key keeps its seat, the last one loses it
    gain = F.col("_w") / (2 * (F.col("_s") + F.col("_k")) + 1)
    loss = F.col("_w") / (2 * (F.col("_s") - F.col("_k")) - 1)
    gained = F.row_number().over(Window.partitionBy(*group).orderBy(
        gain.desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key], "_k"))
    lost = F.row_number().over(Window.partitionBy(*group).orderBy(
        loss.asc_nulls_last(), *[F.col(k).desc_nulls_first() for k in key], "_k"))
    rank = F.when(F.col("_off") > 0, gained).otherwise(lost)
    c = c.withColumn("_hit", (F.col("_k").isNotNull() & (rank <= F.abs("_off"))).cast("long"))
    change = c.groupBy(*rows.columns, "_s", "_off").agg(F.sum("_hit").alias("_hits"))
    return change.select(*rows.columns, (F.col("_s") + F.signum("_off").cast("long") * F.col("_hits")).alias(out))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
        block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and taken."""
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    draw = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"),
                          F.coalesce(F.md5(text_col), F.lit(""))))
    d = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(source_col).alias("source"),
                    n_words(F.col(text_col)).alias("size"), draw.alias("draw"),
                    F.xxhash64(*keep).alias("tie"))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(sizes)
    blocks = F.floor(F.col("total") / block + 0.5)
    quotas = materialize(sainte_lague(targets, [], ["source"], "target", blocks, "blocks").withColumn(
        "shards", F.ceil(F.col("n_docs") / shard_docs).cast("long")), "mix-sources")
    shard = F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.col("shards"))
    q = quotas.withColumnRenamed("source", "q_source")
    d = d.join(q, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source").withColumn("shard", shard)
    shards = d.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("words"))
    shards = sainte_lague(shards, ["source"], ["shard"], "words", F.col("blocks"), "quota")
    shards = materialize(shards.select(
        F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "words",
        F.least(F.col("quota") * block, F.col("words") * MAX_REPEAT).alias("want")), "mix-shards")
    d = d.join(shards, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("shard") == F.col("s_shard")))
    line = Window.partitionBy("source", "shard").orderBy("draw", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(line), F.lit(0))
    passes = F.when(F.col("words") > 0, F.floor(F.col("want") / F.col("words"))).otherwise(F.lit(0))
    rest = F.col("want") - passes * F.col("words")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return d.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)],
                    "size", "source_size", "target", taken.cast("long").alias("taken"))
