"""SimHash document fingerprints in DataFrame functions only.

Every word of a text (lower-cased, weight: how often it stands there) votes
with the 64 bits of its XXH64 hash; a fingerprint bit is 1 if more than half
of the votes are. The votes of two bits share one long (32 bits apart, so a
text may hold 4 billion words), and the sums are ordinary hash aggregates
with map-side combine: one row per document is shuffled.

Permuted block tables find fingerprints within ``RADIUS`` bits: cut into
five blocks, two that differ in at most two bits agree in three blocks, so
each of the ten ways to choose three blocks is one table keyed by them.

Null and empty texts have fingerprint 0. The next document of a row is the
one with the next larger doc_id (after the largest: the smallest); of
several rows with that id, the one with the smallest text hash. A row without
doc_id stands outside the order and is followed by the smallest id, or by
itself if no row has an id. Equal rows get equal results, one row each. Very
long texts are split whole into words; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybars.llm.common import materialize
from daybars.llm.components import bits, connected_components, hamming_links

RADIUS = 2
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
HOT = 256
_LANES = (1 << 32) | 1


def terms(text: Column) -> Column:
    return F.split(F.lower(text), r"[\x09-\x0D\x20]+")


def votes(h: Column) -> list[Column]:
    """32 sums; sum j holds the votes of bits j (low half) and j + 32."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES))).alias(f"v{j}") for j in range(32)]


def majority(n: str = "n") -> Column:
    """The fingerprint of the summed votes of ``n`` terms."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for count, bit in ((low, j), (high, j + 32)):
            out = out.bitwiseOR(F.when(count * 2 > F.col(n), F.lit(bits(bit, 1))).otherwise(F.lit(0)))
    return out


def fingerprint(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, copies, fp): the fingerprint of the one text of each key.

    Rows with equal keys must hold equal texts; they share one row, and
    ``copies`` says how many they are.
    """
    rows = texts.select(*keys, F.posexplode(terms(F.coalesce(text_col, F.lit("")))).alias("pos", "raw"))
    rows = rows.select(*keys, "pos", F.when(F.col("raw") != "", F.xxhash64("raw")).alias("h64"))
    sums = rows.groupBy(*keys).agg(F.count("h64").alias("n"), F.count_if(F.col("pos") == 0).alias("copies"),
                                   *votes(F.col("h64")))
    return sums.select(*keys, "copies", F.coalesce(majority(), F.lit(0).cast("long")).alias("fp"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids: the next larger, after the last the first.

    The ids alone are dealt out by range and written; then each range is a
    window of its own, and the first ids of the ranges (one row each) close
    the gaps.
    """
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(ids.where("doc_id IS NOT NULL").select("doc_id").repartitionByRange(n, "doc_id")
                        .withColumn("part", F.spark_partition_id()), "ordered-ids")
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("head"))
    every = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.min("head").over(
        Window.partitionBy())).alias("after"))
    inside = dealt.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    return inside.join(F.broadcast(heads), "part").select(      # one row per shuffle partition
        "doc_id", F.coalesce("next_id", "after").alias("next_id"))


def block_keys(fp: Column) -> Column:
    """The ten table keys: three of the five blocks each."""
    keys = []
    for number, chosen in enumerate(combinations(BLOCKS, 3)):
        mask = 0
        for block in chosen:
            mask |= bits(*block)
        keys.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def groups(fps: DataFrame) -> DataFrame:
    """(fp, root): fingerprints linked within RADIUS bits, by smallest member."""
    keys = block_keys(F.col("fp"))
    links = hamming_links(fps.select("fp").distinct(), keys, keys, RADIUS, HOT)
    return connected_components(links).select(F.col("node").alias("fp"), "root")


def with_edited(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, edited) per row, and (doc_id, next_id) per id.

    Texts are shuffled once, by id; only the wanted openings of the next
    documents are shuffled again.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lengths = materialize(d.select("doc_id", F.floor(F.char_length("text") / 4).cast("int").alias("need"))
                          .groupBy("doc_id").agg(F.max("need").alias("need"), F.count("*").alias("n")), "lengths")
    least = lengths.agg(F.min("doc_id")).first()[0]
    void = lengths.where("doc_id IS NULL").select("doc_id", F.lit(least).cast(lengths.schema["doc_id"].dataType).alias("next_id"))
    follow = materialize(next_ids(lengths).unionByName(void), "follow")
    want = follow.withColumnRenamed("doc_id", "prev_id").join(
        lengths, F.col("prev_id").eqNullSafe(F.col("doc_id"))).select("prev_id", F.col("next_id").alias("want_id"), "need")
    opening = d.join(want, F.col("doc_id").eqNullSafe(F.col("want_id"))).select(
        "prev_id", F.xxhash64("text").alias("h"), F.expr("left(text, need)").alias("opening"))
    if not lengths.where("n > 1").isEmpty():
        opening = opening.groupBy("prev_id").agg(F.min(F.struct("h", "opening")).alias("m")).select("prev_id", "m.opening")
    cut = F.floor(F.char_length("text") / 4).cast("int")
    both = d.join(opening.select("prev_id", "opening"), F.col("doc_id").eqNullSafe(F.col("prev_id")))
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - cut), F.left("opening", cut))
    return both.select("doc_id", "text", edited.alias("edited")), follow


def report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form; see the module."""
    both, follow = with_edited(docs)
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                    F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    keys = ["doc_id", "h", "n_chars", "edited_sha256"]
    bodies = both.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n_chars"),
                         F.sha2("edited", 256).alias("edited_sha256"), F.inline(kinds))
    fps = fingerprint(bodies, [*keys, "kind"], "body")
    fps = materialize(fps.groupBy(*keys, "copies").agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp")), "fingerprints")
    ahead = fps.groupBy(F.col("doc_id").alias("next_id")).agg(F.min(F.struct("h", "fp")).alias("first")).select(
        "next_id", F.col("first.fp").alias("next_fp"))
    ahead = follow.join(ahead, follow.next_id.eqNullSafe(ahead.next_id)).select(F.col("doc_id").alias("prev_id"), "next_fp")
    heads = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = heads.join(groups(heads), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = named.join(named.groupBy("root").agg(F.min("least").alias("near_group")), "root").select("fp", "near_group")
    rows = fps.join(ahead, F.col("doc_id").eqNullSafe(F.col("prev_id"))).join(named, "fp")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))

    def alike(a: str, b: str) -> Column:
        return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64.0
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.lpad(F.lower(F.hex("edited_fp")), 16, "0").alias("edited_fingerprint"),
        alike("fp", "edited_fp").alias("near_edited"), alike("fp", "next_fp").alias("near_next"), "near_group")
