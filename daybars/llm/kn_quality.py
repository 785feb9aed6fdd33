"""Quality classifier: interpolated modified Kneser-Ney over code points.

``kn_model`` counts n-grams of order 4 on trusted text (labelled good and not
toxic). Trusted text is left out of the model by units and two folds: a unit is a
document, or a part of one where a language has fewer than ``UNITS`` trusted
documents (ceil(UNITS / n) equal parts each). A unit is scored by the model of
the fold it is not in; documents that are not trusted by the model of all trusted
text. A document is kept if its log perplexity lies between two limits of its
language.

The limits of a language with n trusted documents are the quantiles (LOW and HIGH)
of its units with weight n / (n + PRIOR), and for the rest what all languages
show: below, the lesser of its own quantile and that of all units; above, the
greater of its own quantile and its median and the HIGH quantile of all deviations from their
language's median, widened by 1 + 1 / sqrt(n). So few trusted documents make
wide limits and many their own, without a step. Languages without any use the
quantiles over all units; null is a language of its own.

Defined results: without trusted text of two units there is no model and every
document is kept with null perplexity. Otherwise null and empty texts are
rejected. The perplexity of a document of several units is that of all its symbols.
Repeated rows get the same verdict; rows without id or with a null label train
nothing; very long texts are scored whole, piece by piece; an empty table gives
an empty result; columns of the input that have our names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybars.llm import kn_model
from daybars.llm.common import fresh, materialize, placed

LOW, HIGH, PRIOR, UNITS = 0.0005, 0.995, 100, 8
MAX_BROADCAST_IDS = 4_000_000   # 32 MB of trusted ids; beyond, a shuffled join
SALTS = 16


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic, as column ``id``."""
    ids = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias("id")).distinct()
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def units(trusted: DataFrame) -> DataFrame:
    """Trusted rows (doc_id, text, parts, ...) as their parts, with the number of
    each as ``part``; empty ones are no units."""
    size, parts = F.length("text"), F.col("parts")

    def cut(k: Column) -> Column:
        return F.floor(size * k / parts).cast("int")
    rows = trusted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    k = F.col("part")
    return rows.withColumn("text", F.substring(F.col("text"), cut(k) + 1, cut(k + 1) - cut(k))).where("text <> ''")


def fold_of(salt: int) -> Column:
    return F.pmod(kn_model.fold_of("doc_id", salt) + F.col("part"), F.lit(kn_model.FOLDS)).cast("int")


def limits_of(held: DataFrame, langs: DataFrame) -> tuple[DataFrame, list[float]]:
    """Limits of every language of ``held`` (lang, x: log perplexity of units), as
    (lang, low, high), and those of languages it does not have. ``langs`` has
    their numbers of trusted documents."""
    def q(*shares: float) -> Column:
        return F.percentile_approx("x", list(shares), 100_000)
    low, high = held.agg(q(LOW, HIGH)).first()[0]
    own = held.groupBy("lang").agg(q(LOW, 0.5, HIGH).alias("q"))
    own = materialize(own.join(langs.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l"))).select("lang", "n", "q"),
                      "kn-languages")
    median = own.select(F.col("lang").alias("l"), F.col("q")[1].alias("median"))
    off = held.join(median, F.col("lang").eqNullSafe(F.col("l"))).select((F.col("x") - F.col("median")).alias("x"))
    spread = off.agg(q(HIGH)).first()[0][0]
    w = F.col("n") / (F.col("n") + PRIOR)
    wide = F.col("q")[1] + F.lit(spread) * (1 + 1 / F.sqrt("n"))
    return own.select("lang", (w * F.col("q")[0] + (1 - w) * F.least(F.col("q")[0], F.lit(low))).alias("low"),
                      (w * F.col("q")[2] + (1 - w) * F.greatest(F.col("q")[2], wide)).alias("high")), [low, high]


def classify(docs: DataFrame, labels: DataFrame, ppl: str, keep: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` with perplexity and verdict."""
    docs, place = placed(docs)
    ids = trusted_ids(labels)
    trusted = docs.where("text <> ''").join(ids, F.col("doc_id") == F.col("id")).select(*place, "doc_id", "lang", "text")
    # one row per language; Spark broadcasts it while it is small
    langs = materialize(trusted.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")), "kn-trusted").withColumn(
        "parts", F.ceil(F.lit(float(UNITS)) / F.col("n")).cast("int"))
    named = langs.select(F.col("lang").alias("l"), "parts")
    parts = units(trusted.join(named, F.col("lang").eqNullSafe(F.col("l"))).drop("l"))
    folds = parts.agg(*[F.count_distinct(fold_of(k)).alias(str(k)) for k in range(SALTS)]).first()
    # a handful of units may all fall into one fold; then the next salt is taken
    salt = next((k for k in range(SALTS) if folds[k] > 1), None)
    if salt is None:
        return docs.select(columns).withColumn(ppl, F.lit(None).cast("double")).withColumn(keep, F.lit(True))
    parts = parts.withColumn("fold", fold_of(salt))
    tables = kn_model.levels(materialize(kn_model.count_grams(parts.select("text", "fold")), "kn-counts"))
    asked = kn_model.asked_of(docs, place)

    key, l, n, fold, held = (fresh(docs, c) for c in ("_id", "_l", "_n", "_fold", "_held"))
    marked = docs.join(ids.withColumnRenamed("id", key), F.col("doc_id") == F.col(key), "left").join(
        named.toDF(l, n), F.col(key).isNotNull() & F.col("lang").eqNullSafe(F.col(l)), "left")
    whole = F.col(n).isNull()
    marked = marked.withColumn(held, ~whole).withColumn(fold, F.when(whole, F.lit(kn_model.WHOLE)).otherwise(
        kn_model.fold_of("doc_id", salt)))
    one = marked.where(whole | (F.col(n) == 1) | ~F.coalesce(F.col("text") != "", F.lit(False)))
    out = materialize(kn_model.score(one, tables, ppl, fold, place, asked, [*columns, held]).select(*columns, ppl, held), "kn-scored")
    seen = out.where(F.col(held) & F.col(ppl).isNotNull()).select("lang", F.log(ppl).alias("x"))
    if not langs.where(F.col("parts") > 1).isEmpty():
        few = parts.where(F.col("parts") > 1).select("lang", "text", "fold", *[F.col(c).alias(f"{c}_of") for c in place])
        few, at = placed(materialize(few, "kn-few"))
        of = ["lang", *[f"{c}_of" for c in place], "size"]
        few = few.withColumn("size", F.length("text") + 1)
        few = materialize(kn_model.score(few, tables, "ppl", "fold", at, kn_model.asked_of(few, at), of).select(
            *of, F.log("ppl").alias("x")), "kn-parts")
        seen = seen.unionByName(few.select("lang", "x"))
        of = few.groupBy(*[F.col(f"{c}_of").alias(c) for c in place]).agg(
            F.exp(F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias(ppl))
        cut = marked.where((F.col(n) > 1) & (F.col("text") != ""))
        out = out.unionByName(cut.join(of, place).select(*columns, ppl, held))
    limits, other = limits_of(materialize(seen, "kn-seen"), langs)
    lang, low, high = (fresh(out, c) for c in ("_lang", "_low", "_high"))
    limits = materialize(limits.toDF(lang, low, high), "kn-limits")
    out = out.join(limits, F.col("lang").eqNullSafe(F.col(lang)), "left")
    good = F.log(ppl).between(F.coalesce(low, F.lit(other[0])), F.coalesce(high, F.lit(other[1])))
    return out.withColumn(keep, F.coalesce(good, F.lit(False))).drop(held, lang, low, high)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", "lang")
    return classify(d, labels, "perplexity", "keep", ["doc_id", "lang"])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    ppl, keep = fresh(docs, "_ppl"), fresh(docs, "_keep")
    return classify(docs, labels, ppl, keep, docs.columns).where(F.col(keep)).select(docs.columns)
