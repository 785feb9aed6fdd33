"""Personal data found by candidate gradient boosting, in DataFrame functions.

1. Strict patterns (email, ip, card, phone) with their validity checks give
   the base spans.
2. High-recall generators propose overlapping candidates: any run around an
   "@", any longer run of digits with separators, anything shaped like a
   phone number, and anything shaped like a card number. They also see what
   the strict patterns lose, such as a phone number with a card behind it.
3. A candidate's format and context become a few small integers. Candidates
   are counted by feature vector over the whole corpus (the number of vectors
   is bounded by the product of the feature ranges, ``MAX_VECTORS``), labelled
   by whether a base span lies in them, and boosted trees are fitted to those
   weighted vectors.
4. Scores are calibrated by isotonic regression on the fold left out of
   training. A generator's threshold is the least score whose calibrated
   share of validated candidates, (right + PRIOR[0]) / (all + sum(PRIOR)), is at
   least ``PRECISION``: a few candidates that are all right prove as much as
   many, and one that is wrong counts the more the fewer there are. Candidates
   above it that meet no base span become spans of the generator's kind;
   without such a threshold none do.

As "right" means that a base span lies in a candidate, kinds that no base
pattern validates (account numbers, local phone numbers) are proposed but hardly
ever selected.

Patterns start only at the edge of a run (or where the last match ended) and
use possessive or bounded quantifiers. Places are running sums, overlaps running
extremes (``_scan``), and texts are put together from blocks, so a text of n
characters and m matches costs about n + m log m: very long texts and lists of
contacts are processed whole. Null and empty texts have no spans and stay as they
are; repeated rows are each scanned; an empty corpus fits no trees; columns of the
input that have our names stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybars.llm.common import fresh, materialize

# The base patterns, made linear by run edges and possession.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "contact", "number", "phone_like", "card_like")
N_BASE = 4
# generators, in the order of the kinds after the base ones
GENERATORS = (
    r"(?<![^\s@])[^\s@]++@[^\s@]++",
    r"(?<![0-9A-Za-z])[+(]{0,2}+[0-9](?:[\x20()./+-]{0,3}+[0-9]){6,}+(?![0-9A-Za-z])",
    r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{1,4}\)?(?:[\x20.-]?[0-9]{2,4}){1,4}(?![0-9])",
    r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])")
CONTEXT = (r"(?i)(phone|tel|call|fax|mobile|cell)", r"(?i)(card|visa|amex|credit|debit)",
           r"(?i)(ssn|iban|account|passport|licen[cs]e)", r"(?i)(\bip\b|host|server|addr)", r"(?i)(mail|contact)")
BEFORE = 24
FEATURES = {"generator": len(GENERATORS), "digits": 5, "gaps": 4, "plus": 2, "dots": 4, "luhn": 2, "before": 6, "domain": 2}
MAX_VECTORS = math.prod(FEATURES.values())
ROUNDS, RATE, PRECISION = 20, 0.3, 0.95
#: Candidates that a calibrated share counts as seen before: right, wrong.
PRIOR = (1.0, 0.05)
BLOCK = 1_024           # characters
SPANS = "array<struct<kind:int,start:int,end:int>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running ``op`` over an array, by doubling: log n passes over it."""
    steps = F.when(F.size(values) > 1, F.transform(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1),
        lambda k: F.pow(F.lit(2), k).cast("int"))).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.aggregate(steps, values, lambda acc, step: F.transform(
        acc, lambda x, i: F.when(i >= step, op(F.get(acc, i - step), x)).otherwise(x)))


def _matches(text: Column, pattern: str, guard: Column) -> Column:
    """array<struct<start, body, before>> of all leftmost non-overlapping
    matches; ``before`` ends the text between a match and the one before it.

    ``split`` with no limit gives the text between matches, so a match
    ends after all gaps and matches up to it.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda gap, body: F.struct((F.char_length(gap) + F.char_length(body)).alias("size"), body.alias("body"),
                                                  F.right(gap, F.lit(BEFORE)).alias("before")))
    whole = F.filter(pairs, lambda p: p["body"].isNotNull())
    found = _let(whole, lambda p: F.zip_with(p, _scan(F.transform(p, lambda x: x["size"]), lambda a, b: a + b), lambda m, end: F.struct(
        (end - F.char_length(m["body"])).alias("start"), m["body"].alias("body"), m["before"].alias("before"))))
    return F.when(guard, found).otherwise(F.expr("cast(array() AS array<struct<start:int,body:string,before:string>>)"))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _luhn(body: Column) -> Column:
    value = F.transform(F.split(F.reverse(_digits(body)), ""), lambda c, i: F.when(
        i % 2 == 0, F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(c.try_cast("int"), F.lit(0)) + 1)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def _octets(body: Column) -> Column:
    return F.forall(F.split(body, r"\."), lambda p: F.coalesce(
        F.when(F.char_length(F.ltrim(p, F.lit("0"))) <= 3, F.ltrim(p, F.lit("0")).try_cast("int") <= 255).otherwise(F.lit(False)),
        F.ltrim(p, F.lit("0")) == ""))


def _valid(kind: int, body: Column) -> Column:
    n = F.char_length(_digits(body))
    return (F.lit(True), _octets(body), n.between(13, 19) & _luhn(body), n.between(9, 15))[kind]


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(F.filter(matches, lambda m: _valid(kind, m["body"])), lambda m: F.struct(
        F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.char_length(m["body"])).alias("end")))


def _features(m: Column, generator: int) -> Column:
    body, before = m["body"], m["before"]
    n = F.char_length(_digits(body))
    context = F.lit(0)
    for k, pattern in reversed(list(enumerate(CONTEXT, 1))):
        context = F.when(before.rlike(pattern), k).otherwise(context)
    gaps = F.char_length(F.regexp_replace(body, r"[^\x20()./+-]", ""))
    dots = F.char_length(F.regexp_replace(body, r"[^.]", ""))
    return F.struct(
        F.lit(generator).alias("generator"),
        F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4).alias("digits"),
        F.when(gaps == 0, 0).when(gaps < 3, 1).when(gaps < 5, 2).otherwise(3).alias("gaps"),
        body.startswith("+").cast("int").alias("plus"), F.least(dots, F.lit(3)).alias("dots"),
        (n.between(13, 19) & _luhn(body)).cast("int").alias("luhn"), context.alias("before"),
        body.rlike(r"@[^@]*[A-Za-z0-9]\.[A-Za-z]{2,}").cast("int").alias("domain"))


def _with_hits(base: Column, proposed: Column) -> Column:
    """array<struct<start, end, f, hit>>: the proposed candidates by start, and
    whether each meets a base span.

    In order of start, a candidate meets a base span if one that starts no later
    ends after its start, or one that starts later does so before its end.
    """
    far = F.lit(2_147_483_647)
    none = F.transform(F.slice(proposed, 1, 0), lambda c: c["f"])
    both = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("proposed"), s["end"].alias("end"),
                                             F.get(none, F.lit(0)).alias("f"))),
        F.transform(proposed, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("proposed"), c["end"].alias("end"),
                                                 c["f"].alias("f")))))

    def mark(s: Column) -> Column:
        is_base = [F.transform(s, lambda x: F.when(x["proposed"] == 0, x["end"]).otherwise(F.lit(-1))),
                   F.reverse(F.transform(s, lambda x: F.when(x["proposed"] == 0, x["start"]).otherwise(far)))]
        ends = _let(is_base[0], lambda v: _scan(v, F.greatest))
        starts = F.reverse(_let(is_base[1], lambda v: _scan(v, F.least)))
        near = F.zip_with(ends, starts, lambda e, b: F.struct(e.alias("end"), b.alias("start")))
        return F.filter(F.zip_with(s, near, lambda x, n: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["f"].alias("f"),
            ((n["end"] > x["start"]) | (n["start"] < x["end"])).alias("hit"))), lambda x: x["f"].isNotNull())
    return _let(both, mark)


def candidates(docs: DataFrame, text_col: str = "text", base: str = "base", out: str = "candidates") -> DataFrame:
    """``docs`` with the base spans and the generators' candidates."""
    text = F.col(text_col)
    has = {"@": F.coalesce(F.instr(text, "@") > 0, F.lit(False)), "+": F.coalesce(F.instr(text, "+") > 0, F.lit(False)),
           "9": F.coalesce(text.rlike("[0-9]"), F.lit(False))}
    patterns = [*zip((EMAIL, IP, CARD, PHONE), "@99+", strict=True),
                *zip(GENERATORS, "@9+9", strict=True)]
    raw = [fresh(docs, f"_raw{k}") for k in range(len(patterns))]
    for name, (pattern, need) in zip(raw, patterns, strict=True):
        docs = docs.withColumn(name, _matches(text, pattern, has[need]))
    docs = docs.withColumn(base, F.concat(*[_spans(F.col(raw[k]), k) for k in range(N_BASE)]))

    def one(column: str, generator: int) -> Column:
        return F.transform(F.col(column), lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + F.char_length(m["body"])).alias("end"),
            _features(m, generator).alias("f")))
    proposed = F.concat(*[one(c, g) for g, c in enumerate(raw[N_BASE:])])
    return docs.withColumn(out, _let(proposed, lambda c: _with_hits(F.col(base), c))).drop(*raw)


@dataclass
class Model:
    """Additive stumps of two levels; a leaf is (conditions, value)."""
    leaves: list[tuple[tuple[tuple[str, int, bool], ...], float]]
    thresholds: dict[int, float]      # by generator; none: select nothing

    def score(self, f: Column) -> Column:
        total = F.lit(0.0)
        for conditions, value in self.leaves:
            hold = F.lit(True)
            for name, cut, above in conditions:
                hold &= (f[name] > cut) if above else (f[name] <= cut)
            total += F.when(hold, F.lit(value)).otherwise(F.lit(0.0))
        return total

    def selects(self, c: Column) -> Column:
        chosen = F.lit(False)
        for generator, least in self.thresholds.items():
            chosen |= (c["f"]["generator"] == generator) & (self.score(c["f"]) >= least)
        return chosen


def fit(found: DataFrame, column: str = "candidates") -> Model:
    """Boosted trees on the counts of all candidates, by feature vector.

    ``found`` needs the candidates and ``fold`` (0: left out of training).
    """
    c = found.where(F.size(column) > 0).select("fold", F.explode(column).alias("c")).select(
        "c.f.*", "c.hit", (F.col("fold") == 0).alias("held"))
    rows = c.groupBy(*FEATURES).agg(*[
        F.count_if((F.col("held") == held) & (F.col("hit") == hit)).alias(f"{held}{hit}")
        for held in (False, True) for hit in (False, True)]).collect()      # at most MAX_VECTORS rows
    vectors = [{k: r[k] for k in FEATURES} for r in rows]
    pos, neg = [r["FalseTrue"] for r in rows], [r["FalseFalse"] for r in rows]
    leaves, scores = boost(vectors, pos, neg)
    limits = {}
    for g in range(len(GENERATORS)):
        least = threshold([(s, r["TrueTrue"], r["TrueFalse"]) for s, v, r in zip(scores, vectors, rows, strict=True)
                           if v["generator"] == g])
        if least is not None:
            limits[g] = least
    return Model(leaves, limits)


def threshold(held: list[tuple[float, int, int]]) -> float | None:
    """Least score that isotonic regression gives PRECISION, of (score,
    right, wrong)."""
    pools: list[list[float]] = []            # falling scores: least score, right, wrong
    for s, right, wrong in sorted(held, reverse=True):
        if not right + wrong:
            continue
        pools.append([s, right, wrong])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or _share(pools[-2]) <= _share(pools[-1])):
            s, right, wrong = pools.pop()
            pools[-1] = [s, pools[-1][1] + right, pools[-1][2] + wrong]
    good = [p[0] for p in pools if _share(p, *PRIOR) >= PRECISION]
    return min(good, default=None)


def _share(pool: list[float], right: float = 0.0, wrong: float = 0.0) -> float:
    return (pool[1] + right) / (pool[1] + pool[2] + right + wrong)


def boost(vectors: list[dict], pos: list[int], neg: list[int]) -> tuple[list, list[float]]:
    """Newton boosting of two-level trees on weighted 0/1 outcomes."""
    n, scores, leaves = len(vectors), [0.0] * len(vectors), []
    if not sum(pos) or not sum(neg):
        return leaves, scores
    cuts = [(name, cut) for name, size in FEATURES.items() for cut in range(size - 1)]

    def gain(rows: list[int], g: list[float], h: list[float]) -> float:
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1.0)
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [a - (a + b) * q for a, b, q in zip(pos, neg, p, strict=True)]
        h = [(a + b) * q * (1 - q) for a, b, q in zip(pos, neg, p, strict=True)]
        tree = [((), list(range(n)))]
        for _ in range(2):
            grown = []
            for conditions, rows in tree:
                best = max(cuts, key=lambda c: gain([i for i in rows if vectors[i][c[0]] <= c[1]], g, h)  # noqa: B023
                           + gain([i for i in rows if vectors[i][c[0]] > c[1]], g, h))  # noqa: B023
                for above in (False, True):
                    part = [i for i in rows if (vectors[i][best[0]] > best[1]) == above]
                    if part:
                        grown.append(((*conditions, (*best, above)), part))
            tree = grown
        for conditions, rows in tree:
            value = RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + 1.0)
            leaves.append((conditions, value))
            for i in rows:
                scores[i] += value
    return leaves, scores


def spans(model: Model, base: str = "base", column: str = "candidates") -> Column:
    """Base spans and selected candidates that meet none, by kind and start."""
    if not model.thresholds:
        return F.col(base)
    extra = F.transform(F.filter(column, lambda c: model.selects(c) & ~c["hit"]), lambda c: F.struct(
        (c["f"]["generator"] + N_BASE).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.concat(F.col(base), F.array_sort(extra))


def listed(s: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"),
                                                             x["end"].cast("string"))), ",")


def _is(kind: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(4))


def report(docs: DataFrame) -> DataFrame:
    found = candidates(docs.select("doc_id", "text", _fold().alias("fold")))
    found = materialize(found.select("doc_id", "fold", "base", "candidates"), "pii")
    model = fit(found)
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(N_BASE)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(spans(model)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the kind of the first. Texts
    without spans are untouched; ``n_chars`` is set anew where a text changed.
    """
    base, cand, place = (fresh(docs, c) for c in ("_base", "_candidates", "_spans"))
    found = materialize(candidates(docs, text_col, base, cand), "pii-found")
    model = fit(found.select(F.col(cand).alias("candidates"), _fold().alias("fold")))
    order = F.array_sort(F.transform(spans(model, base, cand), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = found.withColumn(place, order)
    text, new = F.col(text_col), fresh(docs, "_text")
    out = marked.withColumn(new, F.when(F.size(place) > 0, _replaced(text, F.col(place))).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.size(place) > 0, F.char_length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def _replaced(text: Column, place: Column) -> Column:
    """``text`` with the spans of ``place``, sorted by start, replaced by kinds."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(blocks: Column, a: Column, b: Column | None) -> Column:
        """Characters a to b (None: the end), from the blocks that hold them."""
        first = F.floor(a / BLOCK).cast("int")
        if b is None:
            return F.substring(F.array_join(F.slice(blocks, first + 1, F.size(blocks)), ""), a - first * BLOCK + 1,
                               F.lit(2_147_483_647))
        n = F.floor((b - 1) / BLOCK).cast("int") - first + 1
        return F.when(b <= a, F.lit("")).otherwise(
            F.substring(F.array_join(F.slice(blocks, first + 1, F.greatest(n, F.lit(0))), ""), a - first * BLOCK + 1, b - a))

    def build(blocks: Column) -> Column:
        def write(reach: Column) -> Column:         # how far the spans up to each go, after a 0
            pieces = F.zip_with(place, F.slice(reach, 1, F.size(place)), lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(
                F.concat(cut(blocks, at, s["start"]), F.element_at(names, s["kind"] + 1))))
            return F.concat(F.array_join(pieces, ""), cut(blocks, F.element_at(reach, -1), None))
        ends = _let(F.transform(place, lambda s: s["end"]), lambda v: _scan(v, F.greatest))
        return _let(F.concat(F.array(F.lit(0)), ends), write)
    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), build)
