"""Language identification: sparse logistic regression on character n-grams.

Texts are lower-cased, everything but letters becomes one blank, and the
1- to 3-grams are hashed to ``DIMS`` features weighted by TF-IDF and scaled to
length one. Document frequencies come from all training documents. The
weights are trained by follow-the-regularised-leader with elastic-net
penalties on a bounded sample (``SAMPLE`` documents over all languages, drawn
by a hash of the id), one fifth of which only sets the temperature that
calibrates the scores. Prediction runs in Arrow batches over whole texts.

Training uses documents that have an id, a language and a letter. A null
text, or one without a letter, is ``und`` with score 0. Without any training
document every text is ``und``; with one language, that one. Repeated rows
get the same prediction; the language of a row never enters its own. Very long
texts are counted whole, piece by piece. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 16
SAMPLE = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
UNKNOWN = "und"
_CHUNK = 1 << 20
# odd multipliers of the n-gram hash, one per place
_MULT = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """A letter's own code point, a blank for all else."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Feature numbers and their counts; None without a letter."""
    if not text:
        return None
    lowered, total, any_letter = text.lower(), np.zeros(DIMS, np.float32), False
    for at in range(0, len(lowered), _CHUNK):      # pieces overlap by two characters
        c = _letters()[np.frombuffer(lowered[max(0, at - 2):at + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
        any_letter = any_letter or bool((c != 32).any())
        for n in (1, 2, 3):
            skip = max(0, min(at, 2) - (n - 1))    # n-grams that end in the piece before
            h = np.zeros(max(0, len(c) - n + 1), np.uint32)
            for k in range(n):
                h += c[k:len(c) - n + 1 + k] * _MULT[k]
            h = ((h + np.uint32(n)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
            total += np.bincount(h[skip:], minlength=DIMS).astype(np.float32)
    if not any_letter:
        return None
    ids = np.flatnonzero(total)
    return ids, total[ids]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray          # DIMS x languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return scaled(ids, counts, self.idf) @ self.weights[ids] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = features(text)
        if found is None or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*found) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def scaled(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf[ids]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial FTRL-proximal; the last feature is the bias."""
    z = np.zeros((DIMS + 1, n_langs), np.float64)
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)
    for _ in range(EPOCHS):
        for ids, counts, lang in rows:
            at = np.append(ids, DIMS)
            x = np.append(scaled(ids, counts, idf), 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[lang] -= 1.0
            g = x[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:DIMS].astype(np.float32), w[DIMS].astype(np.float32)


def best_temperature(logits: np.ndarray, langs: np.ndarray) -> float:
    """Least negative log likelihood over a grid from 1/32 to 4."""
    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), langs]).mean())
    return min((2.0 ** (k / 8) for k in range(-40, 17)), key=loss) if len(logits) else 1.0


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents with a letter, and how many of them hold each feature."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                found = features(t.as_py())
                if found is not None:
                    df[found[0]] += 1
                    df[DIMS] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], schema=schema)
    rows = texts.mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIMS + 1, np.int64)
    df[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return int(df[DIMS]), df[:DIMS]


def _sample(train: DataFrame, langs: dict[str, int], size: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features of about size / languages documents each, drawn by id hash."""
    each = max(1, size // len(langs))
    share = F.create_map(*[F.lit(x) for k, n in langs.items() for x in (k, min(1_000_000, -(-each * 1_000_000 // n)))])
    draw = F.xxhash64(F.lit("langid"), "doc_id", "text")
    picked = train.withColumn("draw", draw).where(F.pmod("draw", F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")))
    schema = pa.schema([("draw", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, lang, t in zip(b.column("draw"), b.column("lang"), b.column("text"), strict=True):
                found = features(t.as_py())
                if found is not None:
                    rows.append({"draw": d.as_py(), "lang": lang.as_py(), "ids": found[0].astype(np.uint16).tobytes(),
                                 "counts": found[1].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema)
    table = picked.select("draw", "lang", "text").mapInArrow(
        encode, "draw long, lang string, ids binary, counts binary").toArrow().to_pylist()
    number = {k: i for i, k in enumerate(sorted(langs))}
    table.sort(key=lambda r: (r["draw"], r["lang"], r["ids"]))
    return [(np.frombuffer(r["ids"], np.uint16).astype(np.int64), np.frombuffer(r["counts"], np.float32),
             number[r["lang"]]) for r in table]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From columns doc_id, text, lang; the caller decides which rows may teach."""
    usable = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    langs = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    n, df = _frequencies(usable.select("text"))
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 1
    rows = _sample(usable, langs, sample) if langs else []
    if not rows:
        return Model([], idf, np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))
    teach, tune = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    model = Model(sorted(langs), idf, *ftrl(teach or rows, len(langs), idf))
    if teach:
        model.temperature = best_temperature(
            np.array([model.logits(i, c) for i, c, _ in tune]), np.array([k for _, _, k in tune]))
    return model


def predictor(model: Broadcast, text: Column) -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.value.predict(t) for t in texts], columns=["lang_pred", "score"])
    return run.asNondeterministic()(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", "lang")
    model = d.sparkSession.sparkContext.broadcast(train(d.where(~held_out(F.col("doc_id")))))
    out = d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
