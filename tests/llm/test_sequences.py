"""Periodic runs and fill-in-middle against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daybars.llm import fim, periodic
from tests.llm.conftest import ODD, texts_of

TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def by_text(rows):
    return sorted(rows, key=str)


# periodic runs

def plain_runs(w):
    """Runs by comparing every word with the one q further on, for every q."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)           # the smallest period comes first
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def run_row(doc_id, text):
    w = TOKEN.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    runs.sort(key=lambda r: (r[0], r[2]))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9), st.integers(1, 8))
@settings(max_examples=300, deadline=None)
def test_runs_of_sequences(w, root, times):
    w = w + (w[-root:] * times)
    a = np.array(w, np.int64)
    want = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    assert [tuple(map(int, r)) for r in periodic.runs_of(a)] == want if w else True
    # without cutting out rare words first: the trees alone
    assert w == [] or sorted(zip(*map(lambda x: x.tolist(), periodic.all_runs(a + 1)))) == sorted(want)


@given(st.lists(st.integers(1, 3), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_suffix_tree_and_extensions(w):
    s, n = w + [0], len(w)
    tree = periodic.SuffixTree(s)
    leaves, turns = tree.tour()
    assert leaves.tolist() == sorted(range(n + 1), key=lambda i: s[i:])
    flipped = [-x if x else -9 for x in s]
    assert tree.tour(descending=True)[0].tolist() == sorted(range(n + 1), key=lambda i: flipped[i:])
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n + 1)]
    got = periodic.CommonExtension(leaves, turns)(*(np.array(x) for x in zip(*pairs)))
    for (i, j), size in zip(pairs, got):
        assert s[i:i + size] == s[j:j + size] and (j + size > n or s[i + size] != s[j + size])


def test_run_rows(spark, odd_docs, small_docs):
    made = [(i, "x " * (i % 9) + "a b c " * (i % 7) + "y" * (i % 2)) for i in range(200)]
    for docs in (odd_docs.where("doc_id is null or doc_id <> 6"), small_docs, spark.createDataFrame(made, "doc_id long, text string")):
        got = by_text(map(tuple, periodic.report(docs).collect()))
        assert got == by_text(run_row(i, t) for i, t in texts_of(docs))


def test_very_long_text(spark):
    """A text of 120,000 words that repeats 1,000 of them, and one word repeated."""
    root = [f"w{i * i % 1009}" for i in range(1000)]
    docs = spark.createDataFrame([(1, " ".join(root * 120)), (2, "z " * 120_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic.report(docs).collect()}
    assert (got[1]["length"], got[1]["period"]) == (120_000, 1000) and got[1]["exponent_milli"] == 120_000
    assert (got[2]["n_runs"], got[2]["length"], got[2]["period"]) == (1, 120_000, 1)
    assert got[2]["collapsed_sha256"] == sha("z")


def test_collapse_keeps_columns(spark, odd_docs, no_docs):
    out = periodic.collapse(odd_docs.withColumn("runs", F.lit(1)))
    assert "runs" in out.columns and "runs_1" in out.columns
    text = spark.createDataFrame([("go home now " * 5,)], "text string")
    assert periodic.collapse(text).select("runs.collapsed").first()[0] == "go home now"
    assert periodic.report(no_docs).collect() == []


# fill-in-middle

def fim_row(doc_id, text):
    t = text or ""
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(u), "plain", None, None, sha(t), sha(t)
    if h[3] % 100 < 50:
        return doc_id, len(u), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)
    return doc_id, len(u), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)


LINES = [(i, t) for i, t in enumerate([
    "\n", "\n\n\n", "a", "a\n", "one\ntwo\nthree\n", "one\r\ntwo", "<P>", "x<M>\ny", "<p>\n<S", "é\n\U0001f600\n", " a\x0bb\x0cc\n",
    "a\n" * 70_000, "long " * 40_000 + "\nend", "\n" * 200_000])]


def test_fill_in_middle(spark, odd_docs, small_docs):
    made = spark.createDataFrame([(i + 20 * k, t) for k in range(4) for i, t in LINES], "doc_id long, text string")
    for docs in (made, odd_docs, small_docs):
        got = by_text(map(tuple, fim.report(docs).collect()))
        assert got == by_text(fim_row(i, t) for i, t in texts_of(docs))


@pytest.mark.parametrize("fim_percent,spm", [(0, 50), (100, 0), (100, 100), (50, 50)])
def test_texts_and_rates(small_docs, fim_percent, spm):
    got = {r["doc_id"]: r for r in fim.texts(small_docs, fim=fim_percent, spm=spm).collect()}
    digests = {r["doc_id"]: (r["form"], r["output_sha256"]) for r in fim.report(small_docs, fim=fim_percent, spm=spm).collect()}
    assert {i: (r["form"], sha(r["output"])) for i, r in got.items()} == digests
    forms = {r["form"] for r in got.values()}
    assert forms <= {0: {"plain"}, 100: {"spm", "psm", "plain"}, 50: {"plain", "spm", "psm"}}[fim_percent]
    if fim_percent == 100:
        assert ("psm" in forms) == (spm == 0) and ("spm" in forms) == (spm == 100)


def test_pieces_are_bounded_and_one_shuffle_serves_both_sorts(spark):
    text = ("word " * 30 + "\n") * 5_000 + "q" * 300_000
    cut = list(fim.pieces(5, 1, text))
    assert max(len(p) for (_, at), p in cut if at) <= fim.CHUNK and len(cut) > 15
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    lineage = fim.report(docs).rdd.toDebugString().decode()
    # the pieces are dealt once: only the first sort exchanges
    assert lineage.count("PairwiseRDD") == 1


def test_fill_in_middle_empty_table_and_extra_columns(odd_docs, no_docs):
    assert fim.report(no_docs).collect() == []
    docs = odd_docs.withColumn("row", F.lit(1)).withColumn("form", F.lit("x")).withColumn("n", F.lit(None))
    assert fim.report(docs).count() == len(ODD)
