"""Fingerprints, Hamming links and components against brute force."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from daybars.llm import components, fingerprints, simhash_dedup
from tests.llm.conftest import ODD, texts_of

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLANK = " \t\n\x0b\x0c\r"
SIGNED = 1 << 64


def tokens(text):
    out, word = [], ""
    for c in (text or "").translate(UPPER) + " ":
        if c in BLANK:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def majority(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(text):
    w = tokens(text)
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    return majority([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles])


def roots(values, radius):
    """Smallest linked value of each, by walking all pairs."""
    values = sorted(set(values))
    root = {}
    for v in values:
        if v in root:
            continue
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = v
                todo += [y for y in values if y not in root and (x ^ y).bit_count() <= radius]
    return root


def components_of(texts):
    fps = [simhash(t) for _, t in texts]
    root = roots(fps, 4)
    least = {}
    for (d, _), f in zip(texts, fps, strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f"{f:016x}", least.get(root[f])) for (d, _), f in zip(texts, fps, strict=True)), key=str)


def test_near_duplicates(spark, odd_docs, small_docs):
    words = [f"w{i}" for i in range(400)]
    near = [(k, " ".join(words[:k * 7] + ["changed"] * (k % 3) + words[k * 7:])) for k in range(40)]
    made = spark.createDataFrame(near, "doc_id long, text string")
    for docs in (made, odd_docs.where("coalesce(doc_id, 0) <> 6"), small_docs):
        got = simhash_dedup.near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
        assert sorted(map(tuple, got.collect()), key=str) == components_of(texts_of(docs))


def test_drop_near_duplicates(odd_docs, no_docs, small_docs):
    wide = odd_docs.withColumn("_row_hash", F.lit(1)).withColumn("_keep_id", F.lit("x"))
    got = simhash_dedup.drop_near_duplicates(wide)
    assert got.columns == wide.columns
    texts = texts_of(odd_docs)
    fps = [simhash(t) for _, t in texts]
    root = roots(fps, 4)
    least = {root[f]: None for f in fps}
    for (d, _), f in zip(texts, fps, strict=True):
        if d is not None:
            least[root[f]] = d if least[root[f]] is None else min(d, least[root[f]])
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == sorted(least.values(), key=str)
    assert simhash_dedup.drop_near_duplicates(no_docs).collect() == []
    want = {c for _, _, c in components_of(texts_of(small_docs))}
    assert sorted(r["doc_id"] for r in simhash_dedup.drop_near_duplicates(small_docs).collect()) == sorted(want)


def test_long_text_is_hashed_whole():
    text = " ".join(f"t{i % 70_001}" for i in range(70_010))
    w = text.split()
    fast = simhash_dedup.simhash(text) % SIGNED
    ones = [0] * 64
    for i in range(len(w) - 3):
        h = xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    assert fast == sum(1 << b for b in range(64) if 2 * ones[b] > len(w) - 3)


def signed(v):
    return v - SIGNED if v >= SIGNED // 2 else v


@pytest.mark.parametrize("hot", [2, 100_000])
@pytest.mark.parametrize("which", ["ring", "blocks"])
def test_links_connect_all_within_radius(spark, which, hot):
    """With crowded keys or without, the same components as all pairs."""
    rng = random.Random(7)
    values = {0, SIGNED - 1}
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(8):
            v = center
            for _ in range(rng.randint(0, 6)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    fp = F.col("fp")
    if which == "ring":
        radius = 4
        links = components.hamming_links(fps, simhash_dedup.ring_probes(fp), simhash_dedup.ring_index(fp), 4, hot,
                                         simhash_dedup.ring_budget())
    else:
        radius, keys = fingerprints.RADIUS, fingerprints.block_keys(fp)
        links = components.hamming_links(fps, keys, keys, radius, hot)
    pairs = [tuple(r) for r in links.collect()]
    assert all(((a ^ b) % SIGNED).bit_count() <= radius for a, b in pairs)
    got = {r["node"] % SIGNED: r["root"] for r in components.connected_components(links).collect()}
    want = roots(values, radius)
    groups = {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
    linked = {}
    for v, r in got.items():
        linked.setdefault(r, set()).add(v)
    assert sorted(map(sorted, linked.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(i, 7) for i in range(200, 260)] + [(5, 5), (9, 8), (8, 9)]
    got = components.connected_components(spark.createDataFrame(chain, "a long, b long"))
    by_root = {}
    for r in got.collect():
        by_root.setdefault(r["root"], set()).add(r["node"])
    assert by_root == {100: set(range(100, 161)), 7: {7, *range(200, 260)}, 8: {8, 9}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def edited_rows(texts):
    """Contract columns of op3, with one text per id."""
    order = sorted((d, t or "") for d, t in texts)
    out = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        f, g, h = (term_hash(x) for x in (t, edited, after))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{g:016x}",
                    1 - (f ^ g).bit_count() / 64, 1 - (f ^ h).bit_count() / 64))
    return out


def term_hash(text):
    import re
    return majority([xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x09-\x0D\x20]+", text.lower()) if w])


def test_edited_fingerprints(spark, small_docs):
    made = [(k * 10 - 30, t) for k, (_, t, *_) in enumerate(ODD) if k not in (8, 4)]
    for docs in (spark.createDataFrame(made, "doc_id long, text string"), small_docs,
                 spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")):
        got = fingerprints.report(docs).drop("near_group")
        assert sorted(map(tuple, got.collect())) == edited_rows(texts_of(docs))


def test_fingerprint_report_odd_rows(odd_docs, no_docs):
    got = fingerprints.report(odd_docs).collect()
    assert len(got) == len(ODD)
    twins = [r for r in got if r["doc_id"] == 3 and r["n_chars"] == 180]
    assert len(twins) == 2 and twins[0] == twins[1]
    after = min((xxhash.xxh64_intdigest(t.encode(), 42) if t else 42, t) for d, t, *_ in ODD if d == 3)
    assert after[1]
    assert fingerprints.report(no_docs).collect() == []


def test_near_groups_match_brute_force(small_docs):
    rows = fingerprints.report(small_docs).collect()
    root = roots([int(r["fingerprint"], 16) for r in rows], fingerprints.RADIUS)
    least = {}
    for r in rows:
        f = root[int(r["fingerprint"], 16)]
        least[f] = min(r["doc_id"], least.get(f, r["doc_id"]))
    assert all(r["near_group"] == least[root[int(r["fingerprint"], 16)]] for r in rows)
