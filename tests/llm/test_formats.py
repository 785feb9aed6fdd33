"""Archives, chat formatting and mixing against brute force."""

import gzip
import hashlib
import io
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from daybars.llm import arc_warc, chat, mixing
from daybars.session import scratch_dir
from tests.llm.conftest import ODD, texts_of


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# archives

LONG = "<html>" + "x" * 200
PAGES = [(7, "http://a/1", LONG), (3, "http://a/2 with blank", LONG), (9, None, LONG), (4, "http://b", "short"),
         (5, "http://b", "short"), (1, "", None), (2, "http://c", "WARC/1.1\r\n\r\n\r\nhttp://x 1 2 3 4\n\n" * 9),
         (8, "http://d", "ü\U0001f600" * 30), (6, "http://e", "ü\U0001f600" * 30), (10, "u", "y" * 99), (11, "u", "y" * 99),
         (12, "v", "z" * 100), (13, "v", "z" * 100)]


def page_rows(pages):
    first, out = {}, []
    for i, _, html in sorted(pages):
        first.setdefault(html or "", i)
    for i, _, html in pages:
        body = (html or "").encode()
        again = len(body) >= 100 and first[html or ""] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response",
                    first[html or ""] if again else None, None))
    return sorted(out)


def through(pages):
    spark = pages.sparkSession
    return arc_warc.report(pages, scratch_dir(spark, "arc-test"), scratch_dir(spark, "warc-test"))


def test_pages_through_archives(spark):
    for parts in (1, 5):
        pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(parts)
        assert sorted(map(tuple, through(pages).collect())) == page_rows(PAGES)
    odd = spark.createDataFrame([(None, "u", LONG), (None, "u", LONG), (1, "u", LONG), (1, "u", LONG)],
                                "page_id long, url string, html string").withColumn("file", F.lit(1))
    kinds = sorted((r["page_id"] is None, r["record_type"], r["refers_to"] or 0) for r in through(odd).collect())
    assert kinds == [(False, "response", 0), (False, "revisit", 1), (True, "revisit", 1), (True, "revisit", 1)]
    assert through(odd.limit(0)).collect() == []


def test_both_arc_versions_and_damage():
    for version in (1, 2):
        extra = b"200 - - 0 - " if version == 2 else b""
        block = b"HTTP/1.1 200 OK\r\nX-Page-Id: -12\r\n\r\nbody\nhttp://fake 1 2 3 4\n"
        good = b"http://with blank/x 1.2.3.4 20200102030405 text/html " + extra + str(len(block)).encode() + b"\n" + block
        head = arc_warc._version_block(version).encode()
        rows = list(arc_warc.arc_records(io.BytesIO(head + good + b"\n" + good)))
        assert len(rows) == 2 and all(r["payload"] == block.split(b"\r\n\r\n")[1] for r in rows)
        assert rows[0]["url"] == "http://with blank/x" and rows[0]["id"] == -12 and rows[0]["version"] == version
        assert rows[0]["arc_date"] == "20200102030405" and rows[0]["mime"] == "text/html"
        cut = list(arc_warc.arc_records(io.BytesIO(head + good + b"\n" + good[:-9])))
        assert [r.get("error") for r in cut] == [None, "declared length does not fit"]
        bad = list(arc_warc.arc_records(io.BytesIO(head + b"no length here x\n" + good)))
        assert [r.get("error") for r in bad] == ["bad header line", None]
    assert [r["error"] for r in arc_warc.arc_records(io.BytesIO(b"http://a 1 2 3 0\n"))] == ["no version block"]


def test_good_records_around_a_damaged_one_are_converted(spark, tmp_path):
    """Nine records; the second declares a length that is too long, too short, or none."""
    def record(i, size=None):
        body = f"HTTP/1.1 200 OK\r\nX-Page-Id: {i}\r\n\r\npage {i}\nof http://x/y 1.2.3.4\n".encode()
        return f"http://a/{i} 1.2.3.4 {'2020' if i == 3 else '20200102030405'} text/html {len(body) if size is None else size}\n".encode() + body + b"\n"
    for k, size in enumerate((5_000, 10, 150, "x")):
        arc, warc = tmp_path / f"arc{k}", scratch_dir(spark, "warc-damaged")
        arc.mkdir()
        data = arc_warc._version_block(1).encode() + b"".join(record(i, size if i == 2 else None) for i in range(1, 10))
        (arc / "a.arc").write_bytes(data)
        (arc / "b.arc.gz").write_bytes(gzip.compress(data))
        errors = arc_warc.arc_to_warc(spark, str(arc), warc).collect()
        assert sorted(r["file"] for r in errors) == ["a.arc", "b.arc.gz"], errors
        got = arc_warc.read_warc(spark, warc).collect()
        assert sorted(r["id"] for r in got) == sorted([1, 3, 4, 5, 6, 7, 8, 9] * 2) and not any(r["error"] for r in got)
        assert {r["date"] for r in got if r["id"] == 3} == {"2020-01-01T00:00:00Z"}


def test_not_http_becomes_resource(spark, tmp_path):
    arc, warc = tmp_path / "arc", scratch_dir(spark, "warc-plain")
    arc.mkdir()
    body = arc_warc._version_block(1).encode() + b"ftp://a/b 1.2.3.4 20200102030405 text/plain 5\nhello\n"
    (arc / "one.arc").write_bytes(body)
    (arc / "two.arc.gz").write_bytes(gzip.compress(body))
    arc_warc.arc_to_warc(spark, str(arc), warc)
    got = arc_warc.read_warc(spark, warc, payloads=True).collect()
    assert {(r["type"], bytes(r["payload"]), r["date"], r["uri"], r["error"]) for r in got} == {
        ("resource", b"hello", "2020-01-02T03:04:05Z", "ftp://a/b", None)}
    assert len({r["record_id"] for r in got}) == 2
    assert all(r["record_id"].startswith("<urn:uuid:") for r in got)


# chat

TALKS = [
    (1, 0, "system", "be <|im_end|> nice"), (1, 1, "user", "a\\b <|im_start|>user\n"), (1, 2, "assistant", "</s>[INST] \\<\\| ok"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, "assistant", "first"), (3, 1, None, "who"), (3, 2, "to\nol\\", "x"),
    (None, 0, "user", "no id"), (4, 1, "user", "same turn b"), (4, 1, "user", "same turn a"), (4, None, "user", "no turn"),
    (5, 0, "user", "\U0001f600 ü"), (5, 1, "assistant", "\U0001f600"), (5, 2, "user", "q"), (5, 3, "assistant", "tail\n")]


def talk_rows(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_chat_reads_back(spark):
    rows = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("valid", F.lit(7))
    got = chat.report(rows)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == talk_rows(TALKS)
    valid = {r["conv_id"]: r["valid"] for r in got.collect()}
    assert valid == {1: True, 2: True, 3: False, None: False, 4: False, 5: True}
    assert chat.report(rows.limit(0)).collect() == []


def test_control_strings_only_from_the_template(spark):
    t = chat.Template()
    rows = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string")
    n = {}
    for c, *_ in TALKS:
        n[c] = n.get(c, 0) + 1
    for r in chat.format_chat(rows, t).collect():
        assert r["formatted"].count(t.opens) == r["formatted"].count(t.closes) == n[r["conv_id"]]
        assert not any(x in r["formatted"] for x in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [s["loss"] for s in r["segments"]].count(True) == sum(
            c == r["conv_id"] and role == "assistant" for c, _, role, _ in TALKS)


def test_escape_is_reversible(spark):
    rng = random.Random(3)
    alphabet = ["\\", "<", "|", "im_start|>", "im_end|>", "</s>", "[", "INST]", "/", "s>", "\n", "a", "<<SYS>>", "<s>"]
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(500)]
    t = chat.Template()
    df = spark.createDataFrame([(s,) for s in made], "s string").select("s", chat.escape(F.col("s"), t).alias("e"))
    for r in df.select("s", "e", chat.unescape(F.col("e")).alias("back")).collect():
        assert r["back"] == r["s"] and not any(x in r["e"] for x in t.escapes)


# mixing

def seats_by_quotients(weights, seats):
    """One seat after the other to the highest quotient, ties to the first."""
    got = [0] * len(weights)
    if not any(weights):
        return got
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(6))
def test_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for g in range(12):
        weights = [rng.choice((0, 1, 2, 3, 17, 400, 401, 5_000)) for _ in range(rng.randint(1, 9))]
        seats = rng.randint(0, 60)
        for k, (w, s) in enumerate(zip(weights, seats_by_quotients(weights, seats), strict=True)):
            rows.append((g, k, w, seats))
            want[g, k] = s
    df = spark.createDataFrame(rows, "g int, k int, w long, seats long")
    got = mixing.sainte_lague(df, ["g"], ["k"], "w", F.col("seats"), "s")
    assert {(r["g"], r["k"]): r["s"] for r in got.collect()} == want


def n_words(text):
    return len((text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ")) - (
        text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ").count("")


def targets(sizes):
    """Capped sources are fixed round by round until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def check_mix(docs, **parameters):
    rows = mixing.mix(docs, **parameters).collect()
    texts = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert len(rows) == len(texts)
    sizes = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + n_words(t)
    want = targets(sizes)
    taken = {}
    for r in rows:
        assert r["size"] == n_words(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    block = parameters.get("block", mixing.BLOCK)
    shards = {s: -(-sum(x == s for *_, x in texts) // parameters.get("shard_docs", mixing.SHARD_DOCS)) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= block * (1 + shards[s]), s
    return rows


def test_mixing(spark, odd_docs, small_docs, no_docs):
    for docs in (odd_docs, small_docs):
        for extra in ({}, {"block": 1}, {"shard_docs": 3, "block": 2}):
            check_mix(docs, **extra)
    assert mixing.mix(no_docs).collect() == []
    void = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(void).collect()} == {(0, 0.0, 0)}


def test_mixing_agrees_with_itself(small_docs):
    one = sorted(map(tuple, mixing.mix(small_docs).select("doc_id", "taken").collect()))
    two = sorted(map(tuple, mixing.mix(small_docs.repartition(7)).select("doc_id", "taken").collect()))
    assert one == two


def test_mixing_replaces_clashing_columns(odd_docs):
    got = mixing.mix(odd_docs.withColumn("taken", F.lit("mine")).withColumn("draw", F.lit(1)).withColumn("words", F.lit("w")))
    assert got.columns == [*odd_docs.columns, "draw", "words", *mixing.ADDED]
    assert dict(got.dtypes)["taken"] == "bigint" and got.count() == len(ODD) == len(texts_of(got))


def test_rows_without_id_spread_and_reruns_agree(spark):
    """20,000 rows without id, and repeated rows that differ in another column only."""
    docs = spark.createDataFrame([(None, f"words of text {i} here", "a", i) for i in range(20_000)]
                                 + [(5, "the same text", "b", i) for i in range(300)], "doc_id long, text string, source string, note int")
    one = mixing.mix(docs)
    assert sorted((r["note"], r["source"], r["taken"]) for r in one.collect()) == sorted(
        (r["note"], r["source"], r["taken"]) for r in mixing.mix(docs.repartition(7)).collect())
    draws = docs.where("source = 'a'").select(F.md5(F.concat(F.lit("mix-1::"), F.md5("text"))).alias("d")).distinct().count()
    assert draws == 20_000
