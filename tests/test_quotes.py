import datetime as dt
import json
import os

from daybars.functions.parse import int_or_zero, num_or_zero, parse_yyyymmdd, format_yyyymmdd
from daybars.operators.keyed import keep_last
from daybars.schemas import QUOTE
from daybars.sources.quotes import (
    answers_of, bars_of, parse_responses, quarantine_of, read_quotes, split_quotes,
)
from tests.conftest import rows

D = dt.date


def test_lenient_numbers(spark):
    cases = ["12abc", "70100", "10.9", "", None, "abc", "  -3.5e2x", "-0", "NaN", ".5", "1e", "+7"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [(r["f"], r["i"]) for r in df.select(num_or_zero("s").alias("f"), int_or_zero("s").alias("i")).collect()]
    assert got == [(12.0, 12), (70100.0, 70100), (10.9, 10), (0.0, 0), (0.0, 0), (0.0, 0),
                   (-350.0, -3), (0.0, 0), (0.0, 0), (0.5, 0), (1.0, 1), (7.0, 7)]


def test_date_parse_and_format(spark):
    df = spark.createDataFrame([("20251203",), ("20251301",), ("2025120",), (None,)], "s string")
    got = [r["d"] for r in df.select(parse_yyyymmdd("s").alias("d")).collect()]
    assert got == [D(2025, 12, 3), None, None, None]
    one = spark.createDataFrame([(D(2024, 2, 9),)], "d date").select(format_yyyymmdd("d").alias("s"))
    assert one.first()["s"] == "20240209"


def raw(spark, recs):
    return spark.createDataFrame(recs, QUOTE)


def test_golden_quote_cases(spark):
    el = lambda **k: {**dict.fromkeys(["stck_bsop_date", "stck_oprc", "stck_hgpr", "stck_lwpr",
                                       "stck_clpr", "acml_vol"]), **k}
    recs = [
        ("A", "20251201", "20251203", 1, "0", "OK", [
            el(stck_bsop_date="20251203", stck_oprc="12abc", stck_clpr="70100", acml_vol="10.9"),
            el(),                                        # empty element: quarantined alone
            el(stck_bsop_date="20251301", stck_clpr="1"),  # invalid month: quarantined
            el(stck_bsop_date="20251202", stck_clpr="1"),
            el(stck_bsop_date="20251202", stck_clpr="2"),  # same date later in the array wins
        ]),
        ("B", "20251201", "20251203", 2, "1", "rate limit", None),   # rejected response
        ("C", "20251201", "20251203", 3, "0", "OK", None),           # no output2: zero bars
    ]
    bars, bad = split_quotes(raw(spark, recs))
    out = keep_last(bars, ["code", "date"], "seq")
    got = sorted((r["code"], r["date"], r["open"], r["high"], r["low"], r["close"], r["volume"])
                 for r in out.collect())
    assert got == [("A", D(2025, 12, 2), 0.0, 0.0, 0.0, 2.0, 0),
                   ("A", D(2025, 12, 3), 12.0, 0.0, 0.0, 70100.0, 10)]
    reasons = sorted((r["code"], r["reason"]) for r in bad.collect())
    assert reasons == [("A", "bad date"), ("A", "bad date"), ("B", "rejected: rate limit")]
    w = sorted((r["code"], r["rejected"], r["n_bars"]) for r in answers_of(parse_responses(raw(spark, recs))).collect())
    assert w == [("A", False, 3), ("B", True, 0), ("C", False, 0)]
    whole = bad.where("code = 'B'").first()["raw"]
    assert json.loads(whole)["window_start"] == "20251201"     # the whole response


def test_nothing_is_lost(spark, tmp_dir):
    good = {"code": "A", "window_start": "20251201", "window_end": "20251203", "rt_cd": "0", "msg1": "OK",
            "output2": [{"stck_bsop_date": "20251203", "stck_clpr": "1"}, {"stck_bsop_date": "20251202"}]}
    with open(os.path.join(tmp_dir, "x.json"), "w") as f:
        f.write(json.dumps(good) + "\n" + json.dumps(good | {"code": None}) + "\n")
        f.write('{"code": "B", "output2": [{"stck\n')
        f.write(json.dumps(good | {"code": None, "output2": []}) + "\n")
        f.write(json.dumps(good | {"code": "C", "output2": None}) + "\n")
    parsed = parse_responses(read_quotes(spark, tmp_dir))
    assert bars_of(parsed).count() == 2
    bad = sorted((r["reason"], r["raw"]) for r in quarantine_of(parsed).collect())
    assert [r for r, _ in bad] == ["bad json", "no code", "no code", "no code"]
    assert bad[0][1] == '{"code": "B", "output2": [{"stck'
    assert all(t for _, t in bad)


def test_last_answer_of_a_window_counts(spark):
    one = [{"stck_bsop_date": "20251203"}]
    el = [tuple(x.get(c) for c in ("stck_bsop_date", "stck_oprc", "stck_hgpr", "stck_lwpr", "stck_clpr", "acml_vol")) for x in one]
    w = ("20251201", "20251203")
    recs = [("A", *w, 1, "1", "busy", None), ("A", *w, 2, "0", "OK", el),      # answered on retry
            ("B", *w, 1, "0", "OK", el), ("B", *w, 2, "1", "busy", None),      # rejected in the end
            ("C", *w, 1, "0", "OK", [("bad",) + (None,) * 5])]                 # nothing readable
    got = sorted((r["code"], r["seg_start"], r["rejected"], r["n_bars"])
                 for r in answers_of(parse_responses(raw(spark, recs))).collect())
    assert got == [("A", D(2025, 12, 1), False, 1), ("B", D(2025, 12, 1), True, 0), ("C", D(2025, 12, 1), False, 0)]


def test_read_landed_files_later_file_wins(spark, tmp_dir):
    def write(name, close, mtime):
        rec = {"code": "A", "window_start": "20251201", "window_end": "20251203", "rt_cd": "0",
               "msg1": "OK", "output2": [{"stck_bsop_date": "20251203", "stck_clpr": close}]}
        p = os.path.join(tmp_dir, name)
        with open(p, "w") as f:
            f.write(json.dumps(rec) + "\n")
        os.utime(p, (mtime, mtime))
    write("b.json", "2", 1_700_000_000)
    write("a.json", "3", 1_700_000_100)   # lands later although its name sorts first
    bars, _ = split_quotes(read_quotes(spark, tmp_dir))
    out = keep_last(bars, ["code", "date"], "seq")
    assert [r["close"] for r in out.collect()] == [3.0]


def test_read_pretty_printed_responses(spark, tmp_dir):
    for i, close in enumerate(["1", "2"]):
        rec = {"code": f"C{i}", "window_start": "20251201", "window_end": "20251203", "rt_cd": "0",
               "msg1": "OK", "output2": [{"stck_bsop_date": "20251203", "stck_clpr": close}]}
        with open(os.path.join(tmp_dir, f"r{i}.json"), "w") as f:
            json.dump(rec, f, indent=2)
    bars, bad = split_quotes(read_quotes(spark, tmp_dir, multiline=True))
    assert sorted((r["code"], r["close"]) for r in bars.collect()) == [("C0", 1.0), ("C1", 2.0)]
    assert bad.count() == 0


def _float_prefix_model(s):
    """Independent model of the lenient float rule: skip leading spaces,
    optional sign, 'Infinity' or digits with an optional fraction and an
    optional exponent (only when digits follow); no number, NaN or 0 -> 0.0."""
    if s is None:
        return 0.0
    i, n = 0, len(s)
    while i < n and s[i].isspace():
        i += 1
    j = i
    if j < n and s[j] in "+-":
        j += 1
    if s.startswith("Infinity", j):
        return float(s[i:j + 8])
    k, digits = j, 0
    while k < n and s[k].isdigit():
        k, digits = k + 1, digits + 1
    if k < n and s[k] == ".":
        k += 1
        while k < n and s[k].isdigit():
            k, digits = k + 1, digits + 1
    if digits == 0:
        return 0.0
    end = k
    if k < n and s[k] in "eE":
        e = k + 1
        if e < n and s[e] in "+-":
            e += 1
        if e < n and s[e].isdigit():
            while e < n and s[e].isdigit():
                e += 1
            end = e
    v = float(s[i:end])
    return 0.0 if v == 0 or v != v else v


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=" 0123456789.eE+-xInfity", max_size=10), min_size=150, max_size=150))
def test_num_or_zero_matches_model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["v"] for r in df.select(num_or_zero("s").alias("v")).collect()]
    assert got == [_float_prefix_model(t) for t in texts]


def _int_prefix_model(s):
    """Independent model of the lenient integer rule: spaces, sign, leading
    decimal digits; anything else gives 0."""
    if s is None:
        return 0
    t = s.lstrip()
    sign, k = 1, 0
    if t[:1] in ("+", "-"):
        sign, k = (-1 if t[0] == "-" else 1), 1
    j = k
    while j < len(t) and t[j].isdigit():
        j += 1
    return sign * int(t[k:j]) if j > k else 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=" 0123456789.eE+-x", max_size=10), min_size=150, max_size=150))
def test_int_or_zero_matches_model(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r["v"] for r in df.select(int_or_zero("s").alias("v")).collect()]
    assert got == [_int_prefix_model(t) for t in texts]


def test_ranked_order_is_the_struct_order(spark, tmp_dir):
    """A4: the packed arrival order sorts like (time, file, fetch, position)."""
    from daybars.sources.quotes import ranked

    rows_ = []
    for i, (name, mtime) in enumerate([("b", 1_700_000_000), ("a", 1_700_000_100), ("c", 1_700_000_000)]):
        p = os.path.join(tmp_dir, f"{name}.json")
        with open(p, "w") as f:
            for seq in (-5, 3, 10 ** 12):
                f.write(json.dumps({"code": "A", "window_start": "20251201", "window_end": "20251203", "rt_cd": "0", "msg1": "OK",
                                    "fetch_seq": seq, "output2": [{"stck_bsop_date": "20251203", "stck_clpr": str(k)} for k in range(3)]}) + "\n")
        os.utime(p, (mtime, mtime))
    parsed = parse_responses(read_quotes(spark, tmp_dir))
    old = [(r["date"], r["close"]) for r in bars_of(parsed).orderBy("seq").collect()]
    new = ranked(parsed)
    assert dict(new.dtypes)["seq"] == "bigint" and new.select("seq").distinct().count() == 27
    both = parsed.select("seq", "close").collect()
    order = {tuple(r["seq"]): None for r in both}
    packed = sorted((r["seq"], r["close"]) for r in new.collect())
    assert [c for _, c in packed] == [r["close"] for r in parsed.orderBy("seq").collect()]
    assert len(old) == 27 and len(order) == 27 and new.select("response").distinct().count() == 9
    assert rows(answers_of(new)) == rows(answers_of(parsed))
    assert ranked(parsed.limit(0)).count() == 0
