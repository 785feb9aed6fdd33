import io
import os
import zipfile

from daybars.sources.master_text import (
    parse_master_lines, read_master_text, read_master_zip, read_masters, split_master_lines,
)
from daybars.operators.keyed import keep_last
from tests.conftest import rows

TAIL = "T" * 228


def line(code="005930", std="KR7005930003", name="삼성전자", pad=40, tail=TAIL):
    return code.ljust(9) + std + name.ljust(pad) + tail


def lines_df(spark, ls):
    return spark.createDataFrame([(x,) for x in ls], "line string")


def test_golden_line(spark):
    ok = line()
    df = lines_df(spark, [ok])
    assert rows(parse_master_lines(df, "KOSPI")) == [("005930", "삼성전자", "KOSPI")]


def test_short_and_blank_lines_are_quarantined(spark):
    base = line()
    cases = [
        base[:227],                                  # shorter than the tail
        ("005930".ljust(9) + "KR7005930003").ljust(249, " ")[:21] + "x" * 228,  # len 249: empty name
        base[:21] + "x" * (240 - 21 - 228) + "y" * 228,  # len 240: bounds would swap
        " " * 9 + "KR7005930003" + "이름".ljust(40) + TAIL,   # blank code
        "000001".ljust(9) + "KR7000001000" + " " * 40 + TAIL,  # blank name
    ]
    good, bad = split_master_lines(lines_df(spark, cases), "KOSDAQ")
    assert good.count() == 0
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["blank code (KOSDAQ)", "blank name (KOSDAQ)", "short line (KOSDAQ)",
                       "short line (KOSDAQ)", "short line (KOSDAQ)"]


def test_unicode_trim(spark):
    name = "　 Name "
    df = lines_df(spark, [line(name=name)])
    assert rows(parse_master_lines(df, "KOSPI"), "name") == [("Name",)]


def test_cp949_file_with_crlf(spark, tmp_dir):
    text = "\n".join([line(), line(code="000660", std="KR7000660001", name="SK하이닉스")]) + "\r\n"
    path = os.path.join(tmp_dir, "kospi_code.mst")
    with open(path, "wb") as f:
        f.write(text.encode("cp949"))
    df = read_master_text(spark, path)
    lens = sorted(r["n"] for r in df.selectExpr("length(line) AS n").collect())
    # the trailing \r stays on the last line and counts as a tail character
    assert lens == [len(line()), len(line()) + 1]
    got = rows(parse_master_lines(df, "KOSPI"), "code", "name")
    # as in the source system, the \r shifts the tail by one character, so
    # the first tail character ends up at the end of the name range
    assert got == [("000660", "SK하이닉스".ljust(40) + "T"), ("005930", "삼성전자")]


def test_zip_archive(spark, tmp_dir):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("kosdaq_code.mst", (line(code="035720", name="카카오") + "\n").encode("cp949"))
    path = os.path.join(tmp_dir, "kosdaq_code.mst.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    df = read_master_zip(spark, path, "kosdaq_code.mst")
    assert rows(parse_master_lines(df, "KOSDAQ")) == [("035720", "카카오", "KOSDAQ")]


def test_two_markets_last_wins(spark, tmp_dir):
    paths = {}
    for m, nm in [("KOSPI", "A사"), ("KOSDAQ", "B사")]:
        p = os.path.join(tmp_dir, f"{m}.mst")
        with open(p, "wb") as f:
            f.write((line(code="111111", name=nm) + "\n" + line(code=m[:6], name=m) + "\n").encode("cp949"))
        paths[m] = p
    u, bad = read_masters(spark, paths)
    assert bad.count() == 0
    out = keep_last(u, ["code"], "_prio").drop("_prio")
    got = dict((r["code"], r["market_type"]) for r in out.collect())
    assert got == {"111111": "KOSDAQ", "KOSPI": "KOSPI", "KOSDAQ": "KOSDAQ"}


def test_reader_keeps_lines_verbatim(spark, tmp_dir):
    # quotes, backslashes, a leading '#', separators and outer spaces survive
    # the CSV reader untouched; only empty lines vanish (too short anyway)
    lines = ["#comment-like", 'say "hi"', 'back\\slash \\" x', "a,b;c\td", "  pad  ", '"whole"', "", "end"]
    path = os.path.join(tmp_dir, "odd.mst")
    with open(path, "wb") as f:
        f.write("\n".join(lines).encode("cp949"))
    got = [r["line"] for r in read_master_text(spark, path).collect()]
    assert got == [x for x in lines if x]


def test_zip_streams_in_chunks(spark, tmp_dir):
    n = 2500
    text = "\n".join(line(code=str(100000 + i), name=f"종목{i}") for i in range(n)) + "\n"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.mst", text.encode("cp949"))
    path = os.path.join(tmp_dir, "big.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    df = read_master_zip(spark, path, chunk_lines=300)
    got = parse_master_lines(df, "KOSPI")
    assert got.count() == n
    assert rows(got.where("code = '100007'"), "name") == [("종목7",)]
