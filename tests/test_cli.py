"""The command line drives the jobs end to end in-process."""

import json
import os

from pyspark.sql import functions as F

from daybars.adapters import bars_from_events, load, quote_json_lines, quote_records
from daybars.cli import main
from daybars.schemas import BARS
from daybars.sources.tables import read_months
from tests.conftest import SF_SMALL, rows
from tests.test_master import line


def run(spark, capsys, *argv):
    assert main(list(argv), spark=spark) == 0
    out = capsys.readouterr().out.strip().splitlines()
    return [json.loads(x) for x in out]


def test_cli_round_trip(spark, tmp_dir, capsys):
    root = f"{tmp_dir}/tables"
    paths = []
    for m, codes in [("KOSPI", range(0, 75)), ("KOSDAQ", range(75, 150))]:
        p = os.path.join(tmp_dir, f"{m}.mst")
        with open(p, "wb") as f:
            f.write("\n".join(line(code=str(c), name=f"N{c}") for c in codes).encode("cp949"))
        paths.append(f"{m}={p}")
    out = run(spark, capsys, "--root", root, "sync-master", "--market", paths[0], "--market", paths[1],
              "--run-ts", "2024-01-01T00:00:00")
    assert out == [{"kospi": 75, "kosdaq": 75, "total": 150}]
    assert run(spark, capsys, "--root", root, "counts") == [{"kospi": 75, "kosdaq": 75, "total": 150}]
    plan = run(spark, capsys, "--root", root, "plan", "--as-of", "2024-01-30", "--out", f"{tmp_dir}/plan")
    assert plan[0]["rows"] == spark.read.json(f"{tmp_dir}/plan").count() == 750     # nothing is cut
    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    quote_json_lines(quote_records(bars, "2024-01-30", 1)).write.text(f"{tmp_dir}/landing")
    summary = run(spark, capsys, "--root", root, "daily", "--as-of", "2024-01-30",
                  "--landing", f"{tmp_dir}/landing")
    assert summary[0]["total"] == 150
    known = bars.where(F.col("code").cast("int") < 150)
    assert rows(read_months(spark, f"{root}/bars", BARS)) == rows(known)
    found = run(spark, capsys, "--root", root, "search", "--name", "n7", "--out", f"{tmp_dir}/found")
    assert found[0]["rows"] == bars.where(F.col("code") == "7").count()
    assert run(spark, capsys, "--root", root, "collected", "--out", f"{tmp_dir}/c")[0]["rows"] == known.select("code").distinct().count()
    checks = run(spark, capsys, "--root", root, "quality")
    assert checks and all(r["n_bad"] == 0 for r in checks if r["check_name"].startswith(("dup", "orphan", "domain")))
    with open(f"{tmp_dir}/gone.txt", "w") as f:
        f.write("7\n8\n")
    run(spark, capsys, "--root", root, "remove", "--codes", f"{tmp_dir}/gone.txt")
    assert rows(read_months(spark, f"{root}/bars", BARS)) == rows(known.where("code NOT IN ('7', '8')"))
    assert run(spark, capsys, "--root", root, "counts")[0]["total"] == 148
    counted = run(spark, capsys, "--root", root, "checks")
    assert {r["check_name"] for r in counted} >= {"null_code", "len_code"} and all(r["n_bad"] == 0 for r in counted)
