import datetime as dt
import random

import pytest

from daybars.operators.planner import (
    check_days, plan_full, plan_incremental, plan_mode_counts, plan_modes,
)
from daybars.schemas import BARS

D = dt.date
AS_OF = D(2025, 12, 3)


def windows(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["code"], []).append((r["i"], r["seg_start"], r["seg_end"]))
    return {k: [(s, e) for _, s, e in sorted(v)] for k, v in out.items()}


@pytest.fixture()
def golden(spark):
    latest = {"uptodate": D(2025, 12, 3), "one": D(2025, 12, 2), "two": D(2025, 12, 1),
              "d101": D(2025, 8, 24)}
    master = spark.createDataFrame([(c,) for c in [*latest, "new"]], "code string")
    bars = spark.createDataFrame([(c, d, 1.0, 1.0, 1.0, 1.0, 1) for c, d in latest.items()], BARS)
    return master, bars


def test_incremental_golden(spark, golden):
    master, bars = golden
    w = windows(plan_incremental(master, bars, AS_OF))
    assert "uptodate" not in w
    assert w["one"] == [(D(2025, 12, 3), D(2025, 12, 3))]
    assert w["two"] == [(D(2025, 12, 2), D(2025, 12, 3))]
    # 101 missing days: the oldest day is requested too (inclusive count)
    assert w["d101"] == [(D(2025, 8, 26), D(2025, 12, 3)), (D(2025, 8, 25), D(2025, 8, 25))]
    assert w["new"] == [(D(2025, 8, 26), D(2025, 12, 3)), (D(2025, 5, 18), D(2025, 8, 25)),
                        (D(2025, 2, 7), D(2025, 5, 17)), (D(2024, 10, 30), D(2025, 2, 6)),
                        (D(2024, 7, 22), D(2024, 10, 29))]


def test_modes(spark, golden):
    master, bars = golden
    m = {r["code"]: r["mode"] for r in plan_modes(master, bars, AS_OF).collect()}
    assert m == {"uptodate": "skip", "one": "incremental", "two": "incremental",
                 "d101": "incremental", "new": "initial"}
    c = {r["mode"]: (r["n_codes"], r["n_windows"]) for r in plan_mode_counts(master, bars, AS_OF).collect()}
    assert c == {"skip": (1, 0), "incremental": (3, 4), "initial": (1, 5)}


def test_full_golden(spark, golden):
    master, _ = golden
    w = windows(plan_full(master, AS_OF, 250))
    assert w["new"] == [(D(2025, 8, 26), D(2025, 12, 3)), (D(2025, 5, 18), D(2025, 8, 25)),
                        (D(2025, 3, 29), D(2025, 5, 17))]
    assert len(w) == 5


@pytest.mark.parametrize("bad", [0, 2001, "x", 1.5, True, None])
def test_days_validation(bad):
    with pytest.raises(ValueError):
        check_days(bad)


def test_windows_cover_missing_range_exactly(spark):
    rnd = random.Random(7)
    gaps = [0, 1, 2, 99, 100, 101, 199, 200, 201, 400, 401] + [rnd.randint(0, 2100) for _ in range(200)]
    latest = {f"c{i}": AS_OF - dt.timedelta(days=g) for i, g in enumerate(gaps)}
    master = spark.createDataFrame([(c,) for c in latest], "code string")
    bars = spark.createDataFrame([(c, d, 1.0, 1.0, 1.0, 1.0, 1) for c, d in latest.items()], BARS)
    w = windows(plan_incremental(master, bars, AS_OF))
    for code, d in latest.items():
        want = (AS_OF - d).days
        segs = w.get(code, [])
        days = set()
        for s, e in segs:
            n = (e - s).days + 1
            assert 1 <= n <= 100
            span = {s + dt.timedelta(days=k) for k in range(n)}
            assert not (span & days)          # disjoint
            days |= span
        assert len(days) == want               # covers (latest, as_of] exactly
        if want:
            assert min(days) == d + dt.timedelta(days=1) and max(days) == AS_OF
        assert len(segs) == -(-want // 100)


def test_plan_has_no_python(spark, golden):
    master, bars = golden
    plan = plan_incremental(master, bars, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_gap_plan_replans_failed_windows(spark):
    from daybars.operators.planner import gap_windows, plan_gaps

    rng = spark.createDataFrame([("a", D(2025, 1, 1), D(2025, 12, 31)),
                                 ("b", D(2025, 1, 1), D(2025, 1, 10)),
                                 ("c", D(2025, 3, 1), D(2025, 3, 31))], "code string, start date, end date")
    cov = spark.createDataFrame([
        # a: answered Jan and Jun-Dec with an overlap; Feb-May failed
        ("a", D(2024, 12, 1), D(2025, 1, 31)), ("a", D(2025, 6, 1), D(2025, 9, 30)),
        ("a", D(2025, 9, 1), D(2025, 12, 31)),
        # b: fully answered; c: nothing answered
        ("b", D(2025, 1, 1), D(2025, 1, 10))], "code string, seg_start date, seg_end date")
    w = windows(gap_windows(rng, cov))
    assert "b" not in w
    assert w["a"] == [(D(2025, 2, 21), D(2025, 5, 31)), (D(2025, 2, 1), D(2025, 2, 20))]
    assert w["c"] == [(D(2025, 3, 1), D(2025, 3, 31))]
    # a hole inside the history survives a newer window (unlike MAX(date))
    master = spark.createDataFrame([("x",)], "code string")
    cov2 = spark.createDataFrame([("x", D(2025, 11, 20), D(2025, 11, 30)),
                                  ("x", D(2025, 12, 2), D(2025, 12, 3))], "code string, seg_start date, seg_end date")
    w2 = windows(plan_gaps(master, cov2, AS_OF, days=14))
    assert w2["x"] == [(D(2025, 12, 1), D(2025, 12, 1))]


@pytest.mark.parametrize("seed", range(4))
def test_interval_difference_day_by_day(spark, seed):
    from daybars.operators.planner import interval_difference

    rnd = random.Random(seed)
    day = lambda k: D(2025, 1, 1) + dt.timedelta(days=k)                    # noqa: E731

    def intervals(n):
        out = []
        for _ in range(n):
            a = rnd.randint(0, 40)
            out.append((rnd.choice("abcd"), day(a), day(a + rnd.randint(-2, 9))))
        return out + out[:2]
    wanted, covered = intervals(14), intervals(10)
    kind = "code string, start date, end date"
    got = interval_difference(spark.createDataFrame(wanted, kind), spark.createDataFrame(covered, kind)).collect()

    def days(rows):
        return {(c, a + dt.timedelta(days=k)) for c, a, b in rows for k in range((b - a).days + 1)}
    found = [(r["code"], r["start"], r["end"]) for r in got]
    assert days(found) == days(wanted) - days(covered)
    assert sum((b - a).days + 1 for _, a, b in found) == len(days(found))      # disjoint
    assert not {(c, b + dt.timedelta(days=1)) for c, _, b in found} & days(found)   # maximal
    empty = spark.createDataFrame([], kind)
    assert interval_difference(empty, empty).collect() == []


def test_answered_days_are_not_planned_again(spark):
    """A code that failed on successive days, whose windows overlap."""
    from daybars.operators.planner import replan_failed
    from daybars.schemas import COVERAGE

    d = lambda k: D(2025, 5, k)                                             # noqa: E731
    master = spark.createDataFrame([("a",), ("b",)], "code string")
    plan = plan_incremental(master, spark.createDataFrame([(c, d(9), 1.0, 1.0, 1.0, 1.0, 1) for c in "ab"], BARS), d(10))

    def gaps(*outcomes):
        cov = spark.createDataFrame([(c, d(s), d(e), ok, 0) for c, s, e, ok in outcomes], COVERAGE)
        return sorted((r["code"], r["seg_start"].day, r["seg_end"].day)
                      for r in replan_failed(plan, cov, master).where("mode = 'gap'").collect())
    assert gaps(("a", 1, 1, False), ("a", 1, 2, False), ("a", 1, 5, True)) == []
    assert gaps(("a", 1, 1, False), ("a", 1, 2, False), ("a", 1, 3, False)) == [("a", 1, 3)]
    assert gaps(("a", 1, 6, False), ("a", 3, 4, True), ("b", 1, 2, False), ("zz", 1, 2, False)) == [
        ("a", 1, 2), ("a", 5, 6), ("b", 1, 2)]
    assert gaps(("a", 8, 10, False)) == [("a", 8, 9)]                       # the plan asks for the 10th


def test_failed_stretch_of_many_days_is_cut_into_windows(spark):
    from daybars.operators.planner import replan_failed
    from daybars.schemas import COVERAGE

    master = spark.createDataFrame([("a",)], "code string")
    plan = plan_incremental(master, spark.createDataFrame([("a", AS_OF, 1.0, 1.0, 1.0, 1.0, 1)], BARS), AS_OF)
    cov = spark.createDataFrame([("a", D(2025, 1, 1), D(2025, 4, 10), False, 0), ("a", D(2025, 3, 1), D(2025, 6, 8), False, 0)], COVERAGE)
    got = windows(replan_failed(plan, cov, master))["a"]
    assert got == [(D(2025, 3, 1), D(2025, 6, 8)), (D(2025, 1, 1), D(2025, 2, 28))]


def test_intervals_meet_in_tasks_by_their_number(spark, monkeypatch):
    """What the intervals are made from comes out of a shuffle of a few bytes,
    which Spark takes for one task's work; its intervals are dealt out all the same."""
    from pyspark.sql import functions as F

    from daybars.operators import planner

    monkeypatch.setattr(planner, "INTERVALS_PER_TASK", 500, raising=False)
    master = spark.range(2000).select(F.col("id").cast("string").alias("code")).repartition("code")
    never = spark.createDataFrame([], "code string, latest date")
    plan = plan_incremental(master, None, AS_OF, never).where("i % 2 = 0")     # three of five windows
    asked = planner._windows(master.select("code", F.lit("x").alias("mode"), F.lit(AS_OF - dt.timedelta(days=499)).alias("start"),
                                           F.lit(AS_OF).alias("end")))
    wanted = asked.select("code", F.col("seg_start").alias("start"), F.col("seg_end").alias("end"))
    gaps = planner.interval_difference(wanted, plan.select("code", F.col("seg_start").alias("start"), F.col("seg_end").alias("end")))
    assert gaps.rdd.getNumPartitions() == 16000 // 500
    assert gaps.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 400
    assert gaps.groupBy("start", "end").count().count() == 2 and gaps.count() == 4000
    coverage = asked.select("code", "seg_start", "seg_end", (F.col("i") > 1).alias("answered"))
    replanned = planner.replan_failed(plan, coverage, master).where("mode = 'gap'")
    assert rows_of(replanned.groupBy("i", "seg_start", "seg_end").count()) == [(0, AS_OF - dt.timedelta(days=199), AS_OF - dt.timedelta(days=100), 2000)]


def test_gap_windows_deal_ranges_by_their_number(spark, monkeypatch):
    """Ranges and coverage out of one small shuffle, by the plan of gaps."""
    from pyspark.sql import functions as F

    from daybars.operators import planner

    monkeypatch.setattr(planner, "INTERVALS_PER_TASK", 300, raising=False)
    master = spark.range(1500).select(F.col("id").cast("string").alias("code")).repartition("code")
    coverage = plan_full(master, AS_OF, 200).where("i = 0").select("code", "seg_start", "seg_end")
    gaps = planner.plan_gaps(master, coverage, AS_OF, 200)
    assert gaps.rdd.getNumPartitions() == 3000 // 300
    assert rows_of(gaps.groupBy("i", "seg_start", "seg_end").count()) == [
        (0, AS_OF - dt.timedelta(days=199), AS_OF - dt.timedelta(days=100), 1500)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
