"""Plan assertions: the physical plans we want at scale."""

import datetime as dt
import re

from daybars.adapters import bars_from_events, load
from daybars.operators.features import features_as_of, features_full, prev_bar
from daybars.operators.keyed import upsert
from daybars.operators.planner import plan_incremental
from daybars.schemas import BARS
from tests.conftest import SF_SMALL


def stored_bars(spark, tmp_dir):
    bars_from_events(load(spark, SF_SMALL, "events")).write.parquet(f"{tmp_dir}/bars")
    return spark.read.schema(BARS).parquet(f"{tmp_dir}/bars")


def plan_of(df):
    df.collect()  # let AQE finish so the final plan is shown
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_full_is_one_scan_and_one_shuffle(spark, tmp_dir):
    bars = stored_bars(spark, tmp_dir)
    p = plan_of(features_full(bars)).split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning\(code#\d+, \d+\)", p)) == 1
    assert p.count("Exchange") == 1 and p.count("FileScan") == 1
    assert "Python" not in p and "Join" not in p


def executed(spark, action):
    """Rows read from files and rows shuffled by ``action``, from Spark's
    status store."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = {s.stageId() for s in stages(store)}
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for s in stages(store) if s.stageId() not in before]
    return sum(s.inputRecords() for s in new), sum(s.shuffleWriteRecords() for s in new)


def stages(store):
    listed = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None)
    return [listed.apply(i) for i in range(listed.size())]


def test_refresh_of_one_row_shuffles_its_code_only(spark, tmp_dir):
    from pyspark.sql import functions as F

    from daybars.operators.features import month_summary, touched_refresh

    bars = stored_bars(spark, tmp_dir)
    month_summary(bars).write.parquet(f"{tmp_dir}/s")
    summ = spark.read.parquet(f"{tmp_dir}/s")
    last = bars.agg(F.max("date")).first()[0]
    one = bars.where(F.col("date") == F.lit(last)).orderBy("code").limit(1)
    one.write.parquet(f"{tmp_dir}/one")
    changes = spark.read.schema(BARS).parquet(f"{tmp_dir}/one")
    code = changes.first()["code"]
    own = bars.where(F.col("code") == code).count()

    def refresh():
        _, fresh, _ = touched_refresh(bars, changes, materialise=True, summary=summ)
        fresh.collect()
    _, moved = executed(spark, refresh)
    assert moved <= 4 * own + 20 < bars.count()


def test_rebuild_reads_the_bars_once(spark, tmp_dir):
    from daybars.plans.jobs import job_features_full
    from daybars.sources.tables import changed_months, write_months

    bars = bars_from_events(load(spark, SF_SMALL, "events"))
    write_months(bars, f"{tmp_dir}/b", changed_months(bars), sort_by=["code", "date"])
    read, _ = executed(spark, lambda: job_features_full(spark, f"{tmp_dir}/b", f"{tmp_dir}/f"))
    assert read == bars.count()


def test_prev_bar_pushes_date_filter_and_aggregates_by_hash(spark, tmp_dir):
    bars = stored_bars(spark, tmp_dir)
    p = plan_of(prev_bar(bars, dt.date(2024, 1, 15)))
    assert "LessThan(date,2024-01-15)" in p
    assert "HashAggregate" in p and "SortAggregate" not in p


def test_as_of_reads_only_needed_columns(spark, tmp_dir):
    bars = stored_bars(spark, tmp_dir)
    p = plan_of(features_as_of(bars, "2024-01-15"))
    assert "EqualTo(date,2024-01-15)" in p
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_planner_and_upsert_have_no_cross_join_or_python(spark, tmp_dir):
    bars = stored_bars(spark, tmp_dir)
    master = bars.select("code").distinct()
    for df in (plan_incremental(master, bars, "2024-06-01"),
               upsert(bars, bars.limit(10), ["code", "date"])):
        p = plan_of(df)
        assert "CartesianProduct" not in p and "NestedLoop" not in p
        assert "Python" not in p


def test_touched_refresh_streams_features_without_shuffle(spark, tmp_dir):
    from pyspark.sql import functions as F

    from daybars.operators.features import features_touched

    bars = stored_bars(spark, tmp_dir)
    features_full(bars).write.parquet(f"{tmp_dir}/f")
    feats = spark.read.parquet(f"{tmp_dir}/f")
    last = bars.agg(F.max("date")).first()[0]
    changes = bars.where(F.col("date") == F.lit(last)).withColumn("close", F.col("close") + 1)
    p = plan_of(features_touched(feats, upsert(bars, changes, ["code", "date"]), changes))
    p = p.split("== Initial Plan ==")[0]
    lines = p.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and f"{tmp_dir}/f" in x)
    above = "\n".join(lines[max(0, scan - 3):scan])
    # the large features table is compared with the broadcast first changed days,
    # never shuffled
    assert "BroadcastHashJoin" in above and "LeftOuter" in above
    assert "Exchange" not in above


def test_touched_refresh_shuffles_changed_days_only(spark, tmp_dir):
    from pyspark.sql import functions as F

    from daybars.operators.features import changed_since, features_since

    bars = stored_bars(spark, tmp_dir)
    last = bars.agg(F.max("date")).first()[0]
    since = changed_since(bars.where(F.col("date") == F.lit(last)))
    p = plan_of(features_since(bars, since)).split("== Initial Plan ==")[0]
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2            # the days; one row a code and task
    assert "SortMergeJoin" not in p and "SortAggregate" not in p
    codes, files = since.count(), spark.read.parquet(f"{tmp_dir}/bars").rdd.getNumPartitions()
    _, moved = executed(spark, lambda: features_since(bars, since).collect())
    assert moved <= codes * (files + 2) + 10 < bars.count()


def test_keep_last_is_a_hash_aggregate_without_paths(spark, tmp_dir):
    from daybars.adapters import quote_json_lines, quote_records
    from daybars.operators.keyed import keep_last
    from daybars.sources.quotes import bars_of, parse_responses, ranked, read_quotes, stage

    bars = stored_bars(spark, tmp_dir)
    quote_json_lines(quote_records(bars, "2024-01-30", 1)).write.text(f"{tmp_dir}/l")
    parsed = ranked(stage(parse_responses(read_quotes(spark, f"{tmp_dir}/l"))))
    out = keep_last(bars_of(parsed), ["code", "date"], "seq")
    assert dict(out.dtypes)["seq"] == "bigint"
    p = plan_of(out).split("== Initial Plan ==")[0]
    assert "HashAggregate" in p and "SortAggregate" not in p
    exchanged = [x for x in p.split("\n") if "Exchange hashpartitioning" in x]
    assert len(exchanged) == 1 and "code#" in exchanged[0] and "_f#" not in exchanged[0]


def test_rebuild_from_buckets_shuffles_nothing_before_the_write(spark, tmp_dir):
    from daybars.schemas import FEATURES
    from daybars.sources.bucketed import open_bucketed, rebuild_bucketed, store_bucketed
    from daybars.sources.tables import read_months
    from tests.conftest import rows

    bars = stored_bars(spark, tmp_dir)
    name = "bucketed_" + re.sub(r"\W", "", tmp_dir)
    open_bucketed(spark, name, f"{tmp_dir}/bucketed", 4)
    store_bucketed(bars.where("date < '2024-01-20'"), name, 4)
    store_bucketed(bars, name, 4)                                   # January again, whole
    p = plan_of(features_full(spark.table(name)))
    assert "Exchange" not in p and "Window" in p
    assert rows(features_full(spark.table(name))) == rows(features_full(bars))
    _, moved = executed(spark, lambda: features_full(spark.table(name)).write.format("noop").mode("overwrite").save())
    assert moved == 0
    rebuild_bucketed(spark, name, f"{tmp_dir}/f")
    assert rows(read_months(spark, f"{tmp_dir}/f", FEATURES)) == rows(features_full(bars))
    # another session finds the months that are stored
    spark.sql(f"DROP TABLE {name}")
    open_bucketed(spark, name, f"{tmp_dir}/bucketed", 4)
    assert spark.table(name).count() == bars.count()
