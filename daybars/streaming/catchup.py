"""Structured Streaming catch-up of landed quote files.

Survey rows: ST1 (with C2 and W3 inside each micro-batch).

New landed files are read once each (the file source tracks them in its
checkpoint); every micro-batch is parsed and staged once, de-duplicated by
arrival order and upserted into the bars table as a new version, then the
features of the touched codes are refreshed. Late or corrected bars simply
overwrite by key.

Fault tolerance: ``foreachBatch`` may re-run a batch after a failure. The
batch body is idempotent (``upsert(upsert(b, c), c) == upsert(b, c)``), and its
quarantine folder is named after the stream and the batch, so a retried batch
gives the same tables.

Coverage: every answer that comes by says whether its window was answered or
rejected, and that is merged into the coverage. Windows that a plan recorded
there (``job_plan(..., record=True)``) and that no answer ever meets stay open.
Either kind is planned again.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from daybars.plans.jobs import answered_windows, merge_coverage, store
from daybars.schemas import BARS, FEATURES
from daybars.session import checkpoint_dir
from daybars.sources.quotes import answers_of, parse_responses, quote_stream, ranked, stage
from daybars.sources.tables import read_months, read_summary, refresh_feature_months

MAX_FILES = 1_000       # per micro-batch, so a first load comes in bounded pieces


def make_batch_writer(bars_root: str, features_root: str | None = None,
                      quarantine_root: str | None = None, summary_root: str | None = None,
                      master_root: str | None = None, stream: str = "stream", coverage_root: str | None = None,
                      latest_root: str | None = None, checks_root: str | None = None):
    """The ``foreachBatch`` body: parse -> keep_last -> upsert -> refresh."""

    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        checkpoint_dir(spark)
        parsed = ranked(stage(parse_responses(batch)))
        # one folder per stream and batch, overwritten on retry: no duplicates
        changes = store(spark, parsed, bars_root, quarantine_root, f"{stream}-{epoch_id}", summary_root, master_root,
                        latest_root, checks_root)
        if coverage_root is not None:
            merge_coverage(spark, coverage_root, answered_windows(answers_of(parsed)))
        if changes.isEmpty():
            return
        if features_root is not None:
            msum = None if summary_root is None else read_summary(spark, bars_root, summary_root, BARS)
            refresh_feature_months(spark, features_root, read_months(spark, bars_root, BARS),
                                   changes, FEATURES, bars_root=bars_root, bars_schema=BARS,
                                   summary=msum)

    return run


def start_catchup(spark: SparkSession, landing: str, bars_root: str, checkpoint: str,
                  features_root: str | None = None, quarantine_root: str | None = None,
                  max_files: int | None = MAX_FILES, summary_root: str | None = None,
                  every: str | None = None, multiline: bool = False, master_root: str | None = None,
                  coverage_root: str | None = None, latest_root: str | None = None, checks_root: str | None = None):
    """Process everything landed so far, then stop (``availableNow``); or,
    with ``every`` (e.g. ``"10 minutes"``), keep running and pick up new
    files on that schedule. ``checkpoint`` must be on shared storage: it
    records which files were processed, so a restarted query resumes; it
    also names the stream in the quarantine. With ``master_root`` bars of
    unknown codes go to quarantine."""
    name = f"stream-{zlib.crc32(checkpoint.rstrip('/').encode()):08x}"
    w = (quote_stream(spark, landing, max_files, multiline)
         .writeStream
         .foreachBatch(make_batch_writer(bars_root, features_root, quarantine_root, summary_root, master_root, name,
                                        coverage_root, latest_root, checks_root))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=every) if every else w.trigger(availableNow=True)
    return w.start()
