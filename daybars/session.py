"""Session construction and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. Time zone is pinned so that date arithmetic
# never depends on the machine; ANSI stays on so that bad casts fail loudly
# (every lenient conversion in daybars uses a try_ form explicitly).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # CP949 master files need the legacy charset table.
    "spark.sql.legacy.javaCharsets": "true",
}


def get_session(master: str | None = None, app: str = "daybars",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the daybars defaults.

    On a cluster, ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # checkpoints of per-batch change sets are removed once unreferenced
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        b = b.master(master)
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It must be on storage that the driver and all executors share. Only on a
    local master (tests), where one machine is all there is, an unset one is
    made; elsewhere that is an error, since each executor would write to its
    own disk.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        # getCheckpointDir adds a per-application uuid; use its parent so
        # that all daybars scratch lives next to Spark's own checkpoints.
        return d.rsplit("/", 1)[0]
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="daybars-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder inside the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/daybars/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
