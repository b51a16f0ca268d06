"""Spark session helpers.

On a cluster the session comes from the launcher and is used as-is; the
builder below is for local runs and tests.  Only settings that are unset are
filled in, so cluster configuration (checkpoint dir, shuffle partitions,
memory) always wins.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings every query relies on.  UTC keeps timestamp output
# comparable with engines that use naive timestamps.
RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "casetriage", extra: dict | None = None) -> SparkSession:
    """Local session used by tests, the bench and the smoke entry point."""
    b = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for k, v in {**RUNTIME_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime defaults that are not set yet (idempotent)."""
    for k, v in RUNTIME_DEFAULTS.items():
        if k == "spark.sql.session.timeZone":
            # timestamps must print the same in every engine the results meet
            spark.conf.set(k, v)
            continue
        try:
            cur = spark.conf.get(k)
        except Exception:  # noqa: BLE001 - unset key
            cur = None
        if cur is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Reads ``spark.checkpoint.dir`` from the session.  Only on a local master
    (tests, one machine) an unset one becomes a private temporary folder;
    elsewhere executors can't share such a folder, so an unset one is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    try:
        d = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # noqa: BLE001
        d = None
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="casetriage-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    import uuid
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
