"""Session construction and the shared scratch location.

Library functions never build a session themselves; they use the one they are
handed. ``build_session`` is for tests, the benchmark and local use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the plans in this package. AQE re-plans joins from
# runtime sizes (small sides become broadcasts, skewed partitions are split),
# coalesces small shuffle partitions, and the broadcast thresholds are the size
# checks that decide whether a dimension is shipped to every task.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "shelfwise",
    conf: dict[str, str] | None = None,
) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    settings = dict(DEFAULT_CONF)
    # Local mode runs everything in the driver JVM; takes effect when this call starts the JVM.
    settings["spark.driver.memory"] = os.environ.get("SHELFWISE_DRIVER_MEMORY", "16g")
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession, scratch: str | None = None) -> str:
    """Folder for written intermediate tables, shared by the driver and all executors.

    ``scratch`` if given, else ``spark.checkpoint.dir``, else the directory set
    with ``SparkContext.setCheckpointDir``. Without any of these a session in
    local mode (one process, as in tests) gets a private temporary folder; a
    session on a cluster gets an error, because a machine-local folder there
    would lose rows.
    """
    context = spark.sparkContext
    root = scratch or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        master = context.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(
                "No shared scratch folder: start the session with spark.checkpoint.dir, call "
                "SparkContext.setCheckpointDir, or pass scratch= a folder that all executors can write."
            )
        root = tempfile.mkdtemp(prefix="shelfwise-scratch-")
        context.setCheckpointDir(root)
    return root.rstrip("/")
