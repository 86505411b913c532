"""Session construction and the shared working folder.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names (a
distributed file system path visible to every executor).  It is only invented
here when the session has none -- local runs and tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job of this package is written for.  AQE re-plans joins from
# runtime sizes (broadcast only when the measured side is small), coalesces
# small shuffle partitions and splits skewed join partitions.
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_LOCAL_DIR: str | None = None


def build_session(master: str = "local[8]", app: str = "langatlas",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local/test session: UI off, AQE on, small shuffle partition count."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    for k, v in {**SQL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Root of the shared folder (``spark.checkpoint.dir``).

    Read from the session; a local temporary folder is set only when the
    setting is absent (local mode, tests).
    """
    global _LOCAL_DIR
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor shares")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="langatlas-")
        sc.setCheckpointDir(os.path.join(_LOCAL_DIR, "checkpoints"))
    return _LOCAL_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for one run's stage output."""
    return f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` reliably in the checkpoint folder and return it.

    Used where a plan must not be recomputed differently (partition ids after a
    range shuffle) and to survive executor loss without replaying the lineage.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
