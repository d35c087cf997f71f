"""Session construction and the shared checkpoint folder.

The cluster names its shared folder in ``spark.checkpoint.dir``.  Jobs read it
from the session; only a local session (tests, the bench) that has none gets a
scratch folder made with ``mkdtemp``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session defaults that matter for every plan in the package.
#  * AQE re-plans at runtime: small join sides measured after their shuffle
#    stage become broadcast joins (the size check for every join whose side is
#    not bounded by construction), skewed partitions (hub URLs, one huge host)
#    are split, tiny partitions are coalesced.
#  * ANSI mode stays on (the 4.x default); the code uses try_* functions.
_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "sitegraph", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    No master is set unless one is given: spark-submit's (or the running
    session's) stays.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if os.environ.get("SITEGRAPH_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = os.environ["SITEGRAPH_DRIVER_MEMORY"]
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder.  Only a local session without one gets a scratch
    folder; a cluster must name a folder that all its machines see."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sitegraph-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def workers_find_package() -> None:
    """Python workers find this package where the driver found it (a cluster without that
    path gets it by --py-files)."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = SparkSession.getActiveSession().sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
