"""Session settings that the jobs expect.

Nothing here sizes a cluster: shuffle parallelism comes from the deployment and
AQE coalesces or splits it.  Only semantics (time zone) and adaptive execution
are pinned.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


_THROW_AWAY: dict[str, str] = {}


def local_session(cores: int | str = 8, name: str = "spendlake") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    The cluster names it in ``spark.checkpoint.dir``.  Where that setting is
    absent, a session in one process uses a throw-away folder, as in tests; a
    cluster raises, since its machines would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if master not in _THROW_AWAY:
            _THROW_AWAY[master] = tempfile.mkdtemp(prefix="spendlake-")
        path = _THROW_AWAY[master]
    spark.sparkContext.setCheckpointDir(path)
    return path
