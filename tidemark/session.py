"""Session helpers.  The library never starts its own cluster; it only fills in what is unset."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC and adaptive execution; ``master`` only matters outside a cluster."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Makes sure checkpoints have a folder that all executors share, and names it.

    That is the one the cluster names in ``spark.checkpoint.dir``; a fresh local one is set only where none is, and never on a cluster.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
            found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(found)
    return sc.getCheckpointDir()
