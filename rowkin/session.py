"""Session settings that fit the engine's plans."""

from __future__ import annotations

import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is left to the cluster."""
    builder = SparkSession.builder.appName("rowkin").config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(context: SparkContext) -> str:
    """``spark.checkpoint.dir``; where that is unset a temporary folder in local mode, and an error on a cluster."""
    path = context.getConf().get("spark.checkpoint.dir")
    if not path and context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or f"file://{tempfile.gettempdir()}/rowkin-shared").rstrip("/")
