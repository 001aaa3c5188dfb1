"""Session helpers for tests, the bench and ad-hoc use.

Library functions never change session configuration; only these helpers,
which build a session for local runs, set anything.
"""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "pliego") -> SparkSession:
    """A local session tuned for the small test scales (UI off, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PLIEGO_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}  # folder of an application without a shared one


def local_folder(spark: SparkSession) -> str:
    """A temporary folder, one for each application, for a local master that names no shared folder (tests).

    On a cluster a folder of one machine would be private to it, so that is an error.
    """
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='pliego-')}"
    return _LOCAL[app]


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The checkpoint directory is read from the session (``spark.checkpoint.dir``
    or the context's checkpoint dir); the session is not changed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or local_folder(spark)
    return "/".join([root.rstrip("/"), "pliego", *parts, uuid.uuid4().hex])
