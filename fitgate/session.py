"""Session defaults used by the tests, the bench and the command line, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "fitgate", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with adaptive execution on; local unless the submit command names a master. What that command sets stays as it is."""
    conf = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("FITGATE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    given = SparkConf()
    builder = SparkSession.builder
    for key, value in conf.items():
        if key in extra or not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors see.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster that is an error, because
    executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="fitgate-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
