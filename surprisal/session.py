"""A session with the settings that the plans here expect."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "surprisal", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir; unset, a local master gets one below its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found or spark.conf.get('spark.sql.warehouse.dir')}/texts/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}")
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it lies, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [*known, root] if x)
    return spark
