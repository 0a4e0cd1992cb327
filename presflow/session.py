"""Session factory and the small amount of session state the engine relies on."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(app: str = "presflow", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # a checkpoint goes when nothing refers to it any more
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is not installed (local runs, shared folders)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def checkpoints(spark: SparkSession) -> SparkSession:
    """Sees to a folder for checkpoints: the session's spark.checkpoint.dir.

    Where that is unset, a session of one machine (tests) gets a local folder; a cluster's executors could not read one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="presflow-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, as a path."""
    return checkpoints(spark).sparkContext._jsc.sc().getCheckpointDir().get()
