"""Session settings that the library's plans expect."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "ratefield", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; what the caller sets goes before these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    return builder.config(map=base | conf).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only where that is unset, and all runs in one process, to a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ratefield-checkpoints-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    context.setCheckpointDir(found)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name below the one that the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/ratefield/{name}-{uuid.uuid4().hex}"
