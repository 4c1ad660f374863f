"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

UNSET = ""


def local_session(cores: str = "8", shuffle_partitions: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimscope")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session, or the
    checkpoint folder set on its context.

    Only a session inside one process may fall back to a temporary folder of its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", UNSET) or UNSET
    if not named:
        on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = on_context.get() if on_context.isDefined() else UNSET
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.gettempdir()


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    path = os.path.join(shared_folder(spark), f"claimscope-{label}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete everything below the paths this process has asked for: at the end of a job,
    when no DataFrame that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
