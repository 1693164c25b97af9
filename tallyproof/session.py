"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", *, app: str = "tallyproof", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder."""
    return shared_dir(spark, uuid.uuid4().hex)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder below the cluster's shared checkpoint folder.

    Only where the session names none and runs on one machine is a local temporary folder taken, and the session
    told of it. On a cluster executors would not see such a folder, so there the setting is required.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="tallyproof-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return f"{root.rstrip('/')}/tallyproof/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Used for small aggregates that several later steps read: the data rows are then scanned once whatever the
    later plan looks like, a lost executor costs no rescan, and the planner knows the size of the table.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
