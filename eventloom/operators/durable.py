"""A cut of the lineage that survives lost executors, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master, which has no other machine, gets a private folder where the
    session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A copy in the session's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, size: int = 4_000_000) -> DataFrame:
    """``df``, its session set to send Python at most ``size`` bytes at once: by default 10,000 rows of any size go
    together. A lower bound of the session's stays."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH).rstrip("b")) > size:
        conf.set(BATCH, f"{size}b")
    return df
