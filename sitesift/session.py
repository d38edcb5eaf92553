"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "sitesift", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="sitesift-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the checkpoint folder, for written tables and stream state."""
    return f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_and_read(frame: DataFrame, purpose: str) -> DataFrame:
    """Materialise once as Parquet in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner real sizes.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, purpose)
    frame.write.mode("errorifexists").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
