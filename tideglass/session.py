"""Session settings, the shared folder and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tideglass", master: str | None = None, **conf) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword with __ for dots."""
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. In local mode only, where the session names none,
    the working folder serves; elsewhere executors could not read what another one wrote."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("spark-checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write a frame as a table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a read, not a recomputation."""
    at = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt to every core by a hash of the key: a small file is one split, however much each row costs."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(3 * context.defaultParallelism, 12), key)
