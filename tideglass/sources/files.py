"""Readers: JSON lines with ingest order, the partitioned store with derived partition predicates, keys, prices."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideglass.operators.clean import CLEAN_SCHEMA


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, ingest_seq: the place of a line by file, block and position, whatever order tasks run in."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono"))
    # positions within a block follow one another, so ranks per block and counts of earlier blocks give the order
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = blocks.withColumn("before", F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)))
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy("file", "block").orderBy("mono")))
    return placed.join(before.drop("n"), ["file", "block"]).select("value", (F.coalesce("before", F.lit(0)) + F.col("place")).alias("ingest_seq"))


def read_store(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Stored posts with created_at in [start, end). The bounds are also put on `date`, which prunes directories."""
    rows = spark.read.parquet(path)
    for bound, after in ((start, True), (end, False)):
        if bound is None:
            continue
        day = F.lit(bound.strftime("%Y-%m-%d")).cast(rows.schema["date"].dataType)
        at = F.lit(bound)
        rows = rows.where((F.col("created_at") >= at) & (F.col("date") >= day)) if after else rows.where((F.col("created_at") < at) & (F.col("date") <= day))
    return rows


def from_records(spark: SparkSession, records: list[dict]) -> DataFrame:
    """In-memory clean posts under the declared schema."""
    return spark.createDataFrame(records, CLEAN_SCHEMA)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys of a checkpoint; none where it does not exist yet."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string")
    return lines.select(F.trim("value").alias("key")).where("key <> ''").distinct()


def read_prices(spark: SparkSession, path: str, ts: str = "bar_ts", close: str = "close", zone: str | None = None) -> DataFrame:
    """bar_ts (UTC), close; `zone` is where naive timestamps are from."""
    rows = spark.read.parquet(path)
    at = F.col(ts).cast("timestamp")
    return rows.select((F.to_utc_timestamp(at, zone) if zone else at).alias("bar_ts"), F.col(close).cast("double").alias("close"))
