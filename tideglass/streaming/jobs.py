"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tideglass.operators.dedup import bands, greedy_survivors, signatures
from tideglass.functions.text import dedup_form, shingles
from tideglass.session import new_path


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000, kind: str = "parquet") -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)


def first_within(posts: DataFrame, key: str = "tweet_id", ts: str = "created_at", late: str = "24 hours") -> DataFrame:
    """Exact dedup with state that the watermark bounds."""
    return posts.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def bucket_counts(features: DataFrame, minutes: int = 15, late: str = "24 hours", ts: str = "created_at") -> DataFrame:
    """Tumbling windows of counts and of the sums that a signal is made of."""
    scored = F.col("evidence") > 0
    return features.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n_tweets"), F.count_if(scored).alias("n_scoreable"), F.sum(F.when(scored, F.col("polarity") * F.col("confidence"))).alias("pc"), F.sum(F.when(scored, F.col("confidence"))).alias("c")).select(F.col("window.start").alias("bucket_start"), "n_tweets", "n_scoreable", "pc", "c")


def histogram_counts(values: DataFrame, value: Column, bins: int, low: float, high: float) -> DataFrame:
    """Counts by bin, for complete or update mode."""
    clipped = F.least(F.greatest(value.cast("double"), F.lit(low)), F.lit(high))
    return values.groupBy(F.least(F.width_bucket(clipped, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fixed_window(posts: DataFrame, cutoff, ts: str = "created_at") -> DataFrame:
    """The fixed cutoff of a run: older rows are counted as `late` by the observation `window` and dropped."""
    return posts.observe("window", F.count_if(F.col(ts) < F.lit(cutoff)).alias("late"), F.count(F.lit(1)).alias("rows")).where(F.col(ts) >= F.lit(cutoff))


class NearDedupSink:
    """foreachBatch target: appends the rows that are no near duplicates of kept ones, and their buckets.

    Rows of a batch first meet the table of kept buckets, then each other in order. A batch that is
    replayed after a failure overwrites its own folders, so it counts once."""

    def __init__(self, path: str, text: str = "content", order: str = "tweet_id", permutations: int = 64, n_bands: int = 8, n_rows: int = 8, k: int = 3):
        self.path, self.text, self.order = path, text, order
        self.permutations, self.n_bands, self.n_rows, self.k = permutations, n_bands, n_rows, k

    def kept_buckets(self, spark: SparkSession, before: int) -> DataFrame:
        empty = spark.createDataFrame([], "bucket bigint, batch bigint")
        from pyspark.errors import AnalysisException

        try:
            return spark.read.schema(empty.schema).parquet(f"{self.path}/buckets").where(F.col("batch") < before)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__s", shingles(dedup_form(F.col(self.text)), self.k))
        buckets = bands(signatures(rows, self.order, "__s", self.permutations), self.order, self.n_bands, self.n_rows)
        known = self.kept_buckets(spark, number).select("bucket").distinct()
        taken = buckets.join(known, "bucket", "left_semi").select(self.order).distinct()
        stay = greedy_survivors(buckets.join(taken, self.order, "left_anti"), self.order)
        batch.join(stay, self.order, "left_semi").write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        buckets.join(stay, self.order, "left_semi").select("bucket").write.mode("overwrite").parquet(f"{self.path}/buckets/batch={number}")


class StallListener(StreamingQueryListener):
    """Stops a query after `patience` batches without rows."""

    def __init__(self, spark: SparkSession, patience: int = 3):
        self.spark, self.patience, self.empty = spark, patience, {}

    def onQueryStarted(self, event):
        self.empty[event.id] = 0

    def onQueryProgress(self, event):
        p = event.progress
        self.empty[p.id] = self.empty.get(p.id, 0) + 1 if p.numInputRows == 0 else 0
        self._stop_if_stalled(p.id)

    def onQueryIdle(self, event):
        self.empty[event.id] = self.empty.get(event.id, 0) + 1
        self._stop_if_stalled(event.id)

    def onQueryTerminated(self, event):
        self.empty.pop(event.id, None)

    def _stop_if_stalled(self, query_id):
        if self.empty.get(query_id, 0) >= self.patience and (q := self.spark.streams.get(str(query_id))) is not None:
            q.stop()


def run_to_table(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Runs over what is available now, into a table in the shared folder; nothing goes to the driver.

    Each batch of an appending or updating query has a folder of its own, which a replay overwrites; a complete
    result replaces the one before it."""
    spark = stream.sparkSession
    at = new_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).trigger(availableNow=True)
    query: StreamingQuery = writer.option("checkpointLocation", checkpoint or f"{at}/checkpoint").start()
    query.awaitTermination()
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/batch=*")
