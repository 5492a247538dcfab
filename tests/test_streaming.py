import json

from pyspark.sql import functions as F

from tideglass.operators import clean, dedup
from tideglass.sources.replay import ReplaySource
from tideglass.streaming import jobs

BASE = "sure shot intraday tip buy now huge profit guaranteed daily calls accuracy ninety percent limited seats"


def test_replay_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(ReplaySource)
    for n in range(3):
        rows = [{"id": n * 10 + i + 1, "date": "2026-08-04T06:00:00Z", "rawContent": f"post {i} nifty", "user": {"id": 1}} for i in range(4)]
        (tmp_path / f"f{n}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nbroken\n")
    path = str(tmp_path / "*.jsonl")
    batch = clean.clean_only(spark.read.format("replay").option("path", path).load())
    assert batch.count() == 12
    assert spark.read.format("replay").option("path", path).option("query", "post 1").load().count() == 3
    stream = spark.readStream.format("replay").option("path", path).load()
    q = stream.writeStream.format("memory").queryName("replayed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("replayed").count() == 12


def test_near_dedup_over_batches(spark, tmp_path):
    rows = [(1, BASE), (2, BASE + " https://t.co/x"), (3, "nifty support at 24400 looks strong today"), (4, BASE + " https://t.co/y")]
    sink = jobs.NearDedupSink(str(tmp_path / "kept"))
    for n, part in enumerate((rows[:2], rows[2:])):
        sink(spark.createDataFrame(part, "tweet_id long, content string"), n)
    sink(spark.createDataFrame(rows[2:], "tweet_id long, content string"), 1)  # replayed batch
    assert sorted(r["tweet_id"] for r in spark.read.parquet(str(tmp_path / "kept/rows")).collect()) == [1, 3]


def test_fixed_window_and_counts(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("created_at"), F.lit(1).alias("evidence"), F.lit(0.5).alias("polarity"), F.lit(1.0).alias("confidence"))
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    s = jobs.file_stream(spark, str(tmp_path / "in"), events.schema)
    got = jobs.run_to_table(jobs.bucket_counts(s, 360), "counts_360", mode="update")
    assert got.agg(F.sum("n_tweets")).first()[0] == events.count()


def test_first_of_each_key(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "tweet_id long, ingest_seq long, content string")
    assert {(r["tweet_id"], r["content"]) for r in dedup.first_of_each(df).collect()} == {(1, "a"), (2, "c")}
