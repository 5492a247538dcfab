import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tideglass.operators import validate
from tideglass.plans import run
from tideglass.sources import files, sinks

START = datetime(2026, 8, 4, 4, 0, tzinfo=timezone.utc)
TEXTS = ("nifty breakout, long above {n} ce", "banknifty weak, exit longs near {n}", "never sell in panic, buy on dips {n}", "sideways day, no view on {n}")


def lines():
    rows = []
    for i in range(240):
        at = START + timedelta(minutes=2 * i)
        word = "".join(chr(97 + i // 26**k % 26) for k in range(3))
        rows.append({"id": i + 1, "date": at.isoformat(), "rawContent": f"{TEXTS[i % 4].format(n=24000 + i)} {word * 2} {word[::-1]} {word}x", "user": {"id": i % 30, "username": f"u{i % 30}", "followersCount": 10 * i}, "likeCount": i % 50})
    rows += [rows[5], rows[9] | {"id": 900, "rawContent": rows[9]["rawContent"] + " https://t.co/q"}, rows[3] | {"id": 901, "date": (START - timedelta(days=3)).isoformat()}]
    return [json.dumps(r) for r in rows] + ["broken {", "", json.dumps({"id": 5})]


def test_from_lines_to_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines()) + "\n")
    counts = run.process(spark, str(tmp_path / "in"), str(tmp_path / "store"), START + timedelta(hours=12))
    assert (counts["malformed"], counts["unusable"], counts["late"], counts["exact_dupes"], counts["near_dupes"], counts["written"]) == (1, 1, 1, 1, 1, 240)
    again = run.process(spark, str(tmp_path / "in"), str(tmp_path / "store"), START + timedelta(hours=12))
    assert again == counts and files.read_store(spark, str(tmp_path / "store")).count() == 240
    prices = spark.range(60).select((F.lit(START.timestamp()) + F.col("id") * 900).cast("timestamp").alias("bar_ts"), (100 + F.sin("id")).alias("close"))
    prices.write.parquet(str(tmp_path / "prices"))
    found = run.analyse(spark, str(tmp_path / "store"), str(tmp_path / "out"), files.read_prices(spark, str(tmp_path / "prices")), resamples=50)
    stored = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert stored == json.loads(json.dumps(found)) and stored["n_tweets"] == 240 and stored["n_unique_authors"] == 30 and sum(stored["content_classes"].values()) == 240
    assert stored["n_buckets_live"] >= 10 and [v["horizon_minutes"] for v in stored["validation"]] == [15, 30, 60] and stored["tfidf_shape"][0] == 240
    report = (tmp_path / "out" / "report.md").read_text()
    assert report.count("\n| ") > stored["n_buckets_live"] and "240" in report
    assert spark.read.parquet(str(tmp_path / "out" / "signals.parquet")).count() == stored["n_buckets"]
    assert "bucket_start_ist" in spark.read.option("header", True).csv(str(tmp_path / "out" / "signals.csv")).columns


def test_small_sinks_and_lines(spark, tmp_path):
    sinks.append_json_lines(spark.createDataFrame([(1, "a")], "id long, t string"), str(tmp_path / "j"))
    sinks.append_json_lines(spark.createDataFrame([(2, "b")], "id long, t string"), str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"t":"a"}', '{"id":2,"t":"b"}']
    row = spark.createDataFrame([(15, 16, -0.2264, 0.04, -0.2, 0.5, 0.5, 0.28, 0.72)], "horizon_minutes int, n long, pearson_r double, pearson_p double, spearman_r double, spearman_p double, hit_rate double, hit_low double, hit_high double")
    assert row.select(validate.result_line().alias("l")).first()["l"].startswith("h= 15m  n= 16  pearson=-0.226 (p=0.040, significant)")
    at = spark.createDataFrame([("2026-08-04 09:15:00",)], "t string").select(validate.exchange_to_utc(F.col("t").cast("timestamp")).cast("string").alias("u")).first()["u"]
    assert at == "2026-08-04 03:45:00"


def test_too_few_live_buckets_give_no_rows(spark):
    signals = spark.createDataFrame([(START + timedelta(minutes=15 * i), False, 0.1 * i) for i in range(4)], "bucket_start timestamp, sparse boolean, signal double")
    prices = spark.createDataFrame([(START + timedelta(minutes=15 * i), 100.0 + i) for i in range(40)], "bar_ts timestamp, close double")
    assert validate.validate(signals, prices, in_hours=False).count() == 0
    assert validate.validate(signals, prices, in_hours=False, least=3).count() > 0
