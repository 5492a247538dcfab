import json
from datetime import datetime, timezone

from tideglass.operators import clean as cl

BASE = {"id": 7, "date": "2026-08-04T06:00:00+00:00", "rawContent": "hello", "user": {"id": 1, "username": "ann", "followersCount": 5}}


def cleaned(spark, *changes):
    lines = [json.dumps(BASE | c) if isinstance(c, dict) else c for c in changes]
    rows = cl.clean(spark.createDataFrame(list(enumerate(lines)), "i int, value string")).orderBy("i").collect()
    return {r["i"]: r for r in rows}


def test_usable_and_not(spark):
    r = cleaned(spark, {}, {"id": 0}, {"id": ""}, {"id": None}, {"id": "12"}, {"id": "abc"}, {"date": 5}, {"date": "2026"}, {"rawContent": " ​ "}, {"rawContent": None}, "{bad", "[1]", "   ")
    assert [r[i]["status"] for i in range(12)] == ["clean", "unusable", "unusable", "unusable", "clean", "unusable", "unusable", "unusable", "unusable", "unusable", "malformed", "unusable"]
    assert 12 not in r and r[4]["tweet_id"] == 12


def test_lenient_numbers(spark):
    r = cleaned(spark, {"likeCount": "1.5"}, {"likeCount": 1.7}, {"likeCount": True}, {"likeCount": None}, {"viewCount": "9"})
    assert [r[i]["like_count"] for i in range(4)] == [0, 1, 1, 0] and r[4]["view_count"] == 9


def test_times(spark):
    want = datetime(2026, 8, 4, 6, 0, tzinfo=timezone.utc).timestamp()
    r = cleaned(spark, {"date": "2026-08-04 06:00:00"}, {"date": "2026-08-04T11:30:00+05:30"}, {"date": "2026-08-04T06:00:00Z"})
    assert all(r[i]["created_at"].replace(tzinfo=timezone.utc).timestamp() == want for i in range(3))


def test_arrays_and_flags(spark):
    r = cleaned(
        spark,
        {"hashtags": ["Nifty", ""], "cashtags": ["tcs"], "mentionedUsers": [{"username": "bob"}, {"username": ""}, "eve"], "retweetedTweet": None},
        {"retweetedTweet": {"id": 1}, "inReplyToTweetId": 5, "isQuoteStatus": True, "user": None, "lang": None},
        {"user": {"username": "z", "blue": True}, "hashtags": None},
    )
    a, b, c = r[0], r[1], r[2]
    assert (a["hashtags"], a["cashtags"], a["mentions"], a["is_retweet"]) == (["nifty"], ["TCS"], ["bob", "eve"], False)
    assert (b["is_retweet"], b["is_reply"], b["is_quote"], b["username"], b["lang"], b["mentions"]) == (True, True, True, "", "und", [])
    assert c["verified"] and c["hashtags"] == []


def test_normalising(spark):
    r = cleaned(spark, {"rawContent": "ﬁne​  day\t\there\n\n\n\nnext "}, {"rawContent": "plain \t text"})
    assert r[0]["content"] == "fine day here\n\nnext" and r[1]["content"] == "plain text"


def test_counters(spark):
    lines = spark.createDataFrame([(json.dumps(BASE),), ("{",), (json.dumps(BASE | {"id": 0}),), (json.dumps(BASE | {"date": "2020-01-01"}),)], "value string")
    r = cl.run_counters(cl.clean(lines), datetime(2026, 1, 1, tzinfo=timezone.utc)).first()
    assert (r["lines"], r["malformed"], r["unusable"], r["out_of_window"], r["clean"]) == (4, 1, 1, 1, 1)


def test_store_round_trip_prunes(spark, tmp_path):
    from tideglass.sources.files import read_keys, read_lines, read_store
    from tideglass.sources.sinks import append_keys, write_store

    lines = spark.createDataFrame([(json.dumps(BASE | {"id": i, "date": f"2026-08-0{1 + i % 3}T06:00:00Z"}),) for i in range(1, 10)], "value string")
    posts = cl.clean_only(lines)
    out = str(tmp_path / "store")
    assert write_store(posts, out) == 9 and write_store(posts.limit(0), out) == 0
    part = read_store(spark, out, start=datetime(2026, 8, 2, tzinfo=timezone.utc), end=datetime(2026, 8, 3, tzinfo=timezone.utc))
    assert part.count() == 3
    assert "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().executedPlan().toString()
    assert write_store(posts.where("tweet_id < 3"), out, mode="replace") == 2
    assert read_store(spark, out).count() == 2 + 3
    keys = str(tmp_path / "keys")
    assert read_keys(spark, keys).count() == 0
    append_keys(spark.createDataFrame([("a|1",), ("b|2",)], "key string"), keys)
    append_keys(spark.createDataFrame([("a|1",)], "key string"), keys)
    assert read_keys(spark, keys).count() == 2
    (tmp_path / "x.jsonl").write_text("a\nb\nc\n")
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "x.jsonl")).orderBy("ingest_seq").collect()] == ["a", "b", "c"]
