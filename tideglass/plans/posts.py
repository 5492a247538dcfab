"""Posts and prices derived from the `events` table by expressions that any SQL engine shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = (
    "nifty 24500 CE loaded, target hit",
    "banknifty 52000 PE loaded now",
    "market is not bullish here",
    "strong short covering in nifty",
    "23900 will come #CRASH",
    "spot 24530, expiry tomorrow",
    "join my telegram for breakout calls",
    "Q1FY25 revenue up 12% yoy, margin higher",
    "sebi order on dividend and buyback",
    "vix down, pcr higher, max pain 24400",
    "never sell in panic, buy on dips",
    "FII selling again, weak close https://t.co/abc#x",
    "@trader gap up expected, long above 24600",
    "don't short this, uptrend is strong",
    "crash crash crash! exit longs",
    "DII buying supports the fall",
    "sideways day, no view",
    "subscribe now: sure shot calls, paid group",
    "bull run continues, ATH soon $NIFTY $TCS",
    "closing auction will decide, cas print",
    "breakdown below 24000 pe, bears in control",
    "hold, do not exit. recovery likely",
    "results beat, target achieved",
    "52 week high in tcs, 25000ce 25500 CE",
)
EMOJI_TEMPLATES = ("🚀🚀🚀🚀🚀 to the moon", "📉 and 🔴 day", "❤️ market", "plain words", "🔥 breakout 24500 ce", "#निफ्टी तेज 📈")
LANGS = {"click": "en", "view": "en", "purchase": "hi", "signup": "hi", "error": "und"}


def posts(spark: SparkSession, sf_dir: str, templates: tuple[str, ...] = TEMPLATES) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lang = F.element_at(F.create_map(*(F.lit(x) for p in LANGS.items() for x in p)), F.col("event_type"))
    return e.select(
        (F.col("event_id") + 1).alias("tweet_id"), F.col("ts").cast("timestamp").alias("created_at"), "user_id", F.concat(F.lit("u"), F.col("user_id")).alias("username"),
        (F.col("user_id") * 7919 % 100003).cast("int").alias("followers"), F.floor("value").cast("int").alias("like_count"),
        *((F.col("event_id") % m).cast("int").alias(c) for c, m in (("retweet_count", 7), ("reply_count", 5), ("quote_count", 3))),
        (F.col("event_id") % 10 == 0).alias("is_retweet"),
        F.element_at(F.array(*(F.lit(t) for t in templates)), (F.col("event_id") * 31 % len(templates) + 1).cast("int")).alias("content"),
        lang.alias("lang"), "event_type",
    )


def prices(spark: SparkSession, sf_dir: str, minutes: int = 15) -> DataFrame:
    """Last purchase value in each window."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
    at = F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes")["start"]
    return e.groupBy(at.alias("bar_ts")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def posts_sql(templates: tuple[str, ...] = TEMPLATES) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in LANGS.items())
    listed = ", ".join(map(quoted, templates))
    return f"""posts AS (SELECT event_id + 1 AS tweet_id, ts AS created_at, user_id, 'u' || user_id AS username, CAST(user_id * 7919 % 100003 AS INTEGER) AS followers, CAST(floor(value) AS INTEGER) AS like_count,
  CAST(event_id % 7 AS INTEGER) AS retweet_count, CAST(event_id % 5 AS INTEGER) AS reply_count, CAST(event_id % 3 AS INTEGER) AS quote_count, event_id % 10 = 0 AS is_retweet,
  ([{listed}])[event_id * 31 % {len(templates)} + 1] AS content, CASE event_type {cases} END AS lang, event_type FROM events)"""


def prices_sql(minutes: int = 15) -> str:
    return f"prices AS (SELECT time_bucket(INTERVAL '{minutes} minutes', ts) AS bar_ts, max_by(value, (ts, event_id)) AS close FROM events WHERE event_type = 'purchase' GROUP BY 1)"
