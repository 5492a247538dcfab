"""Raw posts (JSON lines) to the clean-post schema, with a status for every line."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideglass.functions.text import nfkc, tidy

CLEAN_SCHEMA = T.StructType([
    T.StructField("tweet_id", T.LongType()), T.StructField("created_at", T.TimestampType()), T.StructField("username", T.StringType()), T.StructField("user_id", T.LongType()), T.StructField("followers", T.IntegerType()),
    T.StructField("content", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("reply_count", T.IntegerType()), T.StructField("retweet_count", T.IntegerType()), T.StructField("like_count", T.IntegerType()), T.StructField("quote_count", T.IntegerType()), T.StructField("view_count", T.LongType()),
    T.StructField("hashtags", T.ArrayType(T.StringType())), T.StructField("cashtags", T.ArrayType(T.StringType())), T.StructField("mentions", T.ArrayType(T.StringType())),
    T.StructField("is_retweet", T.BooleanType()), T.StructField("is_reply", T.BooleanType()), T.StructField("is_quote", T.BooleanType()), T.StructField("verified", T.BooleanType()), T.StructField("conversation_id", T.LongType()),
])
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _present(v: Column, path: str) -> Column:
    """A value that is there and is not JSON's null."""
    x = _get(v, path, "variant")
    return x.isNotNull() & ~F.is_variant_null(x)


def _text(v: Column, path: str, default: str) -> Column:
    return F.coalesce(F.nullif(_get(v, path, "string"), F.lit("")), F.lit(default))


def _number(v: Column, path: str, kind: str = "bigint") -> Column:
    return F.coalesce(_get(v, path, kind), F.lit(0).cast(kind))


def _strings(v: Column, path: str) -> Column:
    found = F.coalesce(_get(v, path, "array<string>"), F.array().cast("array<string>"))
    return F.filter(found, lambda x: x.isNotNull() & (x != ""))


def _usernames(v: Column, path: str) -> Column:
    """Names out of user objects, or bare strings."""
    items = F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))
    names = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.try_variant_get(x, "$.username", "string")))
    return F.filter(names, lambda x: x.isNotNull() & (x != ""))


def timestamp(text: Column) -> Column:
    """ISO timestamps; without an offset they are UTC; anything else is null."""
    return F.when(F.rlike(text, F.lit(ISO)), F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp"))


def normalised(df: DataFrame, column: str) -> DataFrame:
    """Normalises a text column in one pass. Python gets the texts that are not ASCII; for the others, which
    NFKC leaves as they are, it gets a null."""
    text = F.coalesce(F.col(column), F.lit(""))
    folded = nfkc(F.when(F.rlike(text, F.lit(r"[^\x{0}-\x{7f}]")), text))
    return df.withColumn(column, tidy(F.coalesce(folded, text)))


def decode(lines: DataFrame) -> DataFrame:
    """`value` lines to (ingest columns, raw VARIANT, status): blank lines go, bad JSON is `malformed`."""
    kept = lines.where(F.trim("value") != "")
    raw = F.try_parse_json(F.trim("value"))
    return kept.withColumn("raw", raw).withColumn("status", F.when(F.col("raw").isNull(), "malformed").otherwise("parsed"))


def project(decoded: DataFrame) -> DataFrame:
    """The clean projection. Rows without an id, a timestamp or text get status `unusable` and stay for counting."""
    v = F.col("raw")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    rows = decoded.withColumns({
        "tweet_id": _get(v, "$.id", "bigint"),
        "created_at": F.when(F.schema_of_variant(_get(v, "$.date", "variant")) == "STRING", timestamp(_get(v, "$.date", "string"))),
        "username": _text(v, "$.user.username", ""),
        "user_id": _number(v, "$.user.id"),
        "followers": _number(v, "$.user.followersCount", "int"),
        "content": _text(v, "$.rawContent", ""),
        "lang": _text(v, "$.lang", "und"),
        "reply_count": _number(v, "$.replyCount", "int"),
        "retweet_count": _number(v, "$.retweetCount", "int"),
        "like_count": _number(v, "$.likeCount", "int"),
        "quote_count": _number(v, "$.quoteCount", "int"),
        "view_count": _number(v, "$.viewCount"),
        "hashtags": F.transform(_strings(v, "$.hashtags"), F.lower),
        "cashtags": F.transform(_strings(v, "$.cashtags"), F.upper),
        "mentions": _usernames(v, "$.mentionedUsers"),
        "is_retweet": _present(v, "$.retweetedTweet"),
        "is_reply": _present(v, "$.inReplyToTweetId"),
        "is_quote": F.coalesce(_get(v, "$.isQuoteStatus", "boolean"), F.lit(False)),
        "verified": F.coalesce(_get(v, "$.user.verified", "boolean"), F.lit(False)) | F.coalesce(_get(v, "$.user.blue", "boolean"), F.lit(False)),
        "conversation_id": _number(v, "$.conversationId"),
        "is_object": F.coalesce(is_object, F.lit(False)),
    })
    rows = normalised(rows, "content")
    usable = F.col("is_object") & F.coalesce(F.col("tweet_id") != 0, F.lit(False)) & F.col("created_at").isNotNull() & (F.col("content") != "")
    return rows.withColumn("status", F.when(F.col("status") == "malformed", "malformed").when(usable, "clean").otherwise("unusable")).drop("is_object")


def clean(lines: DataFrame) -> DataFrame:
    """Lines to clean posts with `status` in clean, unusable, malformed; other columns of `lines` stay."""
    return project(decode(lines)).drop("raw", "value")


def clean_only(lines: DataFrame) -> DataFrame:
    return clean(lines).where("status = 'clean'").select(*CLEAN_SCHEMA.fieldNames())


def trailing_window(posts: DataFrame, now: datetime, hours: int, column: str = "created_at") -> DataFrame:
    """Posts not older than `hours` before `now`; 0 keeps all."""
    return posts.where(F.col(column) >= F.lit(now - timedelta(hours=hours))) if hours > 0 else posts


def run_counters(cleaned: DataFrame, cutoff: datetime | None = None) -> DataFrame:
    """One row: lines, malformed, unusable, out_of_window, clean."""
    late = (F.col("status") == "clean") & (F.col("created_at") < F.lit(cutoff)) if cutoff else F.lit(False)
    return cleaned.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("status") == "malformed").alias("malformed"),
        F.count_if(F.col("status") == "unusable").alias("unusable"),
        F.count_if(late).alias("out_of_window"),
        F.count_if((F.col("status") == "clean") & ~late).alias("clean"),
    )


def partition_columns(posts: DataFrame, column: str = "created_at") -> DataFrame:
    return posts.withColumns({"date": F.date_format(column, "yyyy-MM-dd"), "hour": F.date_format(column, "HH")})


def permalink_record(elements: DataFrame) -> DataFrame:
    """Scraped elements (permalink, created, text, reply, retweet, like) to the raw-post columns."""
    from tideglass.functions import text as t

    content = F.col("text")
    return elements.select(
        t.last_segment(F.col("permalink")).try_cast("bigint").alias("id"),
        timestamp(F.col("created")).alias("date"),
        content.alias("rawContent"),
        t.nth_segment(F.col("permalink"), 4).alias("username"),
        *(t.abbreviated_count(F.col(c)).alias(f"{c}_count") for c in ("reply", "retweet", "like")),
        F.lit(0).cast("bigint").alias("quote_count"),
        F.lit(0).cast("bigint").alias("view_count"),
        t.hashtags(content).alias("hashtags"),
        t.cashtags(content).alias("cashtags"),
        t.mentions(content).alias("mentions"),
        F.lit("und").alias("lang"),
    ).where("id is not null and rawContent <> ''")
