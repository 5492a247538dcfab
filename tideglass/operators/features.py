"""Per-post features and the composite weight."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.functions.lexicon import add_score, content_class

# Interaction weights, discounts and the ceiling of evidence and reach.
FULL_EVIDENCE, PROMO_FACTOR, CLASS_FACTOR, RETWEET_FACTOR, REACH = 3, 0.4, 0.3, 0.7, 1_000_000


def single(x: Column) -> Column:
    """Round to a 32-bit float, keep as double."""
    return x.cast("float").cast("double")


def engagement(likes: Column, retweets: Column, replies: Column, quotes: Column) -> Column:
    return F.ln(1 + likes + 2.0 * retweets + 3.0 * replies + 3.0 * quotes)


def authority(followers: Column) -> Column:
    return F.least(F.ln(1.0 + followers), F.lit(math.log1p(REACH)))


def confidence(evidence: Column, is_promo: Column, kind: Column, is_retweet: Column) -> Column:
    x = F.least(evidence, F.lit(FULL_EVIDENCE)) / float(FULL_EVIDENCE)
    x = x * F.when(is_promo, PROMO_FACTOR).otherwise(1.0)
    x = x * F.when(kind.isin("earnings", "corporate_action"), CLASS_FACTOR).otherwise(1.0)
    return F.least(F.greatest(x * F.when(is_retweet, RETWEET_FACTOR).otherwise(1.0), F.lit(0.0)), F.lit(1.0))


def add_features(posts: DataFrame, text: str = "content") -> DataFrame:
    """Adds polarity, evidence, is_promo, content_class, engagement, authority and confidence."""
    df = add_score(posts, text).withColumn("content_class", content_class(F.col(text)))
    return df.withColumns({
        "polarity": single(F.col("polarity")),
        "evidence": F.col("evidence").cast("short"),
        "engagement": single(engagement(*(F.col(c) for c in ("like_count", "retweet_count", "reply_count", "quote_count")))),
        "authority": single(authority(F.col("followers"))),
        "confidence": single(confidence(F.col("evidence"), F.col("is_promo"), F.col("content_class"), F.col("is_retweet"))),
    })


def add_weight(features: DataFrame) -> DataFrame:
    """Adds weight: confidence, raised up to twofold each by engagement and by authority, relative to the
    highest of the whole table. The maxima are one row, broadcast."""
    top = features.agg(F.max("engagement").alias("__e"), F.max("authority").alias("__a"))

    def tilt(x: str, most: str) -> Column:
        return 1.0 + F.when(F.col(most) > 0, F.col(x) / F.col(most)).otherwise(0.0)

    joined = features.join(F.broadcast(top))
    return joined.withColumn("weight", F.col("confidence") * tilt("engagement", "__e") * tilt("authority", "__a")).drop("__e", "__a")
