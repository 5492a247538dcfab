"""Time buckets: composite signal, intervals, corpus summary, mergeable sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, IntegralType, StructField, StructType

from tideglass.functions import draws
from tideglass.functions.stats import wilson
from tideglass.operators.features import add_weight


def bucket_of(ts: Column, minutes: int) -> Column:
    """Start of the tumbling bucket, aligned to the epoch."""
    return F.window(ts, f"{minutes} minutes")["start"]


def bucket_signal(features: DataFrame, minutes: int = 15, min_posts: int = 5, min_scoreable: int = 3, ts: str = "created_at") -> DataFrame:
    """One row per bucket that has posts; statistics are null where it is sparse.

    Features are read once: buckets keep the sums out of which the global maxima can be applied later."""
    return signals_of_sums(mergeable_sums(features, minutes, ts), min_posts, min_scoreable)


LOTS, GROUPS = 8, 1024


def _of_rows(values: DataFrame, by: str, value: str, weight: str, order: str, keep: Column | None, *more: Column) -> DataFrame:
    """The columns that resampling needs. Python drops the rows not kept: a filter would be pushed below the
    scores and compute them again."""
    kept = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    return values.select(F.col(by).alias("by"), F.col(value).cast("double").alias("value"), F.col(weight).cast("double").alias("weight"), F.col(order).alias("order"), kept.alias("keep"), *more)


def _interval(means: DataFrame, by: str, level: float) -> DataFrame:
    a = (1 - level) / 2
    ends = means.where("m is not null").groupBy("by").agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return ends.select(F.col("by").alias(by), F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def _floats(column) -> np.ndarray:
    return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)


def bootstrap(values: DataFrame, by: str, value: str, weight: str, order: str, resamples: int = 1000, level: float = 0.95, seed: int = 42, keep: Column | None = None) -> DataFrame:
    """(by, ci_low, ci_high): percentile interval of the weighted mean, drawing n of n with replacement.

    Draw i of replicate r takes the row that md5(seed:group:r:i) names, so results do not depend on
    partitions. A group's rows go to LOTS tasks, each with its share of the replicates, which draws from
    arrays: a task holds one group's values, and no draw is a row."""
    rows = _of_rows(values, by, value, weight, order, keep, F.concat_ws(":", F.lit(seed).cast("string"), F.col(by).cast("string")).alias("head"))
    lots = min(LOTS, resamples)

    def dealt(batches):
        for batch in batches:
            batch = batch.filter(batch.column("keep"))
            for lot in range(lots):
                yield batch.append_column("lot", pa.array(np.full(batch.num_rows, lot, np.int32)))

    def means(key, group):
        group = group.sort_by([("order", "ascending")])
        lot = key[0].as_py()
        replicates = range(resamples * lot // lots, resamples * (lot + 1) // lots)
        found = draws.resampled(group.column("head")[0].as_py(), _floats(group.column("value")), _floats(group.column("weight")), replicates)
        return pa.table({"by": pa.array([group.column("by")[0].as_py()] * len(found), group.schema.field("by").type), "m": pa.array(found, pa.float64())})

    kind = rows.schema["by"].dataType
    lots_of = rows.mapInArrow(dealt, StructType([*rows.schema.fields, StructField("lot", IntegerType())]))
    parts = max(3 * rows.sparkSession.sparkContext.defaultParallelism, 12)  # by number: few bytes are much work
    each = lots_of.repartition(parts, "lot", "head").groupBy("lot", "head").applyInArrow(means, StructType([StructField("by", kind), StructField("m", DoubleType())]))
    return _interval(each, by, level)


def poisson_bootstrap(values: DataFrame, by: str, value: str, weight: str, order: str, resamples: int = 1000, level: float = 0.95, seed: int = 42, keep: Column | None = None) -> DataFrame:
    """As bootstrap, but each row enters each replicate a Poisson(1) number of times: no join, one pass,
    for groups of any size. A task sums up each group's replicates and hands on two numbers for each."""
    rows = _of_rows(values, by, value, weight, order, keep, F.xxhash64(F.lit(seed), F.col(by)).alias("seed"))
    whole = isinstance(rows.schema["order"].dataType, IntegralType)
    rows = rows.withColumn("order", F.coalesce(F.col("order").cast("bigint") if whole else F.xxhash64("order"), F.lit(0).cast("bigint")))
    kind = rows.schema["by"].dataType

    def sums(batches):
        found, arrow = {}, None
        for batch in batches:
            batch = batch.filter(batch.column("keep"))
            arrow = batch.schema.field("by").type
            groups = batch.column("by").dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy()
            places = np.argsort(codes, kind="stable")
            starts = np.searchsorted(codes[places], np.arange(len(groups.dictionary) + 1))
            v, w = _floats(batch.column("value")), _floats(batch.column("weight"))
            keys, seeds = batch.column("order").to_numpy(), batch.column("seed").to_numpy()
            for k, name in enumerate(groups.dictionary.to_pylist()):
                at = places[starts[k] : starts[k + 1]]
                found[name] = found.get(name, 0) + draws.poisson_sums(seeds[at[0]], v[at], w[at], keys[at], resamples)
                if len(found) == GROUPS:
                    yield packed(found, arrow)
                    found = {}
        if found:
            yield packed(found, arrow)

    def packed(found, arrow):
        top, below = (pa.array([x[:, i] for x in found.values()], pa.list_(pa.float64())) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(list(found), arrow), top, below], names=["by", "top", "below"])

    numbers = ArrayType(DoubleType())
    parts = rows.mapInArrow(sums, StructType([StructField("by", kind), StructField("top", numbers), StructField("below", numbers)]))
    each = parts.select("by", F.posexplode(F.arrays_zip("top", "below")).alias("r", "s"))
    means = each.groupBy("by", "r").agg((F.sum("s.top") / F.nullif(F.sum("s.below"), F.lit(0.0))).alias("m"))
    return _interval(means, by, level)


def signal_with_intervals(features: DataFrame, minutes: int = 15, resamples: int = 1000, **options) -> DataFrame:
    """Bucket signals with their bootstrap interval and the bucket's start in exchange time."""
    signals = bucket_signal(features, minutes, **options)
    rows = add_weight(features).withColumn("b", F.unix_timestamp(bucket_of(F.col("created_at"), minutes)))
    ends = poisson_bootstrap(rows, "b", "polarity", "weight", "tweet_id", resamples, keep=F.col("evidence") > 0)
    out = signals.withColumn("b", F.unix_timestamp("bucket_start")).join(ends, "b", "left").drop("b")
    out = out.withColumns({c: F.when(~F.col("sparse"), F.col(c)) for c in ("ci_low", "ci_high")})  # sparse buckets have none
    return out.withColumn("bucket_start_ist", F.from_utc_timestamp("bucket_start", "Asia/Kolkata"))


def live_span(signals: DataFrame) -> DataFrame:
    """One row: first and last bucket that is not sparse (null without any), and how many there are."""
    live = F.when(~F.col("sparse"), F.col("bucket_start"))
    return signals.agg(F.min(live).alias("first_live"), F.max(live).alias("last_live"), F.count(live).alias("n_live"))


def excludes_zero(low: str = "ci_low", high: str = "ci_high") -> Column:
    return (F.col(low) > 0) | (F.col(high) < 0)


def mergeable_sums(features: DataFrame, minutes: int = 15, ts: str = "created_at") -> DataFrame:
    """Per bucket the counts, the eight sums and the running maxima, from which the signal under any later
    global maximum follows: both tilts multiplied out. Sums of two tables add up."""
    scored = F.col("evidence") > 0
    c, e, a, p = (F.col(x) for x in ("confidence", "engagement", "authority", "polarity"))
    terms = {"c": c, "ce": c * e, "ca": c * a, "cea": c * e * a}
    sums = [F.sum(F.when(scored, t)).alias(f"s_{k}") for k, t in terms.items()] + [F.sum(F.when(scored, p * t)).alias(f"s_p{k}") for k, t in terms.items()]
    return features.groupBy(bucket_of(F.col(ts), minutes).alias("bucket_start")).agg(
        F.count(F.lit(1)).alias("n_tweets"), F.count_if(scored).alias("n_scoreable"),
        F.count_if(scored & (p > 0)).alias("n_bull"), F.count_if(scored & (p != 0)).alias("n_dir"),
        F.sum(e).alias("s_engagement"), F.max(e).alias("max_e"), F.max(a).alias("max_a"), *sums,
    )


def weighted_mean_of_sums(sums: DataFrame) -> DataFrame:
    """Adds signal: the weighted mean polarity under the maxima of all rows; 0 where no weight is."""
    top = sums.agg(F.max("max_e").alias("__e"), F.max("max_a").alias("__a"))

    def one(x: str) -> Column:
        return F.when(F.col(x) > 0, 1 / F.col(x)).otherwise(0.0)

    def total(p: str) -> Column:
        return F.col(f"s_{p}c") + F.col(f"s_{p}ce") * one("__e") + F.col(f"s_{p}ca") * one("__a") + F.col(f"s_{p}cea") * one("__e") * one("__a")

    joined = sums.join(F.broadcast(top))  # one row
    return joined.withColumn("signal", F.coalesce(F.try_divide(total("p"), total("")), F.lit(0.0))).drop("__e", "__a")


def signals_of_sums(sums: DataFrame, min_posts: int = 5, min_scoreable: int = 3) -> DataFrame:
    sparse = (F.col("n_tweets") < min_posts) | (F.col("n_scoreable") < min_scoreable)
    interval = wilson(F.col("n_bull"), F.col("n_dir"))

    def live(x: Column) -> Column:
        return F.when(~sparse, x)

    return weighted_mean_of_sums(sums).select(
        "bucket_start", "n_tweets", "n_scoreable", live(F.col("signal")).alias("signal"),
        live(F.try_divide(F.col("n_bull").cast("double"), F.col("n_dir").cast("double"))).alias("bull_share"),
        live(interval["low"]).alias("bull_ci_low"), live(interval["high"]).alias("bull_ci_high"),
        (F.col("s_engagement") / F.col("n_tweets")).alias("mean_engagement"), sparse.alias("sparse"),
    )


def class_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("content_class").agg(F.count(F.lit(1)).alias("n"))


def corpus_summary(features: DataFrame, approximate: bool = False) -> DataFrame:
    authors = F.approx_count_distinct("username") if approximate else F.count_distinct("username")
    share = lambda c: F.avg(c.cast("int"))
    return features.agg(F.count(F.lit(1)).alias("n_tweets"), authors.alias("n_unique_authors"), share(F.col("evidence") > 0).alias("pct_scoreable"), share(F.col("is_promo")).alias("pct_promotional"), F.avg("polarity").alias("mean_polarity"))
