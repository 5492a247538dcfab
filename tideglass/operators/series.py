"""Series: gaps, downsampling, histograms, samples, figure frames."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideglass.operators.signal import excludes_zero


def gap_breaks(points: DataFrame, ts: str, values: list[str], by: tuple[str, ...] = (), factor: float = 1.5) -> DataFrame:
    """The points, with a row of null values (is_break) before each that lies further than factor times the
    median distance from the one before; none where the median is 0."""
    w = Window.partitionBy(*by).orderBy(ts)
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(ts).over(w).cast("timestamp"))
    gaps = points.withColumn("gap", gap)
    if by:
        usual = gaps.groupBy(*by).agg(F.median("gap").alias("usual"))
        joined = gaps.join(usual, list(by))
    else:
        joined = gaps.join(F.broadcast(gaps.agg(F.median("gap").alias("usual"))))
    wide = (F.col("usual") > 0) & (F.col("gap") > F.col("usual") * factor)
    flags = F.when(F.coalesce(wide, F.lit(False)), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    rows = joined.withColumn("is_break", F.explode(flags))
    return rows.select(*by, ts, "is_break", *(F.when(~F.col("is_break"), F.col(v)).alias(v) for v in values))


def every_nth(points: DataFrame, step: int, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return points.withColumn("__place", place).where(F.col("__place") % step == 0).drop("__place")


def largest_triangles(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Places of the points that largest-triangle-three-buckets keeps. Interior points are dealt to
    threshold - 2 buckets of equal real width; each keeps the point whose triangle with the last kept
    point and the next bucket's mean is largest (the first of equals); an empty one repeats the last."""
    n = len(x)
    if threshold >= n or threshold < 3:
        return np.arange(n)
    width = (n - 2) / (threshold - 2)
    edges = np.floor(np.arange(threshold) * width).astype(np.int64) + 1
    edges[: threshold - 1] = np.minimum(edges[: threshold - 1], n - 1)
    edges[-1] = min(edges[-1], n)
    sums_x, sums_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    kept = [0]
    for lo, hi, far in zip(edges[:-2], edges[1:-1], edges[2:], strict=True):
        last = kept[-1]
        if hi <= lo:
            kept.append(last)
            continue
        start, end = (hi, min(far, n)) if far > hi else (n - 1, n)
        cx, cy = (sums_x[end] - sums_x[start]) / (end - start), (sums_y[end] - sums_y[start]) / (end - start)
        twice = (x[last] - cx) * (y[lo:hi] - y[last]) - (x[last] - x[lo:hi]) * (cy - y[last])
        kept.append(int(lo + np.abs(twice).argmax()))
    return np.array([*kept, n - 1])


def lttb(points: DataFrame, threshold: int, series: str = "series_id") -> DataFrame:
    """(series, x, y) downsampled per series, which is the unit of parallelism: choices follow one another,
    so one long series is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable").reset_index(drop=True)
        return pdf.iloc[largest_triangles(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), threshold)]

    frame = points.select(series, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return frame.groupBy(series).applyInPandas(run, frame.schema)


def histogram(values: DataFrame, value: Column, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, lo, hi, n) for every bin. Outliers fall into the end bins and the last edge is closed; without a
    range it is that of the data; no values give zeros on [0, 1]."""
    rows = values.select(value.cast("double").alias("v")).where("v is not null")
    if low is None or high is None:
        ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        low, high = (0.0, 1.0) if ends["a"] is None else (ends["a"], ends["b"])
        low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    clipped = F.least(F.greatest("v", F.lit(low)), F.lit(high))
    at = F.least(F.width_bucket(clipped, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    counts = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin"))
    step = (high - low) / bins
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.lit(low) + (F.col("bin") - 1) * step).alias("lo"), (F.lit(low) + F.col("bin") * step).alias("hi"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def engagement_histogram(posts: DataFrame, bins: int = 40, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Of ln(1 + likes + 2 retweets + 3 replies); adds each bin's centre."""
    x = F.ln(1 + F.col("like_count") + 2.0 * F.col("retweet_count") + 3.0 * F.col("reply_count"))
    return histogram(posts, x, bins, low, high).withColumn("centre", (F.col("lo") + F.col("hi")) / 2)


def bottom_k(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """A uniform sample of k rows: those with the least hash of (seed, key). Mergeable, so it also serves streams."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.orderBy(draw, key).limit(k)


def first_n(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """At most n rows of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= n).drop("__n")


def signal_figure(signals: DataFrame) -> DataFrame:
    """Live buckets with breaks over gaps, volume, and a mark where the interval leaves zero out."""
    live = signals.where("not sparse").withColumn("significant", excludes_zero())
    return gap_breaks(live, "bucket_start", ["signal", "ci_low", "ci_high", "n_tweets", "significant"])


def bull_share_figure(signals: DataFrame) -> DataFrame:
    return signals.where("not sparse and bull_share is not null").select("bucket_start", "bull_share", (F.col("bull_share") - F.col("bull_ci_low")).alias("err_low"), (F.col("bull_ci_high") - F.col("bull_share")).alias("err_high"))


def spike_demo(spark, n: int = 100_000, threshold: int = 500, spike: int = 50_137) -> DataFrame:
    """(method, x, y): a noisy sine with one spike, by triangles and by every nth point."""
    noise = (F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 1000.0 * 0.05
    points = spark.range(n).select(F.lit("demo").alias("series_id"), F.col("id").cast("double").alias("x"), F.when(F.col("id") == spike, 8.0).otherwise(F.sin(F.col("id") / 500.0) + noise).alias("y"))
    one = lttb(points, threshold).select(F.lit("lttb").alias("method"), "x", "y")
    return one.unionByName(every_nth(points, n // threshold, "x").select(F.lit("every_nth").alias("method"), "x", "y"))
