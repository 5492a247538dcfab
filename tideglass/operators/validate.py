"""Signals against forward returns: as-of join, correlations with p values, hit rate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideglass.functions.stats import student_p, wilson

ZONE = "Asia/Kolkata"


def forward_returns(prices: DataFrame, horizon_minutes: int, bar_minutes: int = 15, by: tuple[str, ...] = (), same_session: bool = False) -> DataFrame:
    """Adds fwd_ret: log return to the close `horizon` bars ahead, by row; null for the last ones and
    where either close is 0.

    `by` names the instrument columns, which are the unit of parallelism. same_session: no return across dates."""
    steps = max(1, horizon_minutes // bar_minutes)
    w = Window.partitionBy(*by).orderBy("bar_ts")
    ahead = F.lead("close", steps).over(w)
    if same_session:
        ahead = F.when(F.lead(F.to_date("bar_ts"), steps).over(w) == F.to_date("bar_ts"), ahead)
    return prices.withColumn("fwd_ret", F.ln(F.try_divide(ahead, F.col("close"))))


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, values: list[str], tolerance_seconds: int, by: tuple[str, ...] = (), chunk_seconds: int = 86_400) -> DataFrame:
    """Each left row with `values` of the latest right row at or before it, within the tolerance (inclusive).

    One linear pass: both sides are united and sorted, and the last right row is carried on. Time is cut into
    chunks, which run in parallel; a right row also goes to the next chunk where it can still be reached."""
    if tolerance_seconds > chunk_seconds:
        raise ValueError("the tolerance must not pass a chunk")
    # microseconds since the epoch, so that the frame below is a plain range of numbers
    lt, rt = (F.unix_micros(F.col(x).cast("timestamp")) for x in (left_ts, right_ts))
    size = chunk_seconds * 1_000_000
    reach = tolerance_seconds * 1_000_000
    keep = left.columns
    one = left.select(F.struct(*keep).alias("l"), F.lit(None).cast(right.select(*values).schema).alias("v"), lt.alias("t"), *by, F.floor(lt / size).alias("chunk"))
    has = reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in values))
    chunks = F.array_distinct(F.array(F.floor(rt / size), F.floor((rt + reach) / size)))
    two = right.where(has).select(F.lit(None).cast(left.schema).alias("l"), F.struct(*values).alias("v"), rt.alias("t"), *by, F.explode(chunks).alias("chunk"))
    w = Window.partitionBy(*by, "chunk").orderBy("t").rangeBetween(-reach, 0)
    found = one.unionByName(two).withColumn("m", F.last("v", ignorenulls=True).over(w)).where("l is not null")
    return found.select("l.*", *(F.col(f"m.{v}").alias(v) for v in values))


def market_hours(ts: Column, zone: str = ZONE) -> Column:
    """Monday to Friday, 09:15 to 15:30 in the exchange's time, both ends in."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return (F.weekday(local) < 5) & minute.between(9 * 60 + 15, 15 * 60 + 30)


def to_exchange(ts: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def exchange_to_utc(ts: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def average_rank(df: DataFrame, column: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1; equal values share the mean of theirs."""
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, column))
    return df.withColumn(out, F.rank().over(Window.partitionBy(*by).orderBy(column)) + (peers - 1) / 2.0)


def safe_corr(x: str, y: str) -> Column:
    """Pearson's r; null where either side is constant or there are under two rows."""
    ok = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) > 0) & (F.coalesce(F.stddev_pop(y), F.lit(0.0)) > 0)
    cov = F.covar_pop(x, y)
    return F.when(ok, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))


def correlation(pairs: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, pearson_r, pearson_p, spearman_r, spearman_p, hits, hit_rate, hit_low, hit_high)."""
    ranked = average_rank(average_rank(pairs.dropna(subset=[x, y]), x, "__rx", by), y, "__ry", by)
    hit = F.signum(x) == F.signum(y)
    sums = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), safe_corr(x, y).alias("pearson_r"), safe_corr("__rx", "__ry").alias("spearman_r"), F.count_if(hit).alias("hits"))
    interval = wilson(F.col("hits"), F.col("n"))
    return sums.select(*by, "n", "pearson_r", student_p(F.col("pearson_r"), F.col("n")).alias("pearson_p"), "spearman_r", student_p(F.col("spearman_r"), F.col("n")).alias("spearman_p"), "hits", F.try_divide(F.col("hits").cast("double"), F.col("n").cast("double")).alias("hit_rate"), interval["low"].alias("hit_low"), interval["high"].alias("hit_high"))


def validate(signals: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (15, 30, 60), in_hours: bool = True, least: int = 5, tolerance_minutes: int = 15) -> DataFrame:
    """One row per horizon with at least `least` aligned buckets; none where fewer buckets are live."""
    live = signals.where("not sparse and signal is not null")
    live = live.where(market_hours(F.col("bucket_start"))) if in_hours else live
    enough = live.agg((F.count(F.lit(1)) >= least).alias("enough")).where("enough")  # one row or none
    live = live.select("bucket_start", "signal").join(F.broadcast(enough)).drop("enough")
    frames = [asof_join(live, forward_returns(prices, h).select("bar_ts", "fwd_ret"), "bucket_start", "bar_ts", ["fwd_ret"], tolerance_minutes * 60).withColumn("horizon_minutes", F.lit(h)) for h in horizons]
    return correlation(reduce(DataFrame.unionByName, frames), "signal", "fwd_ret", ("horizon_minutes",)).where(F.col("n") >= least)


def result_line() -> Column:
    """A readable line of a validation row."""
    verdict = F.when(F.col("pearson_p") < 0.05, "significant").otherwise("not significant")
    return F.format_string("h=%3dm  n=%3d  pearson=%+.3f (p=%.3f, %s)  spearman=%+.3f (p=%.3f)  hit=%.1f%% [%.1f%%, %.1f%%]", "horizon_minutes", "n", "pearson_r", "pearson_p", verdict, "spearman_r", "spearman_p", F.col("hit_rate") * 100, F.col("hit_low") * 100, F.col("hit_high") * 100)
