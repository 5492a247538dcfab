"""Search plans: time slices by market phase times term groups, resumable by key."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The term groups of a search, and (minutes, priority) of a slice by phase.
TERM_GROUPS = (
    "(nifty OR nifty50 OR #nifty50)",
    '(banknifty OR "bank nifty" OR #banknifty)',
    "(sensex OR #sensex OR NSE OR BSE)",
    "(#intraday OR intraday OR scalping)",
    '("option chain" OR "share market" OR "stock market india")',
    "(FII OR DII OR expiry OR #expiryday)",
    "(#optionstrading OR #optionselling OR #trading) (nifty OR sensex)",
    "(reliance OR infosys OR tcs OR hdfcbank OR icicibank)",
    "(#stockmarket OR #sharemarket OR #investing) india",
)
WEEKEND, CASH, EXTENDED, NIGHT = (120, 3), (30, 0), (60, 1), (120, 2)
IST_SECONDS = 19_800
HEADROOM = 1.3


def phase(epoch: Column) -> Column:
    """struct<width,priority> of a slice that starts at an epoch second, in exchange time."""
    local = epoch + IST_SECONDS
    weekday = F.pmod(F.floor(local / 86_400) + 3, F.lit(7))  # day 0 was a Thursday
    minute = F.floor(F.pmod(local, F.lit(86_400)) / 60)

    def of(pair: tuple[int, int]) -> Column:
        return F.struct(F.lit(pair[0]).cast("bigint").alias("width"), F.lit(pair[1]).alias("priority"))

    return F.when(weekday >= 5, of(WEEKEND)).when((minute >= 555) & (minute < 930), of(CASH)).when((minute >= 420) & (minute < 1140), of(EXTENDED)).otherwise(of(NIGHT))


def slices(spark: SparkSession, now: datetime, hours_back: int = 24) -> DataFrame:
    """(start, end, priority) in epoch seconds: each slice starts where the one before ends, and its width
    depends on the phase there. The walk is a fold over a bounded sequence in one row."""
    end = F.lit(int(now.timestamp()))
    steps = F.sequence(F.lit(1), F.lit(max(1, hours_back * 2 + 2)))  # the narrowest slice is half an hour
    kind = "array<struct<start:bigint,end:bigint,priority:int>>"
    state = F.struct((end - hours_back * 3600).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))

    def step(s: Column, _: Column) -> Column:
        p = phase(s["at"])
        stop = F.least(s["at"] + p["width"] * 60, end.cast("bigint"))
        one = F.array(F.struct(s["at"].alias("start"), stop.alias("end"), p["priority"].alias("priority")))
        return F.when(s["at"] >= end, s).otherwise(F.struct(stop.alias("at"), F.concat(s["out"], one).alias("out")))

    row = spark.range(1).select(F.explode(F.aggregate(steps, state, step, lambda s: s["out"])).alias("s"))
    return row.select("s.*")


def plan(spark: SparkSession, now: datetime, hours_back: int = 24, groups: tuple[str, ...] = TERM_GROUPS, grid_minutes: int = 0) -> DataFrame:
    """Slices times groups with text, key and place in the order of fetching: priority, latest first, group.

    grid_minutes: align the end of the plan to a clock grid, so that a rerun gives the same keys."""
    if grid_minutes:
        now -= timedelta(seconds=now.timestamp() % (grid_minutes * 60))
    names = spark.createDataFrame([(i, g) for i, g in enumerate(groups)], "group_ord int, group string")
    rows = slices(spark, now, hours_back).crossJoin(F.broadcast(names))  # a day's slices times a fixed handful
    rows = rows.withColumns({
        "text": F.format_string("%s since_time:%d until_time:%d", "group", "start", "end"),
        "key": F.concat_ws("|", "group", F.col("start").cast("string")),
    })
    return rows.withColumn("place", F.row_number().over(Window.orderBy("priority", F.desc("start"), "group_ord")))


def pending(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned rows whose key is not among the done ones."""
    return planned.join(done.select("key"), "key", "left_anti")


def group_yield(results: DataFrame, hours: int = 1) -> DataFrame:
    """(group, n, projected): results per group in a measured stretch, carried on to a day with headroom."""
    return results.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumn("projected", F.col("n") * (24.0 / hours * HEADROOM))


def union_distinct(*results: DataFrame, key: str = "tweet_id") -> DataFrame:
    """Overlapping results as one, each key once."""
    every = results[0]
    for r in results[1:]:
        every = every.unionByName(r)
    return every.dropDuplicates([key])


def duplicate_yield(results: DataFrame, key: str = "tweet_id", by: str = "group") -> DataFrame:
    n = results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_distinct"))
    return n.withColumn("duplicate_share", 1 - F.col("n_distinct") / F.col("n"))
