import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideglass.functions.stats import student_p, wilson
from tideglass.operators import planner, series, validate
from tideglass.operators import signal as sg


def bounds(spark, k, n):
    r = spark.createDataFrame([(k, n)], "k long, n long").select(wilson(F.col("k"), F.col("n")).alias("w")).first()["w"]
    return r["low"], r["high"]


def test_wilson(spark):
    assert bounds(spark, 0, 0) == (0.0, 1.0)
    low, high = bounds(spark, 10, 10)
    assert 0 < low < 1 and high == 1.0
    assert bounds(spark, 50, 100)[0] > bounds(spark, 5, 10)[0]
    for k, n in ((3, 4), (36, 75), (67, 127)):
        p, z = k / n, 1.96
        d = 1 + z * z / n
        half = z / d * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        assert bounds(spark, k, n) == pytest.approx(((p + z * z / (2 * n)) / d - half, (p + z * z / (2 * n)) / d + half))


# r, n and two-sided p of published results
@pytest.mark.parametrize("r,n", [(-0.226, 16), (-0.153, 16), (-0.039, 15), (0.5, 3), (0.5, 4), (0.9, 5), (0.1, 40)])
def test_student_p_by_integration(spark, r, n):
    v = n - 2
    t = abs(r) * math.sqrt(v / (1 - r * r))
    x = np.linspace(0, t, 200_001)
    y = math.gamma((v + 1) / 2) / math.sqrt(v * math.pi) / math.gamma(v / 2) * (1 + x * x / v) ** (-(v + 1) / 2)
    want = 1 - 2 * float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))
    got = spark.createDataFrame([(r, n)], "r double, n long").select(student_p(F.col("r"), F.col("n"))).first()[0]
    assert got == pytest.approx(want, abs=1e-8)


def test_student_p_ends(spark):
    rows = spark.createDataFrame([(1.0, 9), (None, 9), (0.0, 9), (0.3, 2)], "r double, n long").select(student_p(F.col("r"), F.col("n"))).collect()
    assert rows[0][0] == 0.0 and rows[1][0] is None and rows[2][0] == pytest.approx(1.0) and rows[3][0] is None


@pytest.mark.parametrize("method", [sg.bootstrap, sg.poisson_bootstrap])
def test_bootstrap_brackets_and_narrows(spark, method):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(v), 1.0 + i % 3) for g, n in ((1, 30), (2, 800)) for i, v in enumerate(rng.normal(0.2, 0.5, n))]
    df = spark.createDataFrame(rows, "g long, i long, v double, w double")
    found = {r["g"]: (r["ci_low"], r["ci_high"]) for r in method(df, "g", "v", "w", "i", resamples=300).collect()}
    means = {g: sum(v * w for a, _, v, w in rows if a == g) / sum(w for a, _, _, w in rows if a == g) for g in (1, 2)}
    assert all(found[g][0] < means[g] < found[g][1] for g in (1, 2))
    assert found[2][1] - found[2][0] < found[1][1] - found[1][0]


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0.0)], "g long, i long, v double, w double")
    assert sg.bootstrap(df, "g", "v", "w", "i", resamples=5).count() == 0


def test_asof_edges(spark):
    t = datetime(2026, 1, 5, 0, 10)
    left = spark.createDataFrame([(i, t + timedelta(minutes=m)) for i, m in enumerate((0, 15, 16, -1))], "i int, ts timestamp")
    right = spark.createDataFrame([(t, 1.0), (t - timedelta(minutes=12), 2.0), (t + timedelta(minutes=1), None)], "at timestamp, v double")
    got = {r["i"]: r["v"] for r in validate.asof_join(left, right, "ts", "at", ["v"], 900).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: None, 3: 2.0}


def test_returns_over_a_zero_close(spark):
    t = datetime(2026, 1, 5)
    rows = [(t + timedelta(minutes=15 * i), c) for i, c in enumerate((1.0, 0.0, 2.0, 4.0))]
    got = [r["fwd_ret"] for r in validate.forward_returns(spark.createDataFrame(rows, "bar_ts timestamp, close double"), 15).orderBy("bar_ts").collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(math.log(2)) and got[3] is None


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "x double, y double")
    r = validate.correlation(df, "x", "y").first()
    assert r["pearson_r"] is None and r["pearson_p"] is None and r["n"] == 6


def test_market_hours(spark):
    rows = [(datetime(2026, 8, 7, 10, 0), True), (datetime(2026, 8, 7, 10, 1), False), (datetime(2026, 8, 8, 6, 0), False), (datetime(2026, 8, 7, 3, 45), True), (datetime(2026, 8, 7, 3, 44), False)]
    df = spark.createDataFrame(rows, "ts timestamp, want boolean").withColumn("got", validate.market_hours(F.col("ts")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_triangles():
    rng = np.random.default_rng(2)
    x, y = np.arange(5000.0), rng.normal(size=5000)
    y[1234] = 50
    kept = series.largest_triangles(x, y, 100)
    assert len(kept) == 100 and kept[0] == 0 and kept[-1] == 4999 and 1234 in kept and (np.diff(kept) >= 0).all()
    assert len(series.largest_triangles(x[:50], y[:50], 50)) == 50 and len(series.largest_triangles(x, y, 2)) == 5000
    for n in range(4, 40):
        for k in range(3, n):
            assert len(series.largest_triangles(np.arange(float(n)), rng.normal(size=n), k)) == k


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 0.5, 1.0, 9.99, 10.0, 99.0)], "v double")
    h = [r["n"] for r in series.histogram(df, F.col("v"), 10, 0.0, 10.0).orderBy("bin").collect()]
    assert h == [3, 1, 0, 0, 0, 0, 0, 0, 0, 3]
    empty = series.histogram(df.limit(0), F.col("v"), 4).orderBy("bin").collect()
    assert [r["n"] for r in empty] == [0] * 4 and empty[-1]["hi"] == 1.0


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (sorted(r["k"] for r in series.bottom_k(x, "k", 50).collect()) for x in (df, df.repartition(5)))
    assert a == b and len(set(a)) == 50 and series.bottom_k(df.limit(7), "k", 50).count() == 7


def test_plan_grid_gives_equal_keys(spark):
    now = datetime.fromisoformat("2026-08-04T10:07:31+00:00")
    a, b = (sorted(r["key"] for r in planner.plan(spark, n, 24, grid_minutes=30).collect()) for n in (now, now + timedelta(seconds=61)))
    assert a == b
    p = planner.plan(spark, now, 24).orderBy("place").collect()
    assert p[0]["priority"] == 0 and len({r["key"] for r in p}) == len(p) and max(r["end"] for r in p) == int(now.timestamp())
