import random

import pytest
from pyspark.sql import functions as F

from tempograin.operators.fill import fill, fill_method
from tempograin.operators.reduce import aggregation, coarsen, downsample, finish, merge, partials, rebucket
from tempograin.operators.sketch import bins, gamma, merge_bins, quantile_bins, sketch_quantiles, uniform_quantiles


def series(spark, points):
    return spark.createDataFrame([(t, float(v), i) for i, (t, v) in enumerate(points)], "ts long, value double, seq long").withColumn("value", F.col("value").cast("decimal(18,2)"))


def rows(df, *cols):
    return [tuple(None if x is None else round(float(x), 6) for x in r) for r in df.orderBy("bucket").select(*cols).collect()]


def test_streaming_aggregations(spark):
    d = downsample(series(spark, [(0, 10), (30, 20), (60, 30), (90, 5)]), "minutes", ["min", "max", "avg", "sum", "first", "last"], unit="s")
    assert rows(d, "bucket", "count", "min", "max", "avg", "sum", "first", "last") == [(0, 2, 10, 20, 15, 30, 10, 20), (60, 2, 5, 30, 17.5, 35, 30, 5)]


def test_ties_go_by_arrival(spark):
    d = downsample(series(spark, [(0, 1), (0, 2), (5, 3), (5, 4)]), "minutes", ["first", "last"], unit="s")
    assert rows(d, "first", "last") == [(1, 4)]


def test_percentiles(spark):
    d = downsample(series(spark, [(i, i + 1) for i in range(10)]), "minutes", ["p50", "p90", "p95", "p99"], unit="s")
    assert rows(d, "p50", "p90", "p95", "p99") == [(5, 9, 10, 10)]


@pytest.mark.parametrize("points,agg,expected", [
    ([(0, 10), (30, 20), (60, 5)], "twa", 15), ([(0, 10), (30, 20), (60, 5)], "twa_linear", 13.75),
    ([(0, 0), (7, 7), (63, 63), (100, 100)], "twa_linear", 50), ([(0, 0), (60, 100)], "twa_bucket_end", 98.333333), ([(0, 0), (60, 100)], "twa", 0), ([(5, 7)], "twa", 7),
])
def test_time_weighted(spark, points, agg, expected):
    assert rows(downsample(series(spark, points), "hours", [agg], unit="s"), agg) == [(expected,)]


def test_nulls_empty_and_unknown(spark):
    d = series(spark, [(0, 1), (1, 2)]).withColumn("value", F.when(F.col("ts") == 0, F.col("value")))
    assert rows(downsample(d, "minutes", ["min"], unit="s"), "count", "min") == [(1, 1)]
    assert downsample(d.where("false"), "minutes", unit="s").count() == 0
    with pytest.raises(ValueError):
        downsample(d, "minutes", ["mode"])
    assert aggregation("Median") == "p50" and aggregation("mean") == "avg" and aggregation("x") is None


def test_partials_equal_one_pass_in_any_order(spark):
    rnd = random.Random(5)
    d = series(spark, [(rnd.randint(-5000, 20_000), rnd.randint(-500, 500) / 4) for _ in range(400)])
    aggs = ["min", "max", "sum", "avg", "first", "last"]
    whole = rows(downsample(d, "1m", aggs, unit="s"), "bucket", "count", *aggs)
    parts = [partials(d.where(F.col("seq") % 3 == k), "1m", unit="s") for k in (2, 0, 1)]
    assert rows(finish(merge(parts[0].unionByName(parts[1]).unionByName(parts[2])), "1m", aggs, unit="s"), "bucket", "count", *aggs) == whole
    assert rows(finish(coarsen(partials(d, "1m", unit="s"), 7), "7m", aggs, unit="s"), "bucket", "count", *aggs) == rows(downsample(d, "7m", aggs, unit="s"), "bucket", "count", *aggs)
    assert rows(finish(rebucket(partials(d, "1m", unit="s"), "1m", "1h"), "1h", aggs, unit="s"), "bucket", "count", *aggs) == rows(downsample(d, "1h", aggs, unit="s"), "bucket", "count", *aggs)
    assert rebucket(partials(d, "1h", unit="s"), "1h", "90m") is None


def test_sketches_bound_the_error(spark):
    rnd = random.Random(3)
    values = [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-3, 5) for _ in range(1500)] + [0.0] * 20
    d = spark.createDataFrame([(1, v) for v in values], "g int, value double")
    q = {"a": 0.05, "b": 0.5, "c": 0.99}
    got = sketch_quantiles(d, ["g"], q).first()
    for name, p in q.items():
        exact = sorted(values)[max(1, -(-int(p * 1_000_000) * len(values) // 1_000_000)) - 1]
        assert abs(got[name] - exact) <= 0.0101 * abs(exact)
    half = merge_bins(bins(d.where("value < 3"), ["g"]).unionByName(bins(d.where("value >= 3"), ["g"])), ["g"])
    assert quantile_bins(half, ["g"], q).first() == quantile_bins(bins(d, ["g"]), ["g"], q).first()
    u = uniform_quantiles(d, ["g"], q, most=64).first()
    assert u["collapses"] > 0 and abs(u["c"] - sorted(values)[int(0.99 * len(values))]) <= 1.05 * u["accuracy"] * abs(u["c"]) * gamma()


BASE = [(0, 10), (30, 10), (60, 20), (240, 50)]


@pytest.mark.parametrize("method,expected", [("null", [None, None]), ("prev", [20, 20]), ("linear", [30, 40]), (-1.5, [-1.5, -1.5])])
def test_fill(spark, method, expected):
    d = fill(downsample(series(spark, BASE), "1m", ["avg"], unit="s"), "1m", method, ["avg"], unit="s")
    assert rows(d, "bucket", "count", "avg") == [(0, 2, 10), (60, 1, 20), (120, 0, expected[0]), (180, 0, expected[1]), (240, 1, 50)]


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_fill_bounds(spark, chunk):
    d = downsample(series(spark, BASE), "1m", ["avg"], unit="s")
    linear = rows(fill(d, "1m", "linear", ["avg"], start=-120, end=410, unit="s", chunk=chunk), "avg")
    assert len(linear) == 9 and linear[0] == linear[1] == linear[-1] == (None,)
    assert rows(fill(d, "1m", "prev", ["avg"], start=-120, end=410, unit="s", chunk=chunk), "avg")[-1] == (50,)
    assert rows(fill(d, "1m", "linear", ["avg"], start=150, end=170, unit="s", chunk=chunk), "bucket", "count", "avg") == [(120, 0, 30)]
    assert fill(d, "1m", "prev", ["avg"], start=500, end=400, unit="s").count() == 0
    with pytest.raises(ValueError):
        fill(d, "1m", "prev", ["avg"], start=0, end=10**9, unit="s", most=100)


def test_fill_tokens():
    assert fill_method("LOCF") == "prev" and fill_method("-1.5") == -1.5 and fill_method("nan") is None and fill_method("x") is None
