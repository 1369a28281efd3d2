import pytest
from pyspark.sql import functions as F

from tempograin.functions.grid import Width, bucket, bucket_index, index_of, nests, panel_width, resolution


@pytest.mark.parametrize("token,nanos", [("5s", 5 * 10**9), ("15m", 900 * 10**9), ("250ms", 250 * 10**6), ("15 minutes", 900 * 10**9), ("1 hour", 3600 * 10**9), ("minutes", 60 * 10**9)])
def test_widths(token, nanos):
    assert Width.parse(token).nanos == nanos


@pytest.mark.parametrize("token", ["0s", "5", "5 parsecs", "", "s5"])
def test_bad_widths(token):
    assert Width.parse(token) is None


def test_resolution_names():
    assert resolution("Minute") == resolution("minutes") == resolution("m") == "minutes"
    assert resolution("fortnight") is None


def test_grid_around_the_epoch(spark):
    """Sub-second steps floor; coarser ones go toward zero, so bucket 0 has both sides of 1970."""
    seconds = [-3601, -3600, -3599, -1, 0, 1, 3599, 3600, 1007]
    df = spark.createDataFrame([(s,) for s in seconds], "ts long")
    got = [tuple(r) for r in df.select(bucket_index(F.col("ts"), "1h", "s"), bucket_index(F.col("ts"), "5s", "s")).collect()]
    hours = [-1, -1, 0, 0, 0, 0, 0, 1, 0]
    assert [g[0] for g in got] == hours
    assert got[3][1] == -1 and got[8][1] == 201
    assert [index_of(s, "1h", "s") for s in seconds] == hours
    micros = spark.createDataFrame([(-1,), (999,), (1000,)], "ts long").select(bucket_index(F.col("ts"), "1ms", "us")).collect()
    assert [r[0] for r in micros] == [-1, 0, 1]


def test_bucket_start_and_calendar(spark):
    day = 86_400
    df = spark.createDataFrame([(31 * day,), (366 * day,)], "ts long").select(bucket(F.col("ts"), "1mo", "s"), bucket(F.col("ts"), "1y", "s"))
    assert [tuple(r) for r in df.collect()] == [(30 * day, 0), (360 * day, 365 * day)]


def test_nesting_and_panels():
    assert nests("1h", "1d") and nests("5s", "15m") and not nests("1h", "90m") and not nests("500ms", "1s")
    assert panel_width(0, 86_400_000, 60_000, 100) == 864_000 and panel_width(5, 5) == 1
