import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tempograin.operators.interpolate import degree_of, interpolate, interpolate_at, interpolate_point, knots_of


def exact(knots, t, degree, cubic=False):
    """The method by rational numbers."""
    xs = sorted(knots)
    n, w = len(xs), min(degree + 1, len(xs))
    if cubic and n >= 4 and not xs[0] <= t <= xs[-1]:
        return Fraction(knots[xs[0] if t < xs[0] else xs[-1]])
    start = max(0, min(sum(x <= t for x in xs) - w // 2, n - w))
    k = xs[start : start + w]
    total = Fraction(0)
    for j in k:
        term = Fraction(knots[j])
        for m in k:
            if m != j:
                term *= Fraction(t - m, j - m)
        total += term
    return total


def table(spark, points):
    return spark.createDataFrame([(t, float(v), i) for i, (t, v) in enumerate(points)], "ts long, value double, seq long")


WAVE = [(0, 0), (10, 10), (20, 0), (30, 10)]


@pytest.mark.parametrize("points,at,method,bound,expected", [
    (WAVE, 5, "linear", None, 5), (WAVE, -50, "cubic", None, 0), (WAVE, 80, "cubic", None, 10), (WAVE[:3], 5, "quadratic", None, 7.5), (WAVE, 1000, 3, 0.5, 15),
    ([(0, 1), (10, 2), (0, 3)], 0, "linear", None, 3), ([(4, 9)], 77, "cubic", None, 9),
])
def test_vectors(spark, points, at, method, bound, expected):
    assert interpolate_point(table(spark, points), at, method, bound=bound).first()["value"] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("method", ["linear", "quadratic", "cubic", 5, 8])
def test_against_rationals_in_any_chunks(spark, method):
    rnd = random.Random(7)
    knots = {rnd.randint(0, 2000): rnd.randint(-50, 50) for _ in range(40)}
    k = spark.createDataFrame([(t, float(v)) for t, v in knots.items()], "ts long, value double")
    grid = spark.createDataFrame([(t,) for t in range(-20, 2020, 13)], "ts long")
    for chunk in (97, 1 << 30):
        for r in interpolate_at(k, grid, method, chunk=chunk).collect():
            want = float(exact(knots, r["ts"], degree_of(method), method == "cubic"))
            assert r["value"] == pytest.approx(want, rel=1e-6, abs=1e-6)
            lo, hi = min(knots), max(knots)
            assert r["kind"] == ("raw" if r["ts"] in knots else "interpolated" if lo <= r["ts"] <= hi else "extrapolated")


def test_grid_is_anchored_at_start_and_margin_limits_knots(spark):
    d = table(spark, [(t, 2 * t) for t in range(0, 210, 10)])
    got = {r["ts"]: (r["value"], r["kind"]) for r in interpolate(d, "1s", "linear", start=95, end=105, margin=20, unit="s").collect()}
    assert got[97][0] == pytest.approx(194) and [t for t, v in got.items() if v[1] == "raw"] == [100]
    near = interpolate(d, "1s", "linear", start=95, end=105, margin=0, unit="s").where("ts = 95").first()
    assert near["kind"] == "extrapolated" and near["value"] == pytest.approx(200)
    assert interpolate(d, "1s", "linear", start=195, end=300, unit="s", beyond=False).agg(F.max("ts")).first()[0] == 200
    assert [r["ts"] for r in interpolate(d, "7s", "linear", start=3, end=20, unit="s").orderBy("ts").collect()] == [3, 10, 17]


def test_no_knots_and_nulls(spark):
    d = table(spark, [(0, 1), (10, 2)])
    assert interpolate(d.withColumn("value", F.lit(None).cast("double")), "1s", unit="s").count() == 0
    assert knots_of(d.withColumn("value", F.when(F.col("ts") == 0, F.col("value")))).count() == 1
    with pytest.raises(ValueError):
        degree_of("septic")
