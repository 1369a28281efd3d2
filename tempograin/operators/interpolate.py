"""Interpolation and extrapolation on a grid by local polynomials, with the provenance of each point.

The value at t is the Lagrange polynomial through the ``degree + 1`` knots around it, so each point needs its own few knots only:
knots are numbered, each window of knots is gathered under the number of its first, and grid points join the
window that is theirs.  The polynomial is an unrolled column expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import Width, div, width
from tempograin.operators.chunks import chunk_width, running_count, same_join

DEGREES = {"linear": 1, "quadratic": 2, "cubic": 3}
MOST_POINTS = 10_000_000
#: Ticks of a chunk by default: so many grid steps.
CHUNK_STEPS = 65_536


def degree_of(method: str | int) -> int:
    d = DEGREES.get(method) if isinstance(method, str) else int(method)
    if d is None or not 1 <= d <= 8:
        raise ValueError(f"no such method: {method!r}")
    return d


def knots_of(df: DataFrame, group: Sequence[str] = (), arrival: str = "seq", ts: str = "ts", value: str = "value") -> DataFrame:
    """One knot an instant, the last to arrive; nulls are no knots.  Values are the nearest doubles."""
    kept = df.where(F.col(value).isNotNull())
    v = F.max_by(F.col(value), F.col(arrival)) if arrival in df.columns else F.last(value)
    return kept.groupBy(*group, ts).agg(v.cast("double").alias("value")).withColumnRenamed(ts, "ts")


def interpolate_at(knots: DataFrame, grid: DataFrame, method: str | int = "cubic", group: Sequence[str] = (), bound: float | None = None, chunk: int | None = None) -> DataFrame:
    """``grid`` (group, ts) with value and kind (raw, interpolated, extrapolated) from ``knots`` (group, ts, value; unique in ts).

    With too few knots the degree falls to what they allow; a single knot is a constant; groups without knots give no rows.  Outside the
    knots the edge polynomial goes on, save that ``cubic`` keeps the edge value.  ``bound`` b clamps what lies outside to the knots' range widened
    by b times itself.  Chunks hold ``chunk`` ticks at most, and about as many knots each however dense these are.
    """
    size = degree_of(method) + 1
    both = knots.select(*group, "ts", F.col("value").cast("double").alias("v"), F.lit(0).alias("side")).unionByName(grid.select(*group, "ts", F.lit(None).cast("double").alias("v"), F.lit(1).alias("side")))
    totals = knots.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min(F.col("value").cast("double")).alias("low"), F.max(F.col("value").cast("double")).alias("high"))
    both = same_join(both, totals, group)
    cut = chunk_width(F.col("n"), F.col("first"), F.col("last"))
    cut = cut if chunk is None else F.least(cut, F.lit(chunk))
    both = running_count(both, group, ["ts", "side"], F.floor(F.col("ts") / cut), F.col("side") == 0, "a")
    w = F.least(F.lit(size), "n")
    own = both.where("side = 0").withColumn("i", F.col("a") - 1)
    shifts = own.select(*group, "ts", "v", F.explode(F.sequence(F.greatest(F.lit(0), F.col("i") - w + 1), F.least(F.col("i"), F.col("n") - w))).alias("start"))
    windows = shifts.groupBy(*group, "start").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("x"), F.col("v").alias("y")))).alias("k"))
    points = both.where("side = 1").withColumn("start", F.greatest(F.lit(0), F.least(F.col("a") - div(w, 2), F.col("n") - w)))
    met = same_join(points, windows, [*group, "start"])
    t = F.col("ts")
    outside = (t < F.col("first")) | (t > F.col("last"))
    hit = F.filter("k", lambda p: p["x"] == t)
    value = _lagrange(t, F.col("k"), size)
    if method == "cubic":
        edge = F.when(t < F.col("first"), F.element_at("k", 1)["y"]).otherwise(F.element_at("k", -1)["y"])
        value = F.when(outside & (F.col("n") >= size), edge).otherwise(value)
    if bound is not None:
        slack = F.lit(float(bound)) * (F.col("high") - F.col("low"))
        value = F.when(outside, F.least(F.greatest(value, F.col("low") - slack), F.col("high") + slack)).otherwise(value)
    value = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["y"]).otherwise(value)
    kind = F.when(F.size(hit) > 0, F.lit("raw")).when(outside, F.lit("extrapolated")).otherwise(F.lit("interpolated"))
    return met.select(*group, "ts", value.alias("value"), kind.alias("kind"))


def _lagrange(t: Column, k: Column, size: int) -> Column:
    """Sum over the window's knots of y times the product of (t - x') / (x - x'); differences are taken in integers."""
    n, total = F.size(k), F.lit(0.0)
    x = [F.get(k, F.lit(i))["x"] for i in range(size)]
    for j in range(size):
        term = F.get(k, F.lit(j))["y"]
        for m in range(size):
            if m != j:
                term = term * F.when(F.lit(max(m, j)) < n, (t - x[m]).cast("double") / (x[j] - x[m]).cast("double")).otherwise(F.lit(1.0))
        total = total + F.when(F.lit(j) < n, term).otherwise(F.lit(0.0))
    return total


def grid_of(spans: DataFrame, step: int, group: Sequence[str] = (), most: int = MOST_POINTS) -> DataFrame:
    """Instants from ``start`` to ``end`` (inclusive) every ``step``, anchored at start, for each row of ``spans`` (group, start, end)."""
    many = F.when((F.col("end") - F.col("start")) / step >= most, F.raise_error(F.lit(f"more than {most} grid points"))).otherwise(F.lit(True))
    return spans.where("start <= end").where(many).select(*group, F.explode(F.sequence("start", "end", F.lit(step).cast("long"))).alias("ts"))


def interpolate(df: DataFrame, step: Width | str, method: str | int = "cubic", group: Sequence[str] = (), start: int | None = None, end: int | None = None, margin: int | None = None, bound: float | None = None, unit: str = "us", arrival: str = "seq", beyond: bool = True) -> DataFrame:
    """The reconstructed series: group, ts, value, kind on the grid from ``start`` to ``end`` (by default the first and last sample).

    ``margin`` limits the knots to those within it of the range, as stored reads do.  Without ``beyond`` the grid ends at a series' last sample.
    """
    ticks = width(step).ticks(unit)
    knots = knots_of(df, group, arrival)
    if margin is not None:
        knots = knots.where(F.col("ts").between((start if start is not None else -(1 << 62)) - margin, (end if end is not None else 1 << 62) + margin))
    spans = knots.groupBy(*group).agg((F.min("ts") if start is None else F.min(F.lit(start).cast("long"))).alias("start"), (F.max("ts") if end is None else F.min(F.lit(end).cast("long"))).alias("end"))
    if not beyond:
        spans = same_join(spans, knots.groupBy(*group).agg(F.max("ts").alias("_last")), group)
        spans = spans.withColumn("end", F.least("end", "_last")).drop("_last")
    return interpolate_at(knots, grid_of(spans, ticks, group), method, group, bound, chunk=ticks * CHUNK_STEPS)


def interpolate_point(df: DataFrame, at: int, method: str | int = "cubic", group: Sequence[str] = (), arrival: str = "seq", bound: float | None = None) -> DataFrame:
    """The value of each series at one instant."""
    knots = knots_of(df, group, arrival)
    grid = knots.select(*group).distinct().withColumn("ts", F.lit(at).cast("long")) if group else df.sparkSession.range(1).select(F.lit(at).cast("long").alias("ts"))
    return interpolate_at(knots, grid, method, group, bound)
