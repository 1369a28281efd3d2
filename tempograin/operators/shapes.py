"""Sliding batches of a regular series and the transforms that make them comparable shapes.

A batch is a row with ``points``, an array of (x, y).  All transforms are array expressions within the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.grid import NANOS, div, floor_div
from tempograin.operators.chunks import CHUNK_ROWS, neighbours, running_count, with_chunks

#: Share of its terms below which a difference is rounding.
ROUNDING = 1e-13
POINTS = "array<struct<x:double,y:double>>"


def sliding(df: DataFrame, size: int = 100, group: Sequence[str] = (), unit: str = "us", rows: int = CHUNK_ROWS) -> DataFrame:
    """Every window of exactly ``size`` consecutive points: group, begin, end, points with x in epoch seconds.

    Rows are numbered and cut into runs of ``rows``; each run also has the first rows of the next one, so a long series is many tasks.  Instants are
    unique in a group.
    """
    rows = max(rows, size)
    x = floor_div(F.col("ts"), max(1, 10**9 // NANOS[unit])).cast("double")
    kept = df.select(*group, "ts", F.struct(x.alias("x"), F.col("value").cast("double").alias("y")).alias("_point"))
    kept = running_count(with_chunks(kept, group, "_cut"), group, ["ts"], F.col("_cut"), F.lit(True), "_i")
    run = div(F.col("_i") - 1, rows)
    shared = (F.pmod(F.col("_i") - 1, F.lit(rows)) < size - 1) & (run > 0)
    kept = kept.withColumn("_own", run).withColumn("_run", F.explode(F.when(shared, F.array(run, run - 1)).otherwise(F.array(run))))
    w = Window.partitionBy(*group, "_run").orderBy("ts").rowsBetween(0, size - 1)
    kept = kept.withColumn("points", F.collect_list("_point").over(w)).withColumn("end", F.last("ts").over(w))
    return kept.where((F.col("_own") == F.col("_run")) & (F.size("points") == size)).select(*group, F.col("ts").alias("begin"), "end", "points")


def affected_windows(changes: DataFrame, base: int, step: int, size: int, latest: int | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Windows ``base + i * step`` of ``size`` points that a change span (lo, hi) touches: group, window (its start), once each.

    Windows that would end after ``latest`` are not yet due.
    """
    first = F.greatest(F.lit(0), -floor_div(-(F.col("lo") - F.lit(base) - F.lit((size - 1) * step)), step))
    last = floor_div(F.col("hi") - F.lit(base), step)
    if latest is not None:
        last = F.least(last, floor_div(F.lit(latest - base - (size - 1) * step).cast("long"), step))
    found = changes.withColumn("_a", first).withColumn("_b", last).where("_a <= _b")
    return found.select(*group, F.explode(F.sequence("_a", "_b")).alias("i")).distinct().select(*group, (F.lit(base) + F.col("i") * F.lit(step)).alias("window"))


def let(x: Column, body) -> Column:
    """``body(x)`` with ``x`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _map(points: Column, y=None, x=None) -> Column:
    return F.transform(points, lambda p, i: F.struct((x(p, i) if x else p["x"]).alias("x"), (y(p, i) if y else p["y"]).alias("y")))


def positions(points: Column) -> Column:
    """Relative place of each point: 0 at the first, 1 at the last; null if they share an x."""
    a, b = F.element_at(points, 1)["x"], F.element_at(points, -1)["x"]
    return F.transform(points, lambda p: (p["x"] - a) / F.nullif(b - a, F.lit(0.0)))


def level(points: Column) -> Column:
    """Tilted so that both ends lie at 0: first the start is taken off, fading to the end, then what the end then is, fading to the start.

    What only rounding leaves of a point is 0, so that a straight line has no shape.
    """
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    at = lambda p: (p["x"] - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    left = lambda p: p["y"] - a["y"] * (1 - at(p)) - b["y"] * at(p)
    noise = lambda p: (F.abs(p["y"]) + F.abs(a["y"]) + F.abs(b["y"])) * ROUNDING
    return _map(points, y=lambda p, i: F.when(F.abs(left(p)) <= noise(p), F.lit(0.0)).otherwise(left(p)))


def to_origin(points: Column) -> Column:
    a = F.element_at(points, 1)["x"]
    return _map(points, x=lambda p, i: p["x"] - a)


def simplify(points: Column) -> Column:
    """The first, the last, and the points at which the slope's sign changes."""
    n = F.size(points)
    sign = lambda p, q: F.signum(q["y"] - p["y"])
    return F.filter(points, lambda p, i: (i == 0) | (i == n - 1) | (sign(F.get(points, i - 1), p) != sign(p, F.get(points, i + 1))))


def relative(points: Column) -> Column:
    """Both axes over their ranges; null if either has none."""
    span = lambda axis: F.nullif(F.array_max(F.transform(points, lambda p: p[axis])) - F.array_min(F.transform(points, lambda p: p[axis])), F.lit(0.0))
    scaled = lambda s: F.when(s["x"].isNotNull() & s["y"].isNotNull(), _map(points, x=lambda p, i: p["x"] / s["x"], y=lambda p, i: p["y"] / s["y"]))
    return let(F.struct(span("x").alias("x"), span("y").alias("y")), scaled)


def process(batches: DataFrame) -> DataFrame:
    """Batches as comparable shapes; those without extent in an axis have no shape and are dropped."""
    shape = let(level(F.col("points")), lambda p: let(to_origin(p), lambda q: let(simplify(q), relative)))
    return batches.withColumn("points", shape).where(F.col("points").isNotNull())


def resample(shape: Column, steps: int) -> Column:
    """A shape's y at ``steps`` even places on [0, 1], linearly between its points."""

    def at(points: Column, s: Column) -> Column:
        left = F.element_at(F.filter(points, lambda p: p["x"] <= s), -1)
        right = F.element_at(F.filter(points, lambda p: p["x"] >= s), 1)
        y = left["y"] + (right["y"] - left["y"]) * (s - left["x"]) / F.nullif(right["x"] - left["x"], F.lit(0.0))
        return F.coalesce(y, left["y"], right["y"])

    places = F.sequence(F.lit(0), F.lit(steps - 1))
    return let(shape, lambda points: F.transform(places, lambda i: at(points, F.least(F.lit(1.0), i / F.lit(float(max(1, steps - 1)))))))


def slope_changes(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Rows (group, ts, value; unique in ts) at which the slope's sign changes, and both ends."""
    sign = lambda a, b: F.signum(F.col(b).cast("double") - F.col(a).cast("double"))
    met = neighbours(df, group).withColumn("_b", sign("p", "value")).withColumn("_a", sign("value", "q"))
    return met.where(F.col("_b").isNull() | F.col("_a").isNull() | (F.col("_a") != F.col("_b"))).select(*df.columns)
