"""Gap fill over a reduced grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import Width, bucket_index, bucket_start, floor_div, index_of, width
from tempograin.operators.chunks import carried, same_join
from tempograin.operators.reduce import MOST_BUCKETS

METHODS = ("null", "prev", "linear", "quadratic", "cubic")
_ALIASES = {"none": "null", "previous": "prev", "locf": "prev"}
#: Buckets that one task runs over.
CHUNK = 65_536


def fill_method(token: str) -> str | float | None:
    """The method that a token names: a name of METHODS, a number for a constant, else None."""
    t = token.strip().lower()
    t = _ALIASES.get(t, t)
    if t in METHODS:
        return t
    try:
        x = float(t)
    except ValueError:
        return None
    return x if x == x and abs(x) != float("inf") else None


def fill(buckets: DataFrame, w: Width | str, method: str | float = "null", columns: Sequence[str] = ("avg",), group: Sequence[str] = (), start: int | None = None, end: int | None = None, unit: str = "us", most: int = MOST_BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """The dense grid from ``start``'s bucket (or the first) to ``end``'s (or the last); new buckets have count 0.

    Each column is filled on its own, from the buckets that carry it; existing values never change.  Buckets out of
    bounds are dropped but still serve as neighbours; the grid is never wider than the bounds.  With both bounds and no group, no buckets at all
    give the whole grid, empty.  ``linear`` goes by grid steps and leaves the edges empty; so do
    the splines, which go through the bucket starts.
    """
    w = width(w)
    if start is not None and end is not None and (end - start) // max(1, w.ticks(unit)) > most:
        raise ValueError(f"more than {most} buckets")
    have = buckets.withColumn("idx", bucket_index(F.col("bucket"), w, unit))
    lo, hi = (F.lit(index_of(x, w, unit)) if x is not None else None for x in (start, end))
    # The nearest buckets out of bounds that carry a column: all that the window needs of what lies beyond it.
    pair = lambda c: F.struct(F.col("idx").alias("i"), F.col(c).alias("v"))
    edges = [F.max_by(pair(c), F.when((F.col("idx") < lo) & F.col(c).isNotNull(), F.col("idx"))).alias(f"_before_{c}") for c in columns if lo is not None]
    edges += [F.min_by(pair(c), F.when((F.col("idx") > hi) & F.col(c).isNotNull(), F.col("idx"))).alias(f"_after_{c}") for c in columns if hi is not None]
    spans = have.groupBy(*group).agg(F.min("idx").alias("_min"), F.max("idx").alias("_max"), *edges)
    spans = spans if lo is not None and hi is not None else spans.where("_min is not null")
    spans = spans.withColumn("_lo", F.col("_min") if lo is None else lo).withColumn("_hi", F.col("_max") if hi is None else hi).where("_lo <= _hi").drop("_min", "_max")
    spans = spans.where(F.when(F.col("_hi") - F.col("_lo") >= most, F.raise_error(F.lit(f"more than {most} buckets"))).otherwise(F.lit(True)))
    grid = spans.select(*group, F.explode(F.sequence("_lo", "_hi")).alias("idx"))
    inside = have if lo is None else have.where(F.col("idx") >= lo)
    inside = inside if hi is None else inside.where(F.col("idx") <= hi)
    met = same_join(grid, inside.drop("bucket"), [*group, "idx"], "left")
    cut = floor_div(F.col("idx"), chunk)
    beyond = lambda side, c: F.col(f"_{side}_{c}") if f"_{side}_{c}" in spans.columns else F.lit(None)
    if method in ("prev", "locf", "previous"):
        met = carried(met, group, ["idx"], cut, {f"_p_{c}": F.col(c) for c in columns})
        met = same_join(met, spans.drop("_lo", "_hi"), group) if lo is not None else met
        new = {c: F.coalesce(f"_p_{c}", beyond("before", c)["v"]) if lo is not None else F.col(f"_p_{c}") for c in columns}
    elif method == "linear":
        here = lambda c: F.when(F.col(c).isNotNull(), pair(c))
        met = carried(met, group, ["idx"], cut, {f"_p_{c}": here(c) for c in columns}, {f"_q_{c}": here(c) for c in columns})
        met = same_join(met, spans.drop("_lo", "_hi"), group) if lo is not None or hi is not None else met
        new = {c: _between(c, F.coalesce(F.col(f"_p_{c}"), beyond("before", c)), F.coalesce(F.col(f"_q_{c}"), beyond("after", c))) for c in columns}
    elif method in ("quadratic", "cubic"):
        from tempograin.operators.interpolate import interpolate_at

        new = {}
        for c in columns:
            knots = have.where(F.col(c).isNotNull()).select(*group, F.col("idx").alias("ts"), F.col(c).alias("value"))
            at = interpolate_at(knots, grid.select(*group, F.col("idx").alias("ts")), method, group, chunk=chunk)
            at = at.where("kind <> 'extrapolated'").select(*group, F.col("ts").alias("idx"), F.col("value").alias(f"_s_{c}"))
            met = same_join(met, at, [*group, "idx"], "left")
            new[c] = F.coalesce(F.col(c).cast("double"), f"_s_{c}")
    elif method == "null":
        new = {c: F.col(c) for c in columns}
    else:
        new = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(method))) for c in columns}
    if method not in ("null",):
        new = {c: F.when(F.col("count").isNull(), x).otherwise(F.col(c).cast(x_type(method, c, met))) for c, x in new.items()}
    return met.select(*group, bucket_start(F.col("idx"), w, unit).alias("bucket"), F.coalesce("count", F.lit(0)).alias("count"), *[new[c].alias(c) for c in columns])


def x_type(method: str | float, column: str, met: DataFrame) -> str:
    return met.schema[column].dataType.simpleString() if method in ("prev", "previous", "locf") else "double"


def _between(c: str, p: Column, q: Column) -> Column:
    """A column's value, else on the line between its neighbours (i, v)."""
    a, b = p["v"].cast("double"), q["v"].cast("double")
    return F.coalesce(F.col(c).cast("double"), a + (b - a) * (F.col("idx") - p["i"]) / (q["i"] - p["i"]))
