"""Downsampling into epoch buckets, partial reductions, and their merging.

Rows are ``group columns, ts (integer epoch), value (decimal or double), arrival``.  Aggregations that stream go through one
hash aggregation, combined before its only shuffle.  Exact percentiles and time-weighted averages need a bucket's rows in order: these are windows
over the bucket, sorted with spilling, that share that same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.grid import Width, bucket, bucket_index, bucket_start, div, floor_div, nests, width
from tempograin.operators.chunks import same_join

STREAMING = ("min", "max", "sum", "avg", "first", "last")
PERCENTILES = {"p50": 50, "p90": 90, "p95": 95, "p99": 99}
TIME_WEIGHTED = ("twa", "twa_linear", "twa_bucket_end")
SKETCHES = {"sketch_p50": 0.50, "sketch_p90": 0.90, "sketch_p95": 0.95, "sketch_p99": 0.99}
DEFAULT = ("min", "max", "avg")
_ALIASES = {"mean": "avg", "average": "avg", "median": "p50", "minimum": "min", "maximum": "max", "total": "sum"}
#: Larger grids are refused before any work is done.
MOST_BUCKETS = 1_000_000


def aggregation(token: str) -> str | None:
    """The aggregation that a token names, else None."""
    t = token.strip().lower()
    t = _ALIASES.get(t, t)
    return t if t == "count" or t in STREAMING or t in PERCENTILES or t in TIME_WEIGHTED or t in SKETCHES else None


def in_range(df: DataFrame, start: int | None, end: int | None, ts: str = "ts") -> DataFrame:
    """Rows of an inclusive range of instants; an omitted bound is open."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end))
    return df


def arrival_key(ts: Column, arrival: Column) -> Column:
    """One number that orders by instant and then by arrival (not negative).

    A number can sit in a hash aggregation's buffer, where a struct would force a sort of all rows.
    """
    return (ts.cast("decimal(19,0)") * F.lit(Decimal(10**19)) + F.coalesce(arrival, F.lit(0)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _quotient(total: Column, count: Column) -> Column:
    return total.cast("double") / count.cast("double")


def downsample(df: DataFrame, w: Width | str, aggs: Sequence[str] = DEFAULT, group: Sequence[str] = (), start: int | None = None, end: int | None = None, unit: str = "us", arrival: str = "seq", ts: str = "ts", value: str = "value") -> DataFrame:
    """One row per non-empty bucket: group, bucket (start), count, and a column for each aggregation.

    Null values don't count.  ``first`` and ``last`` go by instant, then by arrival.  Percentiles are nearest-rank and return observed values.
    Time-weighted averages weigh by whole milliseconds to the next sample; ``twa_bucket_end`` lets the last one dwell to the
    bucket's end; without any weight they are the plain mean.  Averages are doubles from exact sums.
    """
    w = width(w)
    asked = list(dict.fromkeys(a for a in (aggregation(t) or _unknown(t) for t in aggs) if a != "count"))
    if start is not None and end is not None and (end - start) // max(1, w.ticks(unit)) > MOST_BUCKETS:
        raise ValueError(f"more than {MOST_BUCKETS} buckets")
    sketched = [a for a in asked if a in SKETCHES]
    if sketched and all(a in (*STREAMING, *SKETCHES) for a in asked):  # one pass over the rows gives all of these
        return finish(partials(df, w, group, start, end, unit, arrival, ts, value, sketches=True), w, asked, group, unit)
    rows = in_range(df.where(F.col(value).isNotNull()), start, end, ts).withColumn("bucket", bucket(F.col(ts), w, unit))
    keys = [*group, "bucket"]
    v, at = F.col(value), arrival_key(F.col(ts), F.col(arrival)) if {"first", "last"} & set(asked) else None
    out = [F.count(F.lit(1)).alias("count")]
    part = Window.partitionBy(*keys)
    if any(a in TIME_WEIGHTED for a in asked):
        order = part.orderBy(ts, arrival)
        ms = lambda a, b: div(b - a, max(1, {"us": 1000, "ns": 10**6}.get(unit, 1))) * F.lit(1000 if unit == "s" else 1)
        rows = rows.withColumn("_next", F.lead(ts).over(order)).withColumn("_value", F.lead(value).over(order))
        rows = rows.withColumn("_dt", ms(F.col(ts), F.col("_next")).cast("decimal(20,0)")).withColumn("_end", ms(F.col(ts), F.coalesce("_next", F.col("bucket") + F.lit(w.ticks(unit)))).cast("decimal(20,0)"))
    if any(a in PERCENTILES for a in asked):
        rows = rows.withColumn("_rank", F.row_number().over(part.orderBy(value, ts, arrival))).withColumn("_n", F.count(F.lit(1)).over(part))
    mean = _quotient(F.sum(v), F.count(F.lit(1)))
    for a in asked:
        if a in PERCENTILES:
            x = F.min(F.when(F.col("_rank") == div(F.col("_n") * PERCENTILES[a] + 99, 100), v))
        elif a in TIME_WEIGHTED:
            dt = F.col("_end") if a == "twa_bucket_end" else F.col("_dt")
            worth = (v + F.col("_value")) / F.lit(2) if a == "twa_linear" else v
            total = F.sum((v + F.col("_value")) * dt) if a == "twa_linear" else F.sum(worth * dt)
            span = F.sum(dt)
            x = F.when(F.coalesce(span, F.lit(0)) == 0, mean).otherwise(total.cast("double") / (span.cast("double") * (2.0 if a == "twa_linear" else 1.0)))
        elif a in SKETCHES:
            continue
        elif a in ("first", "last"):
            x = F.min_by(v, at) if a == "first" else F.max_by(v, at)
        else:
            x = {"min": F.min(v), "max": F.max(v), "sum": F.sum(v), "avg": mean}[a]
        out.append(x.alias(a))
    result = rows.groupBy(*keys).agg(*out)
    if sketched:
        from tempograin.operators.sketch import sketch_quantiles

        quantiles = sketch_quantiles(rows, keys, {a: SKETCHES[a] for a in sketched}, value=value)
        result = same_join(result, quantiles, keys)
    return result.select(*keys, "count", *asked)


def _unknown(token: str) -> str:
    raise ValueError(f"unknown aggregation {token!r}")


#: Columns of a state that is kept for each sketch bin of a bucket rather than for the bucket.
BIN = ("sign", "bin")


def partials(df: DataFrame, w: Width | str, group: Sequence[str] = (), start: int | None = None, end: int | None = None, unit: str = "us", arrival: str = "seq", ts: str = "ts", value: str = "value", sketches: bool = False) -> DataFrame:
    """Mergeable state per bucket: count, sum, min, max, first and last with the keys that order them.  The index is kept, so that it can be coarsened.

    With ``sketches`` a bucket has a state for each bin of its quantile sketch (columns sign and bin), which merge and coarsen alike.
    """
    from tempograin.operators.sketch import bin_of

    rows = in_range(df.where(F.col(value).isNotNull()), start, end, ts).withColumn("idx", bucket_index(F.col(ts), w, unit))
    bins = bin_of(F.col(value)) if sketches else ()
    at = arrival_key(F.col(ts), F.col(arrival))
    return rows.groupBy(*group, "idx", *[x.alias(n) for n, x in zip(BIN, bins, strict=False)]).agg(
        F.count(F.lit(1)).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.min(at).alias("first_key"), F.min_by(value, at).alias("first"), F.max(at).alias("last_key"), F.max_by(value, at).alias("last"),
    )


def _bins(parts: DataFrame) -> list[str]:
    return [c for c in BIN if c in parts.columns]


def _merged(parts: DataFrame) -> list[Column]:
    kind = parts.schema["sum"].dataType.simpleString()
    return [
        F.sum("count").alias("count"), F.sum("sum").cast(kind).alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("first_key").alias("first_key"), F.min_by("first", "first_key").alias("first"), F.max("last_key").alias("last_key"), F.max_by("last", "last_key").alias("last"),
    ]


def merge(parts: DataFrame, group: Sequence[str] = (), index: Column | None = None) -> DataFrame:
    """Combine partial states that share a bucket (and bin), in any order; ``index`` may send several buckets to one."""
    kept = parts if index is None else parts.withColumn("idx", index)
    return kept.groupBy(*group, "idx", *_bins(parts)).agg(*_merged(parts))


def coarsen(parts: DataFrame, n: int, group: Sequence[str] = ()) -> DataFrame:
    """Merge runs of ``n`` buckets."""
    if n < 1:
        raise ValueError("runs have at least one bucket")
    return merge(parts, group, floor_div(F.col("idx"), n))


def rebucket(parts: DataFrame, source: Width | str, target: Width | str, group: Sequence[str] = ()) -> DataFrame | None:
    """Partials of ``source`` as partials of ``target``; None where the grids don't nest."""
    if not nests(source, target):
        return None
    a, b = width(source), width(target)
    # A bucket's start decides, by the coarse grid's own rule.
    return merge(parts, group, bucket_index(bucket_start(F.col("idx"), a, "s"), b, "s"))


def finish(parts: DataFrame, w: Width | str, aggs: Sequence[str] = DEFAULT, group: Sequence[str] = (), unit: str = "us") -> DataFrame:
    """Partial states as the rows that :func:`downsample` gives; sketches come out if there are bins, time-weighted averages and exact percentiles never."""
    from tempograin.operators.sketch import MOST_BINS, binned_quantiles, value_of_bin

    made = {"min": F.col("min"), "max": F.col("max"), "sum": F.col("sum"), "avg": _quotient(F.col("sum"), F.col("count")), "first": F.col("first"), "last": F.col("last")}
    asked = [a for a in (aggregation(t) or _unknown(t) for t in aggs) if a != "count"]
    binned = bool(_bins(parts))
    if bad := [a for a in asked if a not in made and not (binned and a in SKETCHES)]:
        raise ValueError(f"partials can't give {bad}")
    if binned:
        ran, found = binned_quantiles(parts, [*group, "idx"], {a: SKETCHES[a] for a in asked if a in SKETCHES}, MOST_BINS)
        parts = ran.groupBy(*group, "idx").agg(*_merged(parts), *[x.alias(f"_{a}") for a, x in found.items()])
        made |= {a: value_of_bin(F.col(f"_{a}")) for a in found}
    return parts.select(*group, bucket_start(F.col("idx"), w, unit).alias("bucket"), "count", *[made[a].alias(a) for a in asked])
