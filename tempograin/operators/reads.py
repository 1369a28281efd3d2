"""Reads of stored rows under last-writer-wins.

Stored rows are ``group columns (such as aspect, series_key), ts, value, seal_seq, row_seq``.  At an instant the rows of the newest seal
replace all rows of older ones; rows that repeat within one seal stay.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.grid import NANOS, div
from tempograin.operators.chunks import same_join
from tempograin.operators.reduce import in_range

SERIES = ("aspect", "series_key")
MOST_INSTANTS = 10_000


def newest(rows: DataFrame, group: Sequence[str] = SERIES, seal: str = "seal_seq") -> DataFrame:
    """Last writer wins: at each instant the rows of the newest seal, nulls included."""
    w = Window.partitionBy(*group, "ts")
    return rows.withColumn("_newest", F.max(seal).over(w)).where(F.col(seal) == F.col("_newest")).drop("_newest")


def time_range(rows: DataFrame, start: int | None = None, end: int | None = None, group: Sequence[str] = SERIES) -> DataFrame:
    """Rows with instants in the inclusive range; a newer null hides an older value and is itself returned."""
    return newest(in_range(rows, start, end), group)


def value_range(rows: DataFrame, low: object, high: object) -> DataFrame:
    """Every stored row with a value in the inclusive band, whether or not a newer seal replaced it; order by seal_seq, row_seq."""
    kind = rows.schema["value"].dataType

    def at(x: object) -> Column:
        if kind.typeName() != "decimal":
            return F.lit(x)
        exact = Decimal(str(x))
        # Of the column's own type, where that loses nothing, a bound reaches the files' statistics.
        fits = -exact.normalize().as_tuple().exponent <= kind.scale and (not exact or exact.adjusted() < kind.precision - kind.scale)
        return F.lit(exact).cast(kind) if fits else F.lit(exact)

    return rows.where(F.col("value").between(at(low), at(high)))


def points(rows: DataFrame, instants: Sequence[int], group: Sequence[str] = SERIES) -> DataFrame:
    """For each requested instant, in request order and with repeats, each series' newest present value; null where there is none.

    Unlike in ranges, a null never hides an older value.
    """
    if len(instants) > MOST_INSTANTS:
        raise ValueError(f"more than {MOST_INSTANTS} instants")
    spark = rows.sparkSession
    asked = spark.createDataFrame([(i, int(t)) for i, t in enumerate(instants)], "request int, ts long")
    found = rows.where(F.col("value").isNotNull()).join(F.broadcast(asked.select("ts").distinct()), "ts")
    best = found.groupBy(*group, "ts").agg(F.max_by("value", F.struct("seal_seq", "row_seq")).alias("value"))
    series = rows.select(*group).distinct()
    every = series.join(F.broadcast(asked))  # the request is at most MOST_INSTANTS rows
    return same_join(every, best, [*group, "ts"], "left").select(*group, "request", "ts", "value")


def point(rows: DataFrame, instant: int, group: Sequence[str] = SERIES) -> DataFrame:
    return points(rows, [instant], group).drop("request")


def only_series(rows: DataFrame, key: str = "series_key") -> DataFrame:
    """``rows`` if they belong to one series at most; an error if to several."""
    found = [r[0] for r in rows.select(key).distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"ambiguous series: {found}")
    return rows


def live(rows: DataFrame, now: int, ttl_nanos: int, unit: str = "us") -> DataFrame:
    """Rows that a time to live doesn't hide: ts >= now - ttl.  A positive ttl under a tick counts as one tick."""
    ttl = max(1, ttl_nanos // NANOS[unit]) if ttl_nanos > 0 else 0
    return rows.where(F.col("ts") >= F.lit(now - ttl))


def page(rows: DataFrame, take: int, offset: int = 0, after: tuple[int, int] | None = None, order: Sequence[str] = ("ts", "row_seq")) -> DataFrame:
    """``take`` rows in order, after ``offset`` rows or, without scanning those before, after a cursor's (ts, row_seq)."""
    if after is not None:
        rows = rows.where((F.col(order[0]) > F.lit(after[0])) | ((F.col(order[0]) == F.lit(after[0])) & (F.col(order[1]) > F.lit(after[1]))))
    return rows.orderBy(*order).offset(offset).limit(take)


def cursor_of(rows: DataFrame, order: Sequence[str] = ("ts", "row_seq")) -> tuple[int, int] | None:
    """The cursor behind a page: the key of its last row."""
    last = rows.agg(F.max(F.struct(*order)).alias("k")).first()["k"]
    return (last[0], last[1]) if last else None


def token_of(rows: DataFrame, selector: object, order: Sequence[str] = ("ts", "row_seq")) -> str | None:
    """A cursor as text: the key of a page's last row, bound to that row's content and to the selection it is a page of."""
    last = rows.orderBy(*[F.desc(c) for c in order]).select(*order, _print_of(rows).alias("print")).first()
    return None if last is None else base64.urlsafe_b64encode(json.dumps([_selected(selector), last[0], last[1], last[2]]).encode()).decode()


def page_after(rows: DataFrame, take: int, token: str | None, selector: object, order: Sequence[str] = ("ts", "row_seq")) -> DataFrame:
    """The page behind a cursor; an error if it is of another selection or its row has changed since."""
    if token is None:
        return page(rows, take, order=order)
    try:
        of, ts, seq, mark = json.loads(base64.urlsafe_b64decode(token))
    except ValueError:
        raise ValueError("not a cursor") from None
    if of != _selected(selector):
        raise ValueError("the cursor belongs to another selection")
    found = rows.where((F.col(order[0]) == F.lit(ts)) & (F.col(order[1]) == F.lit(seq))).select(_print_of(rows)).collect()
    if mark not in [r[0] for r in found]:
        raise ValueError("the cursor's row has changed")
    return page(rows, take, after=(ts, seq), order=order)


def _selected(selector: object) -> str:
    return hashlib.sha256(json.dumps(selector, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _print_of(rows: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in rows.columns])


def order_violations(rows: DataFrame, group: Sequence[str] = (*SERIES, "seal_seq")) -> DataFrame:
    """The first row of each segment whose instant is before its predecessor's: row_seq, previous, current."""
    w = Window.partitionBy(*group).orderBy("row_seq")
    bad = rows.withColumn("previous", F.lag("ts").over(w)).where(F.col("previous") > F.col("ts"))
    return bad.groupBy(*group).agg(F.min(F.struct("row_seq", "previous", F.col("ts").alias("current"))).alias("b")).select(*group, "b.row_seq", "b.previous", "b.current")


def bounds(rows: DataFrame, group: Sequence[str] = SERIES) -> DataFrame:
    """Earliest and latest instant with their values, and counts, by series."""
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"),
        F.min_by("value", F.struct("ts", "seal_seq", "row_seq")).alias("first_value"), F.max_by("value", F.struct("ts", "seal_seq", "row_seq")).alias("last_value"),
    )


def segment_stats(rows: DataFrame, group: Sequence[str] = SERIES) -> DataFrame:
    """By series: segments, those out of order, and those that overlap an earlier-starting one in time."""
    w = Window.partitionBy(*group, "seal_seq").orderBy("row_seq")
    steps = rows.withColumn("back", (F.lag("ts").over(w) > F.col("ts")).cast("int"))
    seg = steps.groupBy(*group, "seal_seq").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.coalesce(F.max("back"), F.lit(0)).alias("back"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(*group).orderBy("lo", "seal_seq").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("overlaps", F.coalesce(F.col("lo") <= F.max("hi").over(before), F.lit(False)))
    return seg.groupBy(*group).agg(F.count(F.lit(1)).alias("segments"), F.sum("rows").alias("rows"), F.sum("back").cast("long").alias("unsorted_segments"), F.count_if("overlaps").alias("overlapping_segments"))


def overlap_groups(rows: DataFrame, group: Sequence[str] = SERIES) -> DataFrame:
    """Each segment with the number of its connected group of segments that overlap in time."""
    seg = rows.groupBy(*group, "seal_seq").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = Window.partitionBy(*group).orderBy("lo", "seal_seq")
    starts = F.coalesce((F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("long"), F.lit(1))
    return seg.withColumn("_s", starts).withColumn("overlap_group", F.sum("_s").over(w)).drop("_s")


def expiry_cutoff(now: int, ttl_nanos: int, unit: str = "us") -> int:
    return now - (max(1, ttl_nanos // NANOS[unit]) if ttl_nanos > 0 else 0)


def size_cuts(rows: DataFrame, most_rows: int, group: Sequence[str] = SERIES) -> DataFrame:
    """Segment numbers of about ``most_rows`` rows in time order, never cutting inside a run of equal instants."""
    by_instant = rows.groupBy(*group, "ts").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return by_instant.withColumn("part", div(F.coalesce(F.sum("_n").over(before), F.lit(0)), most_rows)).withColumnRenamed("_n", "rows")
