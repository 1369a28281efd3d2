"""As-of and interval joins, as window and equi-join compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import floor_div
from tempograin.operators.chunks import carried, same_join, with_chunks


def asof_join(left: DataFrame, right: DataFrame, group: Sequence[str] = (), values: Sequence[str] = ("value",), forward: bool = False, tolerance: int | None = None, chunk: int | None = None) -> DataFrame:
    """``left`` with the ``values`` of each group's latest right row at or before its ts (``forward``: earliest at or after), prefixed ``right_``, and right_ts.

    Right rows are unique in (group, ts).  One union and running values in chunks, of ``chunk`` ticks or by default of about as many rows each; no pairs are made.
    """
    kept = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*group, "ts", F.lit(0 if forward else 1).alias("_side"), kept.alias("_left"), F.lit(None).cast(right.select(F.struct("ts", *values)).schema[0].dataType).alias("_right"))  # noqa: E741
    r = right.select(*group, "ts", F.lit(1 if forward else 0).alias("_side"), F.lit(None).cast(left.select(kept).schema[0].dataType).alias("_left"), F.struct("ts", *values).alias("_right"))
    near = {"_near": F.col("_right")}
    both = with_chunks(l.unionByName(r).withColumn("_row", F.monotonically_increasing_id()), group, "_cut", chunk)
    both = carried(both, group, ["ts", "_side", "_row"], F.col("_cut"), *(({}, near) if forward else (near, {})))
    near = F.col("_near")
    if tolerance is not None:
        near = F.when(F.abs(F.col("ts") - near["ts"]) <= tolerance, near)
    out = both.where(F.col("_left").isNotNull()).withColumn("_near", near)
    return out.select("_left.*", F.col("_near.ts").alias("right_ts"), *[F.col(f"_near.{v}").alias(f"right_{v}") for v in values])


def interval_join(points: DataFrame, spans: DataFrame, cell: int, group: Sequence[str] = ()) -> DataFrame:
    """Points (group, ts, …) with each span (group, start, end, …) that contains them.

    Spans are cut into cells of ``cell`` ticks, which are equi-joined; a pair meets in the point's cell only, so none repeats.
    """
    cells = spans.where("start <= end").withColumn("_cell", F.explode(F.sequence(floor_div(F.col("start"), cell), floor_div(F.col("end"), cell))))
    return points.withColumn("_cell", floor_div(F.col("ts"), cell)).transform(same_join, cells, [*group, "_cell"]).where("ts between start and end").drop("_cell")
