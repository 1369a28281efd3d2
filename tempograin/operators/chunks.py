"""Running values over long series without one task for a whole series.

A series is cut into chunks by a column that rises with its order.  Each chunk is summarised, the few summaries are run over, and every
chunk starts from what came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.grid import div, floor_div


#: Rows that a chunk is meant to hold.
CHUNK_ROWS = 65_536


def chunk_width(n: Column, first: Column, last: Column, rows: int = CHUNK_ROWS) -> Column:
    """Ticks of a chunk so that ``n`` rows from ``first`` to ``last`` fall into chunks of about ``rows``, however dense they are."""
    return F.greatest(F.lit(1), div(last - first, F.greatest(F.lit(1), div(n, rows))) + 1).cast("long")


def with_chunks(df: DataFrame, group: Sequence[str], name: str, chunk: int | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with the number ``name`` of each row's chunk: of ``chunk`` ticks, or by default of each group's own width for about ``rows`` rows."""
    if chunk is not None:
        return df.withColumn(name, floor_div(F.col("ts"), chunk))
    spans = df.groupBy(*group).agg(chunk_width(F.count(F.lit(1)), F.min("ts"), F.max("ts"), rows).alias("_width"))
    return same_join(df, spans, group).withColumn(name, F.floor(F.col("ts") / F.col("_width"))).drop("_width")


def neighbours(df: DataFrame, group: Sequence[str], chunk: int | None = None) -> DataFrame:
    """``df`` (group, ts, value; unique in ts) with the value and instant before (p, pt) and after (q, qt) each row."""
    df = with_chunks(df, group, "_chunk", chunk).withColumn("_own", F.struct("ts", "value"))
    edges = df.groupBy(*group, "_chunk").agg(F.min_by("_own", "ts").alias("_first"), F.max_by("_own", "ts").alias("_last"))
    row = Window.partitionBy(*group).orderBy("_chunk")
    around = edges.select(*group, "_chunk", F.lag("_last").over(row).alias("_before"), F.lead("_first").over(row).alias("_after"))
    row = Window.partitionBy(*group, "_chunk").orderBy("ts")
    met = _join(df, around, group).withColumn("_p", F.coalesce(F.lag("_own").over(row), "_before")).withColumn("_q", F.coalesce(F.lead("_own").over(row), "_after"))
    met = met.withColumns({"p": F.col("_p.value"), "pt": F.col("_p.ts"), "q": F.col("_q.value"), "qt": F.col("_q.ts")})
    return met.drop("_chunk", "_own", "_before", "_after", "_p", "_q")


def carried(df: DataFrame, group: Sequence[str], order: Sequence[str], chunk: Column, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with, for each named expression, its last non-null value up to the row (``before``) or its first from the row on (``after``).

    ``order`` has no ties within a group.
    """
    before, after = before or {}, after or {}
    values = before | after
    df = df.withColumn("_chunk", chunk)
    for name, x in values.items():
        df = df.withColumn(f"_x_{name}", x)
    at = lambda n: F.when(F.col(f"_x_{n}").isNotNull(), F.struct(*order))
    edge = lambda n: (F.max_by if n in before else F.min_by)(F.col(f"_x_{n}"), at(n)).alias(f"_c_{n}")
    chunks = df.groupBy(*group, "_chunk").agg(*[edge(n) for n in values])
    row = Window.partitionBy(*group).orderBy("_chunk")
    outside = {n: F.last(f"_c_{n}", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1)) if n in before else F.first(f"_c_{n}", ignorenulls=True).over(row.rowsBetween(1, Window.unboundedFollowing)) for n in values}
    met = _join(df, chunks.select(*group, "_chunk", *[x.alias(f"_c_{n}") for n, x in outside.items()]), group)
    row = Window.partitionBy(*group, "_chunk").orderBy(*order)
    for n in values:
        here = F.last(f"_x_{n}", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, 0)) if n in before else F.first(f"_x_{n}", ignorenulls=True).over(row.rowsBetween(0, Window.unboundedFollowing))
        met = met.withColumn(n, F.coalesce(here, F.col(f"_c_{n}")))
    return met.drop("_chunk", *[f"_x_{n}" for n in values], *[f"_c_{n}" for n in values])


def running_count(df: DataFrame, group: Sequence[str], order: Sequence[str], chunk: Column, what: Column, name: str) -> DataFrame:
    """``df`` with the number of rows up to each for which ``what`` holds."""
    df = df.withColumn("_chunk", chunk).withColumn("_one", what.cast("long"))
    chunks = df.groupBy(*group, "_chunk").agg(F.sum("_one").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(*group, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = _join(df, chunks, group).withColumn(name, F.col("_before") + F.sum("_one").over(within))
    return met.drop("_chunk", "_one", "_before")


def same_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, where nulls equal each other; key columns come from ``left``, others of ``right`` have names of their own.

    Without keys ``right`` is a single row, such as totals of a single series.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*[F.col(k).alias(f"_g_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{i}"))
    return left.join(named, same, how).drop(*[f"_g_{i}" for i in range(len(keys))])


def _join(df: DataFrame, chunks: DataFrame, group: Sequence[str]) -> DataFrame:
    return same_join(df, chunks, [*group, "_chunk"])
