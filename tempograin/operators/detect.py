"""Event detectors over a regular series (group, ts, value), and their registry.

A detector gives rows (group, event, start, end).  Neighbours are lag and lead within chunks of a series, and its chunks' edges; the drawdown detector carries its running high over a stream of
sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import moment
from tempograin.operators.chunks import neighbours, same_join

Detector = Callable[[DataFrame], DataFrame]


def _events(df: DataFrame, group: Sequence[str], name: str, start: str | Column, end: str | Column) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(*group, F.lit(name).alias("event"), col(start).alias("start"), col(end).alias("end"))


def since(df: DataFrame, start: int | None) -> DataFrame:
    return df if start is None else df.where(F.col("ts") >= F.lit(start))


def peaks(df: DataFrame, group: Sequence[str] = (), name: str = "peak", everywhere: bool = False) -> DataFrame:
    """Strict local maxima, unless ``everywhere`` only those that are the series' maximum; spans from the sample before to the one after."""
    hit = neighbours(df, group).where((F.col("p") < F.col("value")) & (F.col("q") < F.col("value")))
    if not everywhere:
        hit = _with_extreme(hit, df, group, F.max("value")).where("value = extreme")
    return _events(hit, group, name, "pt", "qt")


def valleys(df: DataFrame, group: Sequence[str] = (), name: str = "valley", everywhere: bool = False) -> DataFrame:
    hit = neighbours(df, group).where((F.col("p") > F.col("value")) & (F.col("q") > F.col("value")))
    if not everywhere:
        hit = _with_extreme(hit, df, group, F.min("value")).where("value = extreme")
    return _events(hit, group, name, "pt", "qt")


def _with_extreme(hit: DataFrame, df: DataFrame, group: Sequence[str], extreme: Column) -> DataFrame:
    found = df.groupBy(*group).agg(extreme.alias("extreme"))
    return same_join(hit, found, group)


def crossings(df: DataFrame, threshold: float, up: bool = True, group: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Where the series reaches the threshold from strictly below (``up``) or above; spans from the sample before."""
    t, v, p = F.lit(threshold), F.col("value"), F.col("p")
    hit = neighbours(df, group).where((p < t) & (t <= v) if up else (p > t) & (t >= v))
    return _events(hit, group, name or ("crossing_up" if up else "crossing_down"), "pt", "ts")


def monthly_increase(df: DataFrame, percent: float, group: Sequence[str] = (), name: str = "monthly_increase", unit: str = "us") -> DataFrame:
    """Calendar months (UTC) whose last value is at least ``percent`` per cent above their first; at least two samples; a first of 0 gives none."""
    at = df.withColumn("at", moment("ts", unit)).withColumn("month", F.trunc(F.col("at").cast("date"), "month"))
    m = at.groupBy(*group, "month").agg(F.min_by("value", "ts").alias("a"), F.max_by("value", "ts").alias("b"), F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    hit = m.where((F.col("n") >= 2) & ((F.col("b") - F.col("a")) / F.nullif(F.col("a"), F.lit(0).cast(m.schema["a"].dataType)) >= F.lit(percent / 100)))
    return _events(hit, group, name, "start", "end")


def drawdown(df: DataFrame, fraction: float, group: Sequence[str] = (), name: str = "drawdown") -> DataFrame:
    """Falls by ``fraction`` from the running high; a hit spans from the high and makes the fallen value the new high.

    Series are streamed in order with one row of state, however long they are.  A high of 0 starts nothing.
    """
    names = list(group)
    fields = {f.name: f for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, high, high_ts = None, 0.0, 0
        for batch in batches:
            keys = list(zip(*[batch[g].to_pylist() for g in names], strict=True)) if names else [()] * batch.num_rows
            out = []
            for key, ts, v in zip(keys, batch["ts"].to_pylist(), batch["value"].to_pylist(), strict=True):
                if v is None:
                    continue
                if key != at or at is None or v > high:
                    at, high, high_ts = key, v, ts
                elif high and (high - v) / high >= fraction:
                    out.append((*key, name, high_ts, ts))
                    high, high_ts = v, ts
            cols = list(zip(*out, strict=True)) or [()] * (len(names) + 3)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, batch.schema.field(g).type) for c, g in zip(cols, names, strict=False)), pa.array(cols[-3], pa.string()), pa.array(cols[-2], pa.int64()), pa.array(cols[-1], pa.int64())], names=[*names, "event", "start", "end"])

    schema = ", ".join([f"`{g}` {fields[g].dataType.simpleString()}" for g in names] + ["event string", "start long", "end long"])
    rows = df.select(*names, "ts", F.col("value").cast("double").alias("value"))
    rows = rows.repartition(*names).sortWithinPartitions(*names, "ts") if names else rows.coalesce(1).sortWithinPartitions("ts")
    return rows.mapInArrow(run, schema)


class Registry:
    """Named detectors, built-in or a user's own; ``run`` gives the events of all."""

    def __init__(self, group: Sequence[str] = ()):
        self.group, self.detectors = tuple(group), {}

    def register(self, name: str, detector: Detector) -> Registry:
        if name in self.detectors:
            raise ValueError(f"there is a detector {name!r} already")
        self.detectors[name] = detector
        return self

    def register_builtin(self, kind: str, name: str | None = None, **how) -> Registry:
        made = {"peaks": peaks, "valleys": valleys, "crossings": crossings, "monthly_increase": monthly_increase, "drawdown": drawdown}[kind]
        name = name or kind
        return self.register(name, lambda df: made(df, group=self.group, name=name, **how))

    def run(self, df: DataFrame, start: int | None = None) -> DataFrame:
        """Events (group, event, start, end) of all detectors from ``start`` on; none from an empty range."""
        out = None
        for detector in self.detectors.values():
            found = detector(since(df, start)).select(*self.group, "event", "start", "end")
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no detector is registered")
        return out
