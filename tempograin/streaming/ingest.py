"""Structured Streaming into a store, buckets over streams, and incremental windows.

Late rows are never dropped: streams append, and last-writer-wins at reading puts order into them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tempograin.functions.grid import Width, bucket_index, width
from tempograin.operators.fill import fill
from tempograin.operators.reduce import DEFAULT, finish, merge, partials
from tempograin.operators.shapes import affected_windows, sliding
from tempograin.sources.store import Store


def ingest_stream(points: DataFrame, store: Store, aspect: str, checkpoint: str, name: str = "stream", require_sorted: bool = False, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append a stream of points to an aspect, each batch once: its number is its key in the ledger."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.ingest(aspect, batch, key=f"{name}/{number}", require_sorted=require_sorted)
            if then:
                then(batch, number)

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def bucket_stream(points: DataFrame, w: Width | str, aggs: Sequence[str] = DEFAULT, group: Sequence[str] = (), unit: str = "us", arrival: str = "seq") -> DataFrame:
    """Running buckets of a stream, for complete or update mode; the state is one partial a bucket."""
    return finish(partials(points, w, group, unit=unit, arrival=arrival), w, aggs, group, unit)


def merge_into(parts: DataFrame | None, batch: DataFrame, w: Width | str, group: Sequence[str] = (), unit: str = "us") -> DataFrame:
    """Partials of what came before and of a batch, merged."""
    new = partials(batch, w, group, unit=unit)
    return new if parts is None else merge(parts.unionByName(new), group)


def changed_windows(changes: DataFrame, base: int, step: int, size: int, latest: int) -> DataFrame:
    """Windows to rebuild after commits (min_ts, max_ts) of a change feed."""
    return affected_windows(changes.select(F.col("min_ts").alias("lo"), F.col("max_ts").alias("hi")), base, step, size, latest)


class Batches:
    """Sliding batches of an aspect's regular series, of which only new and changed ones are handed out.

    A batch is ``size`` consecutive means of ``step``, gaps filled on a line.  What was processed is remembered by series, begin and a hash of its
    points, so a change that leaves a window as it was asks for nothing.
    """

    def __init__(self, store: Store, aspect: str, step: str, size: int):
        self.store, self.aspect, self.step, self.size, self.unit = store, aspect, step, size, store.aspect(aspect).unit
        self.at = f"{store.root}/batches/{aspect}/{step}-{size}"

    def _processed(self) -> DataFrame | None:
        tables = [f"{self.at}/{n}" for n in self.store._list(f"batches/{self.aspect}/{self.step}-{self.size}")]
        return self.store.spark.read.parquet(*tables) if tables else None

    def unprocessed(self) -> tuple[DataFrame, int]:
        """Batches (series_key, begin, end, points, hash) that changes since the last acknowledged one touch and that differ from what was processed, and the last seal that they know."""
        changes = self.store.pending_changes(self.aspect)
        lo, hi, head = changes.agg(F.min("min_ts"), F.max("max_ts"), F.max("seal_seq")).first()
        ticks, bounds = width(self.step).ticks(self.unit), (None, None)
        if lo is not None:
            # As far as the windows reach, and on to the next buckets with values, between which gaps are filled.
            first, last = (lo // ticks - self.size) * ticks, (hi // ticks + self.size + 1) * ticks
            before = self.store.read(self.aspect, None, first).where("value is not null").agg(F.max("ts")).first()[0]
            after = self.store.read(self.aspect, last).where("value is not null").agg(F.min("ts")).first()[0]
            bounds = (first if before is None else before // ticks * ticks, last if after is None else (after // ticks + 1) * ticks - 1)
        means = self.store.downsample(self.aspect, self.step, ["avg"], *bounds)
        regular = fill(means, self.step, "linear", ["avg"], ["series_key"], unit=self.unit).select("series_key", F.col("bucket").alias("ts"), F.col("avg").alias("value"))
        made = sliding(regular, self.size, ["series_key"], self.unit).withColumn("hash", F.xxhash64("points"))
        if lo is not None:
            made = made.where((F.col("begin") <= hi) & (F.col("end") + ticks > lo))
        known = self._processed()
        made = made if known is None else made.join(known, ["series_key", "begin", "hash"], "left_anti")
        return made, self.store.acked(self.aspect) if head is None else head

    def done(self, batches: DataFrame, head: int) -> None:
        """Remember ``batches`` as processed and changes up to ``head`` as worked on."""
        batches.select("series_key", "begin", "hash").write.parquet(f"{self.at}/{uuid.uuid4().hex}")
        self.store.ack_changes(self.aspect, head)


def windowed(points: DataFrame, w: Width | str, unit: str = "us") -> DataFrame:
    """A stream with the index of each row's bucket, for custom state."""
    return points.withColumn("idx", bucket_index(F.col("ts"), w, unit))
