"""Materialised partial reductions, and plans that use them where they give the same answer."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import Width, index_of, nests, width
from tempograin.operators.reduce import BIN, DEFAULT, SKETCHES, STREAMING, aggregation, downsample, finish, partials, rebucket
from tempograin.plans.scratch import written
from tempograin.sources.store import Store


@dataclass(frozen=True)
class Tier:
    """A stored rollup: its width and its partial states."""

    width: Width
    parts: DataFrame


class Rollups:
    """Tiers of one table that doesn't change; :class:`StoredRollups` keeps those of an aspect that does."""

    def __init__(self, group: Sequence[str] = (), unit: str = "us", arrival: str = "seq"):
        self.group, self.unit, self.arrival, self.tiers = tuple(group), unit, arrival, []

    def materialize(self, rows: DataFrame, base: str, coarser: Sequence[str] = (), sketches: bool = False) -> Rollups:
        """Write the base tier from rows, and coarser ones from it; those must nest.  With ``sketches`` tiers give quantiles too."""
        first = written(partials(rows, base, self.group, unit=self.unit, arrival=self.arrival, sketches=sketches), "rollup")
        self.tiers.append(Tier(width(base), first))
        for w in coarser:
            made = rebucket(first, base, w, self.group)
            if made is None:
                raise ValueError(f"{w} isn't made of whole {base}")
            self.tiers.append(Tier(width(w), written(made, "rollup")))
        return self

    def choose(self, w: Width | str, aggs: Sequence[str], start: int | None = None, end: int | None = None) -> Tier | None:
        """The coarsest tier that answers exactly: it nests, can give all aggregations, and the range is made of its whole buckets."""
        asked, fit = {aggregation(a) for a in aggs}, []
        for t in self.tiers:
            if not asked <= {*STREAMING, "count", *(SKETCHES if BIN[0] in t.parts.columns else ())}:
                continue
            ticks = t.width.ticks(self.unit)
            whole = (start is None or (start >= ticks and start % ticks == 0)) and (end is None or (end >= 0 and (end + 1) % ticks == 0))
            if whole and (t.width == width(w) or nests(t.width, w)):
                fit.append(t)
        return max(fit, key=lambda t: t.width.nanos, default=None)

    def downsample(self, rows: DataFrame, w: Width | str, aggs: Sequence[str] = DEFAULT, start: int | None = None, end: int | None = None) -> DataFrame:
        """As :func:`tempograin.operators.reduce.downsample`, from a tier if one will do."""
        tier = self.choose(w, aggs, start, end)
        if tier is None:
            return downsample(rows, w, aggs, self.group, start, end, self.unit, self.arrival)
        return served(tier, w, aggs, self.group, start, end, self.unit)


def served(tier: Tier, w: Width | str, aggs: Sequence[str], group: Sequence[str], start: int | None, end: int | None, unit: str) -> DataFrame:
    """A tier's answer over a range of its whole buckets."""
    parts = tier.parts
    if start is not None:
        parts = parts.where(F.col("idx") >= F.lit(index_of(start, tier.width, unit)))
    if end is not None:
        parts = parts.where(F.col("idx") <= F.lit(index_of(end, tier.width, unit)))
    return finish(parts if tier.width == width(w) else rebucket(parts, tier.width, w, group), w, aggs, group, unit)


class StoredRollups:
    """Rollups of a store's aspect, kept beside it with the seal up to which each is built.

    A tier that the aspect has outrun is *stale* and never served.  ``refresh`` rebuilds only the buckets that changes since then may have touched;
    the tier's new table and seal take effect together.  An aspect with a time to live is always read raw, as tiers don't forget.
    """

    def __init__(self, store: Store, aspect: str):
        self.store, self.name, self.aspect, self.group = store, aspect, store.aspect(aspect), ["series_key"]

    def _tiers(self) -> dict[str, dict]:
        return {n.removesuffix(".json"): self.store._get(f"rollups/{self.name}/{n}") for n in self.store._list(f"rollups/{self.name}") if n.endswith(".json")}

    def _head(self) -> int:
        return self.store._next_seal(self.store._log(self.name)) - 1

    def materialize(self, w: str, sketches: bool = False) -> StoredRollups:
        """Add a tier, built from all rows."""
        self._build(w, sketches, None)
        return self

    def _build(self, w: str, sketches: bool, old: dict | None) -> None:
        store, unit, head = self.store, self.aspect.unit, self._head()
        log, start, end, kept = store._log(self.name), None, None, None
        if old:
            span = store.changes_since(self.name, old["through"]).agg(F.min("min_ts"), F.max("max_ts")).first()
            open_ends = any(c["kind"] == "replace" and c["seal_seq"] > old["through"] and None in (c["start"], c["end"]) for c in log)
            if span[0] is not None and not open_ends:
                lo, hi = (index_of(x, width(w), unit) for x in span[:2])
                ticks = width(w).ticks(unit)
                start, end = (lo - 1) * ticks, (hi + 2) * ticks  # whole buckets and a little more, which is cut below
                kept = store.spark.read.parquet(f"{store.root}/rollups/{self.name}/{old['table']}").where((F.col("idx") < lo) | (F.col("idx") > hi))
        rows = store.read(self.name, start, end).withColumnRenamed("row_seq", "seq")
        new = partials(rows, w, self.group, start, end, unit, sketches=sketches)
        new = new if kept is None else new.where(F.col("idx").between(lo, hi))
        table = f"{w}-{uuid.uuid4().hex}"
        (new if kept is None else kept.unionByName(new)).write.parquet(f"{store.root}/rollups/{self.name}/{table}")
        store._put(f"rollups/{self.name}/{w}.json", {"width": w, "sketches": sketches, "through": head, "table": table}, overwrite=True)

    def stale(self) -> list[str]:
        """Widths of the tiers that lack changes."""
        head = self._head()
        return [w for w, t in self._tiers().items() if t["through"] < head]

    def refresh(self) -> list[str]:
        """Bring stale tiers up to date; which were."""
        found, tiers = self.stale(), self._tiers()
        for w in found:
            self._build(w, tiers[w]["sketches"], tiers[w])
        return found

    def choose(self, w: Width | str, aggs: Sequence[str], start: int | None = None, end: int | None = None) -> Tier | None:
        if self.aspect.ttl_nanos is not None:
            return None
        fresh, rollups = set(self._tiers()) - set(self.stale()), Rollups(self.group, self.aspect.unit)
        for n, t in self._tiers().items():
            if n in fresh:
                rollups.tiers.append(Tier(width(n), self.store.spark.read.parquet(f"{self.store.root}/rollups/{self.name}/{t['table']}")))
        return rollups.choose(w, aggs, start, end)

    def downsample(self, w: Width | str, aggs: Sequence[str] = DEFAULT, start: int | None = None, end: int | None = None) -> DataFrame:
        """The aspect's buckets, from a fresh tier if one will do, else from its rows."""
        tier = self.choose(w, aggs, start, end)
        return self.store.downsample(self.name, w, aggs, start, end) if tier is None else served(tier, w, aggs, self.group, start, end, self.aspect.unit)
