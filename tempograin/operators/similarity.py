"""Similarity of shapes, and dictionaries of patterns.

Two shapes of equal steps are compared by constraints that must all hold: of {max, average, sum} of differences, {signed, absolute}, against a {static,
percentile} limit.  Importing shapes into a dictionary depends on their order; it runs as one stream per group with the dictionary as state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONSTRAINTS = tuple(f"{a}{b}_{c}" for a, b, c in product(("max", "average", "sum"), ("", "_absolute"), ("static", "percentile")))
#: Fixed values of learned similarity: distances remembered, imports between steerings, share of new patterns aimed at, step, centre and bounds of the factor.
MEMORY, RATE_WINDOW, NEW_SHARE, STEP, CENTRE, BOUNDS = 256, 50, 0.02, 1.25, 2.0, (0.05, 20.0)
#: Fixed value: per cent that stands for a difference from nothing.
FROM_ZERO = 10_000.0


def constraint(kind: str, a: Column, b: Column, limit: float) -> Column:
    """Whether shapes ``a`` and ``b`` (arrays of amplitudes) satisfy one of CONSTRAINTS.

    Static limits bound the difference of maxima or sums, or the mean pointwise difference; ``absolute`` takes magnitudes first.  Percentile limits bound
    it in per cent of ``b``: pointwise for maximum and average, of the sums for sum.  A sum's share keeps its sign, so a negative one always
    passes.  Static limits fail for shapes that are empty or of unequal length, percentile ones pass for empty shapes.
    """
    if kind not in CONSTRAINTS:
        raise ValueError(f"no such constraint: {kind!r}")
    measure, percent = kind.split("_")[0], kind.endswith("percentile")
    if "_absolute" in kind:
        a, b = F.transform(a, lambda x: F.abs(x)), F.transform(b, lambda x: F.abs(x))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    apart = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    share = lambda d, base: F.when(base != 0, d / base * 100).otherwise(F.when(d == 0, F.lit(0.0)).otherwise(F.lit(FROM_ZERO)))
    if not percent:
        found = F.abs(F.array_max(a) - F.array_max(b)) if measure == "max" else total(apart) / F.size(a) if measure == "average" else F.abs(total(a) - total(b))
        return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)), F.lit(False)).otherwise(found <= F.lit(float(limit)))
    if measure == "sum":
        found = share(F.abs(total(a) - total(b)), total(b))
    else:
        each = F.zip_with(a, b, lambda x, y: share(F.abs(x - y), F.abs(y)))
        found = F.array_max(each) if measure == "max" else total(each) / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(True)).otherwise(found <= F.lit(float(limit)))


def similar(a: Column, b: Column, limits: dict[str, float]) -> Column:
    out = F.size(a) == F.size(b)
    for kind, limit in limits.items():
        out = out & constraint(kind, a, b, limit)
    return out


def distances(a: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Mean absolute difference to each known shape, and the difference of maxima."""
    return np.stack((np.abs(known - a).mean(axis=1), np.abs(known.max(axis=1) - a.max())), axis=1)


class Learned:
    """Limits of a factor times the median distance to the nearest pattern; the factor is steered to a rate of new patterns."""

    def __init__(self):
        self.factor, self.near = CENTRE, (deque(maxlen=MEMORY), deque(maxlen=MEMORY))
        self.imports = self.new = 0

    def limits(self) -> np.ndarray | None:
        return None if not all(self.near) else self.factor * np.array([sorted(q)[len(q) // 2] for q in self.near])

    def matches(self, shape: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Patterns within the limits; before any distance is known nothing matches."""
        limits, hit = self.limits(), np.zeros(0, np.int64)
        if len(known):
            d = distances(shape, known)
            if limits is not None:
                hit = np.flatnonzero((d <= limits).all(axis=1))
            for q, x in zip(self.near, d.min(axis=0), strict=True):
                if x > 0:  # a repeat tells nothing of the scale
                    q.append(x)
        self.steer(not len(hit))
        return hit

    def steer(self, was_new: bool) -> None:
        self.imports, self.new = self.imports + 1, self.new + was_new
        if self.imports == RATE_WINDOW:
            rate = self.new / self.imports
            self.factor *= STEP if rate > NEW_SHARE else 1 / STEP if rate < NEW_SHARE else 1
            self.factor = min(max(CENTRE * (self.factor / CENTRE) ** 0.9, BOUNDS[0]), BOUNDS[1])
            self.imports = self.new = 0


#: Fixed values of learned step counts: shapes looked at, share of a shape's range that resampling may cost, share of shapes that must keep to it, most steps.
CALIBRATION, TOLERANCE, KEEP, MOST_STEPS = 64, 0.02, 0.9, 1024


def even(shape: np.ndarray, steps: int) -> np.ndarray:
    """A shape at evenly spaced places, linearly between its points."""
    return np.interp(np.linspace(0, len(shape) - 1, steps), np.arange(len(shape)), shape)


def steps_for(shapes: Sequence[np.ndarray], tolerance: float = TOLERANCE, keep: float = KEEP) -> int | None:
    """The fewest steps at which the share ``keep`` of the shapes come back within ``tolerance`` of their range; None without shapes."""
    shapes = [np.asarray(s, float) for s in shapes if len(s) >= 2]
    if not shapes:
        return None
    longest = min(MOST_STEPS, max(map(len, shapes)))
    for steps in range(2, longest):
        loss = [np.abs(even(even(s, steps), len(s)) - s).max() / (np.ptp(s) or np.inf) for s in shapes]
        if np.mean(np.array(loss) <= tolerance) > keep:
            return steps
    return longest


def learned_steps(batches: DataFrame, y: str = "shape", sample: int = CALIBRATION) -> int | None:
    """:func:`steps_for` the first ``sample`` shapes by begin: a dictionary's step count is settled by these and then stays."""
    rows = batches.where(F.size(y) >= 2).orderBy("begin").limit(sample).select(y).collect()
    return steps_for([r[0] for r in rows])


def holding(a: np.ndarray, known: np.ndarray, limits: dict[str, float]) -> np.ndarray:
    """Which of the ``known`` shapes (rows as long as ``a``) satisfy all constraints with ``a`` first, as :func:`constraint` has them."""
    good = np.ones(len(known), bool)
    for kind, limit in limits.items():
        if kind not in CONSTRAINTS:
            raise ValueError(f"no such constraint: {kind!r}")
        measure, percent = kind.split("_")[0], kind.endswith("percentile")
        x, y = (np.abs(a), np.abs(known)) if "_absolute" in kind else (a, known)
        if not len(a):
            good &= percent
            continue
        if measure == "sum" or (measure == "max" and not percent):
            apart = np.abs(x.sum() - y.sum(axis=1)) if measure == "sum" else np.abs(x.max() - y.max(axis=1))
            found = _share(apart, y.sum(axis=1)) if percent else apart
        else:
            apart = np.abs(x - y)
            apart = _share(apart, np.abs(y)) if percent else apart
            found = apart.max(axis=1) if measure == "max" else apart.mean(axis=1)
        good &= found <= limit
    return good


def _share(apart: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A difference in per cent of its base."""
    return np.where(base != 0, apart / np.where(base != 0, base, 1) * 100, np.where(apart == 0, 0.0, FROM_ZERO))


class Dictionary:
    """The patterns of one group, in order: an array that grows by doubling for each length of shape."""

    def __init__(self, limits: dict[str, float] | None, most: int):
        self.limits, self.most, self.learned, self.size = limits, most, Learned(), 0
        self.held: dict[int, tuple[np.ndarray, list[int]]] = {}

    def add(self, a: np.ndarray) -> tuple[list[int], bool]:
        """Numbers of the patterns that a shape belongs to, and whether that is a new one."""
        rows, numbers = self.held.get(len(a), (np.zeros((0, len(a))), []))
        known = rows[: len(numbers)]
        hit = self.learned.matches(a, known) if self.limits is None else np.flatnonzero(holding(a, known, self.limits))
        if len(hit):
            return [numbers[k] for k in hit], False
        if self.size >= self.most:
            raise ValueError(f"a dictionary of more than {self.most} patterns")
        if len(numbers) == len(rows):
            rows = np.concatenate((rows, np.zeros((max(16, len(rows)), len(a)))))
        rows[len(numbers)] = a
        numbers.append(self.size)
        self.held[len(a)] = rows, numbers
        self.size += 1
        return [self.size - 1], True


def import_patterns(shapes: DataFrame, limits: dict[str, float] | None, group: Sequence[str] = (), y: str = "shape", most: int = 100_000) -> DataFrame:
    """Patterns of each group's dictionary: group, pattern, shape, occurrences (begin, end).

    Shapes (group, begin, end, ``y``) are taken in order of begin.  One that is similar to stored patterns adds its occurrence to all of
    them, else it becomes a pattern.  ``limits`` bound any of CONSTRAINTS, all of which must hold, and shapes of unequal length are never similar; None
    learns limits.  A group is one stream whose only state is its dictionary, which may hold ``most`` patterns; more are an error.
    """
    names = list(group)
    if limits is not None and (odd := set(limits) - set(CONSTRAINTS)):
        raise ValueError(f"no such constraints: {sorted(odd)}")

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, None
        for frame in frames:
            for keys, part in frame.groupby(names, sort=False, dropna=False) if names else [((), frame)]:
                same = at is not None and all(x == z or (pd.isna(x) and pd.isna(z)) for x, z in zip(keys, at, strict=True))
                if not same:
                    at, known = keys, Dictionary(limits, most)
                out: list[tuple] = []
                for begin, end, shape in zip(part["begin"], part["end"], part[y], strict=True):
                    a = np.asarray(shape, float)
                    numbers, new = known.add(a)
                    out += [(k, list(a) if new else None, begin, end) for k in numbers]
                made = pd.DataFrame(out, columns=["pattern", "shape", "begin", "end"])
                yield pd.concat([part[names].iloc[[0] * len(made)].reset_index(drop=True), made], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in shapes.schema.fields}
    schema = ", ".join([f"`{g}` {kinds[g]}" for g in names] + ["pattern long", "shape array<double>", "begin long", "end long"])
    rows = shapes.select(*names, "begin", "end", y)
    rows = rows.repartition(*names).sortWithinPartitions(*names, "begin") if names else rows.coalesce(1).sortWithinPartitions("begin")
    members = rows.mapInPandas(stream, schema)
    occurrences = F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("occurrences")
    return members.groupBy(*names, "pattern").agg(F.first("shape", ignorenulls=True).alias("shape"), occurrences)
