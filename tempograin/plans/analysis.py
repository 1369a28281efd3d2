"""The analytics pipeline: regular series, shapes, patterns, events, correlations, signals, probabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import Width, width
from tempograin.operators import shapes, signals
from tempograin.operators.detect import Registry
from tempograin.operators.interpolate import interpolate
from tempograin.operators.similarity import import_patterns
from tempograin.plans.scratch import written


class Analysis:
    """One run over all series of a table (group, ts, value, seq).  Each stage's result is written once; later stages start from it."""

    def __init__(self, rows: DataFrame, group: Sequence[str], step: Width | str, method: str | int = "linear", batch: int = 24, steps: int = 16, limits: dict[str, float] | None = None, unit: str = "us"):
        self.rows, self.group, self.step, self.method, self.batch, self.steps, self.limits, self.unit = rows, tuple(group), width(step), method, batch, steps, limits, unit
        self.detectors = Registry(group)

    def run(self) -> Analysis:
        ticks, g = self.step.ticks(self.unit), self.group
        self.series = written(interpolate(self.rows, self.step, self.method, g, unit=self.unit, beyond=False), "series")
        batches = shapes.process(shapes.sliding(self.series, self.batch, g, self.unit))
        self.shapes = written(batches.withColumn("shape", shapes.resample(F.col("points"), self.steps)), "shapes")
        self.patterns = written(import_patterns(self.shapes, self.limits, g), "patterns")
        self.events = written(self.detectors.run(self.series), "events")
        known = self.patterns.select(*g, "pattern", F.lit(ticks).cast("long").alias("step"))
        self.correlations = written(signals.correlate(self.events, known, g), "correlations")
        self.occurrences = self.patterns.select(*g, "pattern", F.inline("occurrences"))
        self.signals = written(signals.signals(self.correlations, self.events, self.occurrences, g), "signals")
        return self

    def live(self, now: int) -> DataFrame:
        return signals.expire(self.signals, self.correlations, now, self.group)

    def probabilities(self, now: int) -> DataFrame:
        return signals.probabilities(self.signals, self.correlations, self.events, now, self.group)


def run_many(runs: Mapping[str, Analysis], at_once: int = 4) -> tuple[dict[str, Analysis], dict[str, Exception]]:
    """Runs of several tables, some at once: those that ended, and the errors of those that failed, which keep no other from ending."""
    done: dict[str, Analysis] = {}
    failed: dict[str, Exception] = {}

    def one(name: str) -> None:
        try:
            done[name] = runs[name].run()
        except Exception as e:  # whatever it is, it is this run's alone and is handed to the caller
            failed[name] = e

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(one, runs))
    return done, failed
