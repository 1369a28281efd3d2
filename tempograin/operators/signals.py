"""Correlations of events with patterns, the signals that follow, and probabilities.

Inputs: manifestations (group, event, start, end), occurrences (group, pattern, resolution ticks, begin, end).  Identifiers are natural keys.
Distances are whole steps of a pattern's resolution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.functions.grid import div
from tempograin.operators.chunks import CHUNK_ROWS, carried, same_join
from tempograin.plans.scratch import written

TYPES = ("start", "mid", "end")


def correlate(manifestations: DataFrame, patterns: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """group, event, pattern, step, average_distance for each event and pattern (group, pattern, step) of a group.

    average_distance is the integer mean of the positive gaps between consecutive starts, in the pattern's steps; null without any.  Gaps don't
    depend on the pattern but through its step, so they are summed once for each step.
    """
    w = Window.partitionBy(*group, "event").orderBy("start")
    gaps = manifestations.withColumn("gap", F.lead("start").over(w) - F.col("start"))
    kinds = patterns.select(*group, "step").distinct()
    met = same_join(gaps, kinds, group) if group else gaps.crossJoin(F.broadcast(kinds))  # resolutions are a handful
    steps = div(F.col("gap"), F.col("step"))
    means = met.groupBy(*group, "event", "step").agg(div(F.sum(F.when(steps > 0, steps)), F.nullif(F.count_if(steps > 0), F.lit(0))).alias("average_distance"))
    return same_join(means, patterns, [*group, "step"]).select(*group, "event", "pattern", "step", "average_distance")


def signals(correlations: DataFrame, manifestations: DataFrame, occurrences: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """group, event, pattern, signal_type, manifestation_start, date, distance, forward.

    Historical: the latest occurrence that ends before each manifestation starts predicts its start, middle and end, a distance away
    each.  Forward: occurrences that end after the event's last manifestation predict the next start by the least positive
    historical distance to one; manifestation_start is null then.  As-of matching replaces the pairing of all occurrences
    with all later manifestations, whose nearest pair it keeps.
    """
    key = [*group, "event", "pattern"]
    pairs = correlations.select(*key, "step", "average_distance")
    men = same_join(pairs, manifestations, [*group, "event"]).select(*key, "step", F.col("start").alias("t"), F.lit(1).alias("side"), "start", "end", F.lit(None).cast("long").alias("occ"))
    occ = same_join(pairs, occurrences.select(*group, "pattern", F.col("end").alias("occ")), [*group, "pattern"]).select(*key, "step", F.col("occ").alias("t"), F.lit(2).alias("side"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), "occ")
    # A manifestation comes before what occurs at the same instant, and carries no occurrence of its own.
    both = men.unionByName(occ).withColumnRenamed("t", "ts").withColumn("row", F.monotonically_increasing_id())
    both = written(both, "signals")  # it is read for the chunks, their summaries, the rows and what lies ahead
    occ, latest = both.where("side = 2"), both.where("side = 1").groupBy(*group, "event").agg(F.max("end").alias("latest"))
    # Patterns occur once a step or so, which bounds what a chunk of so many steps holds.
    both = carried(both, key, ["ts", "side", "row"], F.floor(F.col("ts") / (F.col("step") * CHUNK_ROWS)), {"before": F.col("occ")})
    at = {"start": F.col("start"), "mid": F.col("start") + div(F.col("end") - F.col("start"), 2), "end": F.col("end")}
    kinds = F.array(*[F.struct(F.lit(k).alias("signal_type"), div(x - F.col("before"), F.col("step")).alias("distance")) for k, x in at.items()])
    past = both.where("side = 1 and before is not null").select(*key, "step", F.col("start").alias("manifestation_start"), F.col("before").alias("date"), F.inline(kinds))
    least = past.where("signal_type = 'start' and distance > 0").groupBy(*key, "signal_type").agg(F.min("distance").alias("distance"))
    ahead = same_join(same_join(occ, latest, [*group, "event"]).where("occ > latest"), least, key)
    ahead = ahead.select(*key, "step", F.lit(None).cast("long").alias("manifestation_start"), F.col("occ").alias("date"), "signal_type", "distance")
    return past.withColumn("forward", F.lit(False)).unionByName(ahead.withColumn("forward", F.lit(True)))


def expire(found: DataFrame, correlations: DataFrame, now: int, group: Sequence[str] = ()) -> DataFrame:
    """Signals that aren't past: neither is their predicted instant, nor the manifestation's start plus the average distance."""
    met = same_join(found, correlations.select(*group, "event", "pattern", "average_distance"), [*group, "event", "pattern"])
    due = F.col("date") + F.col("distance") * F.col("step")
    again = F.col("manifestation_start") + F.col("average_distance") * F.col("step")
    return met.where((due > F.lit(now)) & (again.isNull() | (again > F.lit(now)))).drop("average_distance")


def probability(date: Column, average: Column, step: Column, now: int) -> Column:
    """Elapsed steps over the average distance; 0 before the date; null without an average; may pass 1."""
    passed = div(F.lit(now) - date, step)
    return F.when(passed <= 0, F.lit(0.0)).otherwise(passed.cast("double") / F.nullif(average, F.lit(0)).cast("double"))


def probabilities(found: DataFrame, correlations: DataFrame, manifestations: DataFrame, now: int, group: Sequence[str] = ()) -> DataFrame:
    """group, event, signal_type, signals, probability_sum, probability_average, event_probability at an instant.

    Signals dated later are ignored.  The sum adds each signal's probability, by its own distance where there is no average.  The average counts from the middle of the manifestation before a
    signal's own (the last one for forward signals) and skips what isn't positive.  The event's own form counts from the last
    manifestation's start, middle or end by type over the mean average distance.
    """
    key = [*group, "event", "pattern"]
    met = same_join(found.where(F.col("date") <= F.lit(now)), correlations.select(*key, "average_distance"), key)
    w = Window.partitionBy(*group, "event").orderBy("start")
    men = manifestations.withColumn("mid", F.col("start") + div(F.col("end") - F.col("start"), 2)).withColumn("mid_before", F.lag("mid").over(w))
    met = same_join(met, men.select(*group, "event", F.col("start").alias("manifestation_start"), "mid_before"), [*group, "event", "manifestation_start"], "left")
    last = men.groupBy(*group, "event").agg(F.max_by(F.struct("start", "mid", "end"), "start").alias("l"))
    met = same_join(met, last, [*group, "event"])
    met = met.withColumn("average_distance", F.coalesce("average_distance", "distance"))
    p = probability(F.col("date"), F.col("average_distance"), F.col("step"), now)
    base = F.when(F.col("forward"), F.col("l.mid")).otherwise(F.col("mid_before"))
    q = probability(base, F.col("average_distance"), F.col("step"), now)
    own = F.when(F.col("signal_type") == "start", F.col("l.start")).when(F.col("signal_type") == "mid", F.col("l.mid")).otherwise(F.col("l.end"))
    r = probability(own, F.col("average_distance"), F.col("step"), now)
    return met.groupBy(*group, "event", "signal_type").agg(F.count(F.lit(1)).alias("signals"), F.sum(F.when(p > 0, p)).alias("probability_sum"), F.avg(F.when(q > 0, q)).alias("probability_average"), F.avg(F.when(r > 0, r)).alias("event_probability"))
