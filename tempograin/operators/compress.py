"""Lossy compression: coarser resampling, slope simplification, and tiers by age or size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions.grid import RANK, RESOLUTIONS, Width
from tempograin.operators.interpolate import interpolate
from tempograin.operators.shapes import slope_changes

MOST, ENDS_ONLY = 0.95, 0.99


def coarser(original: str, base: str, aggressiveness: float) -> str:
    """The resolution that lies ``aggressiveness`` of the way from the original to the base one."""
    a, b = RANK[original], RANK[base]
    return list(RESOLUTIONS)[max(0, min(len(RESOLUTIONS) - 1, a + int((b - a) * aggressiveness)))]


def compress(df: DataFrame, aggressiveness: float, base: str, original: str, method: str | int = "cubic", group: Sequence[str] = (), unit: str = "us", arrival: str = "seq") -> DataFrame:
    """group, ts, value: as is at 0, both ends from ENDS_ONLY on, else resampled coarser and freed of points on even slopes."""
    kept = df.select(*group, "ts", F.col("value").cast("double").alias("value"), *[arrival] * (arrival in df.columns))
    if aggressiveness <= 0:
        return kept.select(*group, "ts", "value")
    if aggressiveness >= ENDS_ONLY:
        at = kept.groupBy(*group).agg(F.array(F.min(F.struct("ts", "value")), F.max(F.struct("ts", "value"))).alias("e"))
        return at.select(*group, F.inline(F.array_distinct("e")))
    made = interpolate(kept, Width(1, coarser(original, base, aggressiveness)), method, group, unit=unit, arrival=arrival)
    return slope_changes(made.select(*group, "ts", "value"), group)


def tier_aggressiveness(age: Column, pure: int, tier: int, tiers: int, scaling: str = "linear", base: float = 0.5, custom: Sequence[float] = ()) -> Column:
    """How hard data of an age is compressed: 0 while pure, then by its tier (from 1), never over MOST."""
    k = F.least(F.lit(tiers), F.floor((age - F.lit(pure)) / F.lit(float(tier))))
    if scaling == "linear":
        x = k / F.lit(float(tiers))
    elif scaling == "exponential":
        x = 1 - F.pow(F.lit(1 - base), k)
    elif scaling == "custom":
        x = F.coalesce(F.get(F.array(*[F.lit(float(c)) for c in custom]), k.cast("int") - 1), F.lit(MOST))
    else:
        raise ValueError(f"no such scaling: {scaling!r}")
    return F.when((age <= F.lit(pure)) | (k < 1), F.lit(0.0)).otherwise(F.least(F.lit(MOST), F.greatest(F.lit(0.0), x)))


def compress_by_age(df: DataFrame, now: int, pure: int, tier: int, tiers: int, base: str, original: str, scaling: str = "linear", method: str | int = "linear", group: Sequence[str] = (), unit: str = "us", arrival: str = "seq") -> DataFrame:
    """Each tier of age compressed by its own aggressiveness; one plan for all tiers."""
    aged = df.withColumn("_a", tier_aggressiveness(F.lit(now) - F.col("ts"), pure, tier, tiers, scaling))
    levels = [r[0] for r in aged.select("_a").distinct().orderBy("_a").collect()]  # at most ``tiers`` and one
    out = None
    for a in levels:
        part = compress(aged.where(F.col("_a") == F.lit(a)).drop("_a"), a, base, original, method, group, unit, arrival)
        out = part if out is None else out.unionByName(part)
    return df.select(*group, "ts", F.col("value").cast("double").alias("value")) if out is None else out


def required(current: int, target: int, count: int) -> dict[str, float]:
    """What a size target asks for: reduction, aggressiveness (a fifth more, for overhead), and how many rows may stay (2 at least)."""
    if current <= target:
        return {"reduction": 0.0, "aggressiveness": 0.0, "rows": count}
    share = target / current
    return {"reduction": 1 - share, "aggressiveness": min(MOST, (1 - share) * 1.2), "rows": max(2, int(count * share))}


def estimated_rows(count: int, aggressiveness: float) -> int:
    """Rows expected to stay: at full aggressiveness a twentieth."""
    return max(2, -int(-count * (1 - 0.95 * aggressiveness) // 1))


def compress_by_size(df: DataFrame, target_rows: int, base: str, original: str, method: str | int = "linear", group: Sequence[str] = (), unit: str = "us", arrival: str = "seq", parts: int = 4) -> DataFrame:
    """The oldest quarter (one of ``parts``) is compressed, then the next one with it, until the rows fit.

    If they still don't when all is compressed it goes on harder, at MOST and at last down to both ends of each series, which nothing can undercut.
    """
    rows = df.select(*group, "ts", F.col("value").cast("double").alias("value"), *[arrival] * (arrival in df.columns))
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("ts"), F.max("ts")).first()
    done = rows.select(*group, "ts", "value")
    if hi is None or hi <= lo:
        return done
    for least in (0.25, MOST, ENDS_ONLY):
        for k in range(1, parts + 1):
            if n <= target_rows:
                return done
            cut = lo + (hi - lo) * k // parts
            a = max(required(n, target_rows, n)["aggressiveness"], least)
            old = compress(rows.where(F.col("ts") <= F.lit(cut)), a, base, original, method, group, unit, arrival)
            done = old.unionByName(rows.where(F.col("ts") > F.lit(cut)).select(*group, "ts", "value"))
            n = done.count()
    return done
