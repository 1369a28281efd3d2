"""Epoch grids: resolutions, bucket widths, and bucket arithmetic as columns.

Timestamps are integer epochs in a unit (s, ms, us or ns).  Steps under a second floor the epoch; steps of seconds and more take floored
whole seconds and divide toward zero, so before 1970 bucket 0 reaches one step to either side of the epoch.  A month is 30 days, a year 365.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NANOS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}
#: Steps of the resolutions in nanoseconds, from fine to coarse.
RESOLUTIONS = {
    "nanoseconds": 1, "microseconds": 1_000, "milliseconds": 1_000_000, "seconds": 10**9, "minutes": 60 * 10**9, "hours": 3600 * 10**9,
    "days": 86_400 * 10**9, "weeks": 7 * 86_400 * 10**9, "months": 30 * 86_400 * 10**9, "years": 365 * 86_400 * 10**9,
}
_SHORT = {"ns": "nanoseconds", "us": "microseconds", "ms": "milliseconds", "s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks", "mo": "months", "y": "years"}
RANK = {r: i for i, r in enumerate(RESOLUTIONS)}


def resolution(token: str) -> str | None:
    """The resolution that a token names (``s``, ``second``, ``seconds``), else None."""
    t = token.strip().lower()
    found = _SHORT.get(t) or (t if t in RESOLUTIONS else f"{t}s")
    return found if found in RESOLUTIONS else None


def div(a: Column, b: Column | int) -> Column:
    """Integer division toward zero."""
    if isinstance(b, int) and b == 1:
        return a
    return F.call_function("div", a, F.lit(b).cast("long") if isinstance(b, int) else b)


def floor_div(a: Column, n: int) -> Column:
    if n == 1:
        return a
    return div(a - F.pmod(a, F.lit(n).cast("long")), n)


@dataclass(frozen=True)
class Width:
    """``count`` units of a resolution, such as 5 seconds."""

    count: int
    unit: str

    @classmethod
    def parse(cls, token: str) -> Width | None:
        """``5s``, ``15 minutes``, ``minutes``; None for zero, a bare number, or anything else."""
        m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", token)
        unit = resolution(m[2]) if m else None
        count = int(m[1] or 1) if m else 0
        return cls(count, unit) if unit and count else None

    def __str__(self) -> str:
        short = next(k for k, v in _SHORT.items() if v == self.unit)
        return f"{self.count}{short}"

    @property
    def nanos(self) -> int:
        return self.count * RESOLUTIONS[self.unit]

    def ticks(self, unit: str = "us") -> int:
        """The width in ticks of a time unit."""
        if self.nanos % NANOS[unit]:
            raise ValueError(f"{self} is no whole number of {unit}")
        return self.nanos // NANOS[unit]


def width(w: Width | str) -> Width:
    found = Width.parse(w) if isinstance(w, str) else w
    if found is None:
        raise ValueError(f"not a bucket width: {w!r}")
    return found


def unit_index(ts: Column, res: str, unit: str = "us") -> Column:
    step, tick = RESOLUTIONS[res], NANOS[unit]
    if step >= 10**9:
        return div(floor_div(ts, 10**9 // tick), step // 10**9)
    return floor_div(ts, step // tick) if step >= tick else ts * F.lit(tick // step)


def bucket_index(ts: Column, w: Width | str, unit: str = "us") -> Column:
    w = width(w)
    return floor_div(unit_index(ts, w.unit, unit), w.count)


def bucket_start(index: Column, w: Width | str, unit: str = "us") -> Column:
    w = width(w)
    return index * F.lit(w.nanos // NANOS[unit]) if w.nanos >= NANOS[unit] else floor_div(index * F.lit(w.nanos), NANOS[unit])


def bucket(ts: Column, w: Width | str, unit: str = "us") -> Column:
    """Start of the bucket of ``ts``, as an epoch in the same unit."""
    return bucket_start(bucket_index(ts, w, unit), w, unit)


def index_of(ts: int, w: Width | str, unit: str = "us") -> int:
    """:func:`bucket_index` of a plain number."""
    w = width(w)
    step, nanos = RESOLUTIONS[w.unit], ts * NANOS[unit]
    if step < 10**9:
        return nanos // step // w.count
    seconds, size = nanos // 10**9, step // 10**9
    return (abs(seconds) // size * (1 if seconds >= 0 else -1)) // w.count


def nests(fine: Width | str, coarse: Width | str) -> bool:
    """Whether whole fine buckets make up each coarse one: both of whole seconds, and the coarse width a multiple."""
    a, b = width(fine), width(coarse)
    return a.nanos % 10**9 == 0 and b.nanos % 10**9 == 0 and b.nanos % a.nanos == 0 and (RESOLUTIONS[a.unit] >= 10**9) and (RESOLUTIONS[b.unit] >= 10**9)


def panel_width(start_ms: int, end_ms: int, interval_ms: int | None = None, max_points: int | None = None, budget: int = 11_000) -> int:
    """Bucket of a chart panel in ms: its interval, or as wide as its number of points asks; never under 1 ms nor over the budget of buckets."""
    span = max(0, end_ms - start_ms)
    points = min(max_points or budget, budget) or 1
    return max(interval_ms or 0, -(-span // points), 1)


def epoch(ts: str | Column, unit: str = "us") -> Column:
    """A zone-less timestamp column as an integer epoch, whatever the session's zone."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("give the column's name")
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "Z", "+00:00"):
        micros = F.unix_micros(F.col(f"`{name}`").cast("timestamp"))  # the same number in that zone, without decimals on the way
    else:
        micros = F.expr(f"cast(cast(cast(`{name}` as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(24,6)) * 1000000").cast("long")
    return micros if unit == "us" else micros * F.lit(1000) if unit == "ns" else floor_div(micros, NANOS[unit] // 1000)


def moment(ts: str, unit: str = "us") -> Column:
    """An integer epoch as a zone-less timestamp."""
    micros = f"cast(`{ts}` as decimal(30,6)) * {NANOS[unit]} / 1000000000"
    return F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({micros} as decimal(18,6)))")


#: Fixed value: a date and time with an offset, as RFC 3339 has it.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def instant(text: str, unit: str = "us") -> Column:
    """The epoch of an RFC 3339 text in any offset, to the microsecond; null stays null, anything else is an error."""
    t = F.col(f"`{text}`")
    at = F.unix_micros(F.try_to_timestamp(F.upper(F.regexp_replace(t, r"(\.\d{6})\d+", "$1"))))
    found = F.when(t.rlike(RFC3339), at)
    micros = F.when(t.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("not an RFC 3339 time: "), t)).cast("long")).otherwise(found)
    return micros if unit == "us" else micros * F.lit(1000) if unit == "ns" else floor_div(micros, NANOS[unit] // 1000)


def rfc3339(ts: str, unit: str = "us") -> Column:
    """An integer epoch as an RFC 3339 text in UTC, with six digits of the second."""
    return F.concat(F.date_format(moment(ts, unit), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def units_between(later: Column, earlier: Column, res: str, unit: str = "us") -> Column:
    """Whole steps of a resolution from ``earlier`` to ``later``, truncated toward zero."""
    step, tick = RESOLUTIONS[res], NANOS[unit]
    return div(later - earlier, step // tick) if step >= tick else (later - earlier) * F.lit(tick // step)


def convert_distance(value: Column, source: str, target: str) -> Column:
    """A distance in one resolution as whole steps of another."""
    a, b = RESOLUTIONS[source], RESOLUTIONS[target]
    return value * F.lit(a // b) if a % b == 0 else div(value.cast("decimal(38,0)") * F.lit(a), F.lit(b).cast("decimal(38,0)")).cast("long")
