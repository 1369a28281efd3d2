"""Scalars over time spans, slopes and prediction distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempograin.functions.grid import div


def duration(start: Column, end: Column) -> Column:
    return end - start


def midpoint(start: Column, end: Column) -> Column:
    return start + div(end - start, 2)


def contains(start: Column, end: Column, ts: Column) -> Column:
    return (start <= ts) & (ts <= end)


def slope(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rise over run in doubles; null over no run."""
    return (y1.cast("double") - y0.cast("double")) / F.nullif(x1.cast("double") - x0.cast("double"), F.lit(0.0))


def slope_sign(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.signum(slope(x0, y0, x1, y1)).cast("int")


def split_decision(prefix: int, suffix: int, new: int, floor: int) -> bool:
    """Whether a segment is worth cutting before late data: the prefix is at least the floor and larger than what is rewritten."""
    return prefix >= floor and prefix > suffix + new
