"""Quantile sketches with bounded relative error, as two-level aggregations that Catalyst can merge.

A value falls into bin ceil(ln |v| / ln gamma) of its sign, gamma = (1 + a) / (1 - a); zeros have their own.  Counts per bin are the sketch;
they add up, in any order and on any machine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.operators.chunks import same_join

ALPHA, MOST_BINS = 0.01, 2048
#: Uniform collapses that are tried before giving up on a bound.
COLLAPSES = 12


def gamma(alpha: float = ALPHA) -> float:
    return (1 + alpha) / (1 - alpha)


def bin_of(value: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """Sign and bin of a value."""
    v = value.cast("double")
    return F.signum(v).cast("int"), F.when(v == 0, F.lit(0)).otherwise(F.ceil(F.log(F.abs(v)) / F.lit(math.log(gamma(alpha))))).cast("long")


def bins(df: DataFrame, keys: Sequence[str], value: str = "value", alpha: float = ALPHA) -> DataFrame:
    """keys, sign, idx, n: the sketch of each group."""
    sign, idx = bin_of(F.col(value), alpha)
    return df.where(F.col(value).cast("double").isNotNull()).select(*keys, sign.alias("sign"), idx.alias("idx")).groupBy(*keys, "sign", "idx").agg(F.count(F.lit(1)).alias("n"))


def binned_quantiles(parts: DataFrame, keys: Sequence[str], quantiles: dict[str, float], most: int) -> tuple[DataFrame, dict[str, Column]]:
    """``parts`` (keys, sign, bin, count), and for each quantile what an aggregation by ``keys`` makes of them: the place of its bin.

    Beyond ``most`` bins a sign those of the smallest magnitudes count as the lowest that stays.
    """
    part, sign = Window.partitionBy(*keys), Window.partitionBy(*keys, "sign")
    ran = parts.withColumn("_r", F.row_number().over(sign.orderBy(F.desc("bin"))))
    ran = ran.withColumn("_b", F.greatest("bin", F.max(F.when(F.col("_r") == most, F.col("bin"))).over(sign)))
    ran = ran.withColumn("_o", F.struct("sign", (F.col("sign") * F.col("_b")).alias("o")))
    # Bins that share a place are peers in this order, so each counts all of them.
    ran = ran.withColumn("_upto", F.sum("count").over(part.orderBy("_o"))).withColumn("_total", F.sum("count").over(part))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_total")))
    return ran, {a: F.min(F.when(F.col("_upto") >= rank(q), F.col("_o"))) for a, q in quantiles.items()}


def value_of_bin(place: Column, alpha: float = ALPHA) -> Column:
    return representative(place["sign"], place["sign"] * place["o"], gamma(alpha))


def merge_bins(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*keys, "sign", "idx").agg(F.sum("n").alias("n"))


def collapse_lowest(sketches: DataFrame, keys: Sequence[str], most: int = MOST_BINS) -> DataFrame:
    """At most ``most`` bins a sign: those of the smallest magnitudes join the lowest that stays."""
    w = Window.partitionBy(*keys, "sign").orderBy(F.desc("idx"))
    ranked = sketches.withColumn("_r", F.row_number().over(w))
    low = F.max(F.when(F.col("_r") == most, F.col("idx"))).over(Window.partitionBy(*keys, "sign"))
    return merge_bins(ranked.withColumn("idx", F.greatest("idx", low)).drop("_r"), keys)


def representative(sign: Column, idx: Column, g: float | Column) -> Column:
    g = F.lit(g) if isinstance(g, float) else g
    return F.when(sign == 0, F.lit(0.0)).otherwise(sign * 2 * F.pow(g, idx.cast("double")) / (g + 1))


def quantile_bins(sketches: DataFrame, keys: Sequence[str], quantiles: dict[str, float]) -> DataFrame:
    """keys, and for each quantile the bin (sign, idx) of nearest rank ceil(q n)."""
    order = F.struct(F.col("sign").alias("sign"), (F.col("sign") * F.col("idx")).alias("o"))
    part = Window.partitionBy(*keys)
    ran = sketches.withColumn("_o", order).withColumn("_upto", F.sum("n").over(part.orderBy("_o"))).withColumn("_total", F.sum("n").over(part))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_total")))
    return ran.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= rank(q), F.col("_o"))).alias(a) for a, q in quantiles.items()])


def sketch_quantiles(df: DataFrame, keys: Sequence[str], quantiles: dict[str, float], value: str = "value", alpha: float = ALPHA, most: int | None = MOST_BINS) -> DataFrame:
    """keys and approximate quantiles, each within ``alpha`` of the true value as long as no bin collapsed."""
    made = bins(df, keys, value, alpha)
    made = collapse_lowest(made, keys, most) if most else made
    found = quantile_bins(made, keys, quantiles)
    return found.select(*keys, *[representative(F.col(f"{a}.sign"), F.col(f"{a}.sign") * F.col(f"{a}.o"), gamma(alpha)).alias(a) for a in quantiles])


def uniform_quantiles(df: DataFrame, keys: Sequence[str], quantiles: dict[str, float], value: str = "value", alpha: float = ALPHA, most: int = MOST_BINS) -> DataFrame:
    """Quantiles of a uniformly collapsed sketch: bins 2j-1 and 2j join j until at most ``most`` are left.

    Besides the quantiles: collapses, and accuracy, the relative error that then holds: tanh(2**collapses atanh(alpha)).
    """
    if most < 4:
        raise ValueError("a sketch needs at least 4 bins")
    made = bins(df, keys, value, alpha)
    folded = lambda k: F.ceil(F.col("idx") / F.lit(float(1 << k))).cast("long")
    sizes = made.groupBy(*keys).agg(*[F.countDistinct(F.when(F.col("sign") != 0, F.struct("sign", folded(k)))).alias(f"_{k}") for k in range(COLLAPSES + 1)])
    times = F.coalesce(*[F.when(F.col(f"_{k}") <= most, F.lit(k)) for k in range(COLLAPSES + 1)], F.lit(COLLAPSES))
    made = same_join(made, sizes.select(*keys, times.alias("collapses")), keys)
    made = merge_bins(made.withColumn("idx", F.ceil(F.col("idx") / F.pow(F.lit(2.0), F.col("collapses"))).cast("long")), [*keys, "collapses"])
    found = quantile_bins(made, [*keys, "collapses"], quantiles)
    power = F.pow(F.lit(2.0), F.col("collapses"))
    g = F.pow(F.lit(gamma(alpha)), power)
    return found.select(*keys, "collapses", F.tanh(power * F.lit(math.atanh(alpha))).alias("accuracy"), *[representative(F.col(f"{a}.sign"), F.col(f"{a}.sign") * F.col(f"{a}.o"), g).alias(a) for a in quantiles])
