"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets come from weights with a ceiling for each source and the excess reshared.  A source's target is met by whole
epochs first; the rest is a weighted sample without replacement: each document has an exponential key, scaled by its
quality weight, and documents are taken in key order up to the budget.  Keys are hashes, so reruns agree.

No source is ever sorted as a whole.  The place of a key among its source's is a number of 52 bits.  Sums over its leading ten bits are
prefix-summed, which tells where the budget runs out; within that cell the next ten bits are looked at, until a cell is small enough to be sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, heavy_light_join, own_columns

#: Documents of a cell that are sorted, bits of a key's place, and bits that one level looks at.
BUCKET, PLACE, LEVEL = 2000, 52, 10
#: Weights by rank of the source's name.
CYCLE = (5.0, 2.0, 1.0)
SEED = 17


def words(text: Column) -> Column:
    """Number of runs of other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def quality_weight(text: Column) -> Column:
    """Sampling weight in (0, 1]: the share of characters that are letters or single separators, never under 0.05."""
    t = F.coalesce(text, F.lit(""))
    odd = F.length(t) - F.length(F.translate(t, "0123456789#$%&*@^~|<>{}[]\\/_=+!", ""))
    return F.greatest(F.lit(0.05), 1 - 4 * odd / F.greatest(F.length(t), F.lit(1)))


def draw_key(weight: Column, seed: int = SEED) -> Column:
    """Exponential with rate ``weight``, by a hash of doc_id and text: documents are taken by rising key."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def targets(sizes: DataFrame, total: float, ceiling: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """``sizes`` (source, source_size), one row a source, with the column target.

    Sources by code point, null last, weigh ``cycle`` over and over and share ``total`` by weight.  A target stops at ``ceiling`` times the
    source's size and the excess is reshared by weight until none is above.  The stop point of that loop is where, by
    rising size per weight, the first source stays under its ceiling at the level that those before leave; two running sums find it.
    There is one row a source here, and only here are they brought together.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(c) for c in cycle]), (rank % len(cycle) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", ceiling * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    s = s.withColumn("level", (F.lit(float(total)) - F.coalesce(F.sum("cap").over(by), F.lit(0.0))) / (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(by), F.lit(0.0))))
    under = F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("a"), F.col("source").isNull().alias("b"), "source", "level"))
    s = s.withColumn("level", F.min(under).over(everyone)["level"])
    return s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).select("source", "source_size", "target")


def mix(docs: DataFrame, share: float = 1.5, ceiling: float = 2.0, cycle: tuple[float, ...] = CYCLE, seed: int = SEED, weight: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, source, size, source_size, target, taken.

    ``size`` counts words (null: 0); ``taken`` is how many words the mix takes, whole copies of the document.  The document at which a
    budget runs out is taken if that brings the source nearer to its target.  ``weight`` is the quality weight,
    by default :func:`quality_weight`.  Null sources are one source; null identifiers are allowed; rows that repeat are
    separate documents.  No rows, or no words, give targets of 0.  Further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    d = own_columns(docs, "doc_id", "source", "text")
    weight = quality_weight(F.col("text")) if weight is None else weight
    sized = scratch.table(
        d.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), draw_key(weight, seed).alias("key"), F.monotonically_increasing_id().alias("row")), "sized"
    ).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sizes = scratch.table(sized.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"), F.avg("key").alias("mean_key")), "sizes")
    total, n = sizes.agg(F.sum("source_size"), F.sum("docs")).first()
    planned = targets(sizes.select("source", "source_size"), share * (total or 0), ceiling, cycle)
    plan = planned.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(sizes.select("name", "docs", "mean_key"), "name")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = scratch.table(plan.select("name", "docs", "source_size", "target", "epochs", "rest", "mean_key"), "plan")
    # 1 - exp(-key / mean) rises with the key and spreads over its range.
    place = F.least(F.floor((1 - F.exp(-F.col("key") / F.greatest(F.col("mean_key"), F.lit(1e-12)))) * F.lit(float(1 << PLACE))), F.lit((1 << PLACE) - 1)).cast("long")
    placed = scratch.table(heavy_light_join(sized, plan, "name", "docs", int(n or 0), F.col("row")).withColumn("place", place), "placed")
    scratch.drop("sized")

    # The cell of each source in which the budget runs out: its leading bits, and what lies before it.
    edge, shift, k = plan.select("name", "docs", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("before")), PLACE, 0
    while shift > 0:
        was, shift, k = shift, max(0, shift - LEVEL), k + 1
        at = heavy_light_join(placed.select("name", "size", "rest", "place", "row"), edge.withColumnRenamed("docs", "_docs"), "name", "_docs", int(n or 0), F.col("row"))
        inside = at.where(F.shiftright("place", was) == F.col("cell")).withColumn("cell", F.shiftright("place", shift))
        sums = inside.groupBy("name", "cell").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"), F.first("before").alias("before"), F.first("_docs").alias("docs"))
        upto = F.col("before") + F.sum("held").over(Window.partitionBy("name").orderBy("cell"))
        over = sums.withColumn("upto", upto).where("upto > rest").groupBy("name").agg(F.min_by(F.struct("docs", "cell", (F.col("upto") - F.col("held")).alias("before"), "rows"), "cell").alias("e"))
        edge = scratch.table(over.select("name", "e.docs", "e.cell", "e.before", "e.rows"), f"edge-{k}")
        most = edge.agg(F.max("rows")).first()[0]
        edge = edge.drop("rows")
        if (most or 0) <= BUCKET:
            break
    at = heavy_light_join(placed, edge.withColumnRenamed("docs", "_docs"), "name", "_docs", int(n or 0), F.col("row"))
    mine = F.shiftright("place", shift)
    order = Window.partitionBy("name").orderBy("key", "doc_id", "size", "row")
    inside = at.where(mine == F.col("cell")).withColumn("upto", F.col("before") + F.sum("size").over(order))
    inside = inside.withColumn("extra", (F.col("upto") - F.col("size") / 2.0 <= F.col("rest")) & (F.col("rest") > 0)).drop("upto")
    outside = at.where(F.col("cell").isNull() | (mine != F.col("cell"))).withColumn("extra", F.coalesce(mine < F.col("cell"), F.lit(True)) & (F.col("rest") > 0))
    return inside.unionByName(outside).select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("extra").cast("long")) * F.col("size")).alias("taken"))
