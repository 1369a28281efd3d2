"""Plumbing shared by the corpus operators: shared scratch tables and joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.plans.scratch import fresh

#: Keys with more than ``total / HEAVY`` rows are heavy; there can be at most HEAVY of them.
HEAVY = 4096
#: Rows of a heavy key are dealt to this many salts where they still have to move.
SALTS = 1024


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` frees one that is no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = fresh(spark, name)

    def table(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` once and read it back: later plans start from the files."""
        at = f"{self.path}/{name}"
        df.write.options(**options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, *names: str) -> None:
        """Remove the named tables, or all."""
        jvm = self.spark.sparkContext._jvm
        for name in names or ("",):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others with clashing names can do no harm."""
    return df.select(*[F.col(quoted(n)) for n in names])


def shielded(docs: DataFrame, *named: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``named`` renamed by position, and what gives a result those columns, and no others, under their own names.

    Columns with names that an operator uses inside, or with dots, so pass through it untouched.
    """
    inner = [n if n in named else f"_own_{i}" for i, n in enumerate(docs.columns)]
    return docs.toDF(*inner), lambda df: df.select(*[F.col(x).alias(n) for x, n in zip(inner, docs.columns, strict=True)])


def heavy_light_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, spread: Column, same: bool = False) -> DataFrame:
    """Left outer join of many rows per key to one row per key, whatever the skew.

    ``right`` has one row per ``key`` and in ``weight`` how many rows of ``left`` have it.  Keys with
    over ``total / HEAVY`` rows number at most HEAVY, so they are broadcast; rows of those keys
    then carry a salt and pass the shuffle join of the remaining keys evenly spread (by ``spread``) and
    unmatched.  ``left`` is read once.
    """
    values = [c for c in right.columns if c != key]
    heavy = right.where(F.col(weight) * HEAVY > total)
    light = right.where(F.col(weight) * HEAVY <= total)
    for c in values:
        heavy, light = heavy.withColumnRenamed(c, f"_h_{c}"), light.withColumnRenamed(c, f"_l_{c}")
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.when(F.col(f"_h_{weight}").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("long"))
    met = dealt.join(light.withColumn("_salt", F.lit(0).cast("long")), [key, "_salt"], "left")
    return met.select(*[F.col(c) for c in left.columns], *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values])


def lookup(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """:func:`heavy_light_join` of a written table whose rows by key aren't counted yet, to narrow rows."""
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return heavy_light_join(left, right.join(counted, key), key, "_n", left.count(), spread).drop("_n")


#: Bits of a filter for each key, probes of a key, and the bytes that a filter never exceeds; more keys only make it less selective.
FILTER_BITS, PROBES, FILTER_BYTES = 10, 7, 32 << 20


def digests_of(column: pa.Array) -> np.ndarray:
    """A column of 32-byte values as an array that compares whole values."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="V32").copy().view("S32") if raw else np.zeros(0, "S32")


def probes(digests: np.ndarray, bits: int, n: int = PROBES) -> np.ndarray:
    """Bit positions (rows x n) in a field of ``bits`` of digests of 32 bytes, or of 64-bit hashes."""
    with np.errstate(over="ignore"):
        if digests.dtype == np.int64:
            x = digests.view(np.uint64)
            x, y = x * np.uint64(0x9E3779B97F4A7C15), (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        else:
            x, y = digests.view("<u8").reshape(-1, 4)[:, :2].T
        return (x[:, None] + np.arange(n, dtype=np.uint64) * (y[:, None] | np.uint64(1))) % np.uint64(bits)


def bloom_test(keys: DataFrame, key: str, count: int) -> Callable[[Column], Column]:
    """What says of a column of 32-byte digests, or 64-bit hashes, whether each may be among ``keys``, of which there are about ``count``.

    The filter is broadcast.  Only that column passes through Python; others stay where they are.
    """
    bits = min(FILTER_BYTES * 8, max(1 << 16, -(-count * FILTER_BITS // 64) * 64))
    raw = lambda x: x.to_numpy(zero_copy_only=False) if pa.types.is_int64(x.type) else digests_of(x)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(probes(raw(batch[key]), bits).ravel())
                words, first = np.unique(at >> np.uint64(6), return_index=True)
                values = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(values.view(np.int64))], names=["word", "bits"])

    words = keys.select(key).mapInArrow(fill, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(bits // 64, np.uint64)
    field[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(field.tobytes())

    @F.arrow_udf("boolean")
    def may_be(column: pa.Array) -> pa.Array:
        at, held = probes(raw(column), bits), np.frombuffer(sent.value, np.uint64)
        return pa.array(((held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1), pa.bool_())

    return may_be


def sha_of(text: str = "text") -> Column:
    """SHA-256 of a text, null as empty, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def row_key(doc_id: str, sha: str) -> Column:
    """32 bytes for a row's identifier and the SHA-256 of its text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary"), F.lit(b" "), F.col(sha)), 256))


def without_copies(docs: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (doc_id, text and any others) less the rows that ``copies`` names.

    ``copies`` has a row for each (doc_id, sha) of which rows may go: ``reps`` (how many rows of ``docs`` have both) and ``stays`` (whether one of them
    stays).  Texts of rows that it doesn't name are neither shuffled nor written: a filter over the keys lets them by.  A key that
    very many rows repeat isn't shuffled either.  Of rows that repeat a key one stays.
    """
    inner, restore = shielded(docs, "doc_id", "text")
    listed = scratch.table(copies.select(row_key("doc_id", "sha").alias("_key"), "reps", "stays"), "listed")
    count, total, most = listed.agg(F.count("reps"), F.sum("reps"), F.max(F.when(F.col("stays"), F.col("reps")))).first()
    if not count:
        return docs
    named = inner.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_sha", sha_of()).withColumn("_key", row_key("_id", "_sha")).drop("_id", "_sha")
    named = named.withColumn("_maybe", bloom_test(listed, "_key", count)(F.col("_key")))
    met = heavy_light_join(named.where("_maybe"), listed, "_key", "reps", total, F.col("_key"))
    out = restore(named.where("not _maybe")).unionByName(restore(met.where("reps is null or (stays and reps = 1)")))
    if (most or 0) > 1:
        repeated = scratch.table(met.where("stays and reps > 1").withColumn("_row", F.monotonically_increasing_id()), "repeated")
        first = repeated.groupBy("_key").agg(F.min("_row").alias("_row")).select("_row")
        out = out.unionByName(restore(repeated.join(first, "_row", "left_semi")))
    return out
