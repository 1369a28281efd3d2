"""Readers and writers of series in JSON, CSV, Parquet and Arrow IPC.

Values travel as lossless decimal text unless a file is typed.  An empty CSV value is null; NaN and infinities are refused in every format.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tempograin.functions.decimals import is_decimal
from tempograin.functions.grid import instant
from tempograin.sources.store import Body, Receipt, Store

KIND = "decimal(38,18)"


def finite(text: Column, kind: str = KIND) -> Column:
    """Decimal text as a decimal: null stays null, what isn't a finite decimal is an error."""
    return F.when(text.isNull(), F.lit(None)).when(is_decimal(text), text.cast(kind)).otherwise(F.raise_error(F.concat(F.lit("not a finite decimal: "), text)))


def read_csv(spark: SparkSession, path: str, header: bool = False, kind: str = KIND) -> DataFrame:
    """``epoch,decimal`` lines as ts, value, seq."""
    raw = spark.read.schema("timestamp long, value string").option("header", header).option("mode", "FAILFAST").option("nullValue", "").csv(path)
    return raw.select(F.col("timestamp").alias("ts"), finite(F.trim("value"), kind).alias("value"), F.monotonically_increasing_id().alias("seq"))


def read_columns(spark: SparkSession, path: str, ts: str, value: str, sep: str = ",", kind: str = KIND, format: str | None = None) -> DataFrame:
    """Any delimited file with a header: ``ts`` is an epoch or, with ``format``, a time text; what isn't a number in ``value`` is null."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    at = F.col(f"`{ts}`").cast("long") if format is None else F.unix_micros(F.to_timestamp(f"`{ts}`", format))
    return raw.select(at.alias("ts"), F.col(f"`{value}`").try_cast(kind).alias("value"), F.monotonically_increasing_id().alias("seq"))


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    """ts, value (plain decimal text; null is empty)."""
    df.select(F.col("ts").alias("timestamp"), F.col("value").cast("string").alias("value")).write.option("header", header).option("nullValue", "").option("emptyValue", "").csv(path)


def read_json(spark: SparkSession, path: str, kind: str = KIND) -> DataFrame:
    """Ingest bodies ``{points: [{timestamp, value}], tags: {}, batch_id}`` as batch_id, tags, ts, value, seq."""
    raw = spark.read.schema("points array<struct<timestamp:long,value:string>>, tags map<string,string>, batch_id string").option("multiLine", False).option("mode", "FAILFAST").json(path)
    rows = raw.select("batch_id", "tags", F.posexplode("points").alias("seq", "p"))
    return rows.select("batch_id", "tags", F.col("p.timestamp").alias("ts"), finite(F.col("p.value"), kind).alias("value"), F.col("seq").cast("long").alias("seq"))


def ingest_json(store: Store, aspect: str, path: str, times: str = "epoch", most: int = 1000, kind: str = KIND) -> list[Receipt]:
    """Seal each ingest body of a file or folder by itself, in the order of batch_id: its rows_per_page bounds files, require_sorted refuses rows that go back, batch_id is its key.

    ``times`` says whether timestamps are epochs or RFC 3339 texts.  A body is a request, of which there may be ``most``; it is one line, which one task parses.
    All bodies are parsed once and sealed by the same few jobs.
    """
    fields = f"points array<struct<timestamp:{'long' if times == 'epoch' else 'string'},value:string>>, tags map<string,string>, batch_id string, rows_per_page long, require_sorted boolean"
    raw = store.spark.read.schema(fields).option("mode", "FAILFAST").json(path).withColumn("body", F.monotonically_increasing_id())
    bodies = raw.select("body", "batch_id", "rows_per_page", "require_sorted").orderBy("batch_id", "body").limit(most + 1).collect()
    if len(bodies) > most:
        raise ValueError(f"more than {most} bodies")
    rows = raw.select("body", "tags", F.posexplode("points").alias("seq", "p")).select("body", "tags", F.col("p.timestamp").alias("at"), finite(F.col("p.value"), kind).alias("value"), F.col("seq").cast("long").alias("seq"))
    rows = rows.withColumn("ts", F.col("at") if times == "epoch" else instant("at", store.aspect(aspect).unit)).drop("at")
    return store.ingest_bodies(aspect, rows, [Body(b["body"], b["batch_id"], bool(b["require_sorted"]), b["rows_per_page"]) for b in bodies])


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.col("ts").alias("timestamp"), F.col("value").cast("string").alias("value")).write.json(path)


def read_parquet(spark: SparkSession, path: str, kind: str = KIND) -> DataFrame:
    """timestamp and value (text, double, float or decimal) as ts, value, seq."""
    raw = spark.read.parquet(path)
    value = F.col("value") if raw.schema["value"].dataType.typeName() == "decimal" else finite(F.col("value").cast("string"), kind)
    return raw.select(F.col("timestamp").alias("ts"), value.alias("value"), F.monotonically_increasing_id().alias("seq"))


def write_parquet(df: DataFrame, path: str, typed: str = "string") -> None:
    df.select(F.col("ts").alias("timestamp"), F.col("value").cast(typed).alias("value")).write.parquet(path)


def to_ipc(df: DataFrame, unit: str = "us", most: int = 10_000_000) -> bytes:
    """A result as an Arrow IPC stream for a client; refused beyond ``most`` rows."""
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return _stream(table.schema, table.to_batches(), unit)


def _stream(schema: pa.Schema, batches: Iterable[pa.RecordBatch], unit: str) -> bytes:
    metadata, sink = {"time_unit": unit}, io.BytesIO()
    with pa.ipc.new_stream(sink, schema.with_metadata(metadata)) as w:
        for b in batches:
            w.write_batch(b.replace_schema_metadata(metadata))
    return sink.getvalue()


def from_ipc(spark: SparkSession, data: bytes) -> DataFrame:
    return spark.createDataFrame(pa.ipc.open_stream(data).read_all())


def write_arrow(df: DataFrame, path: str, unit: str = "us") -> None:
    """A result of any size as Arrow IPC streams, which its tasks write and the driver never holds: Parquet rows of a stream ``ipc`` each.

    A stream is one batch, as large as Spark hands it out; one more holds the schema alone, so that no rows are read back as such.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_stream(b.schema, [b], unit)], pa.binary())], ["ipc"])

    head = df.sparkSession.createDataFrame([(_stream(df.limit(0).toArrow().schema, [], unit),)], "ipc binary")
    df.mapInArrow(encode, "ipc binary").unionByName(head).write.parquet(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_arrow` wrote; one stream goes to the driver, for the schema."""
    raw = spark.read.schema("ipc binary").parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.column(0):
                yield from pa.ipc.open_stream(one.as_buffer())

    return raw.mapInArrow(decode, from_arrow_schema(pa.ipc.open_stream(bytes(raw.first()[0])).schema))
