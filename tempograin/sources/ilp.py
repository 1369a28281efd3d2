"""Line protocol: ``measurement[,tag=value…] field=value[,…] [timestamp]``.

Quoted strings and escapes need a small scanner, so lines are parsed in Arrow batches; everything after is DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.functions.grid import NANOS
from tempograin.functions.tags import series_key, valid_tags
from tempograin.plans.scratch import written
from tempograin.sources.store import Receipt, Store

#: The texts of booleans, and the grammar of numbers.
_BOOLEANS = ("t", "T", "true", "True", "TRUE", "f", "F", "false", "False", "FALSE")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])")
_ODD = ("inf", "-inf", "nan")
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)

RECORD = "line long, measurement string, tags map<string,string>, fields map<string,struct<kind:string,text:string>>, ts long, error string"


#: A piece up to a separator: escapes and, where they count, quoted strings are passed over whole.
_PIECES = {(at, q): re.compile(rf'((?:\\.|{string}[^\\{extra}{re.escape(at)}])*)({re.escape(at)}|\Z)', re.DOTALL) for at in ", =" for q, string, extra in ((False, "", ""), (True, r'"(?:\\.|[^"\\])*"|', '"'))}


def _split(text: str, at: str, quotes: bool = False) -> list[str]:
    """Pieces between unescaped separators, which count as text within quotes."""
    if "\\" not in text and not (quotes and '"' in text):
        return text.split(at)
    out, i = [], 0
    while True:
        m = _PIECES[at, quotes].match(text, i)
        if not m:
            raise ValueError("unterminated string or escape")
        out.append(m[1])
        if not m[2]:
            return out
        i = m.end()


def _plain(text: str) -> str:
    """A piece without the backslashes that escape; one at the very end stays."""
    return text if "\\" not in text else _ESCAPE.sub(r"\1", text)


def field_value(text: str) -> tuple[str, str]:
    """Kind (float, integer, unsigned, boolean, string) and text of a field's value; a float is the shortest decimal of the nearest double."""
    if len(text) >= 2 and text[0] == text[-1] == '"':
        return "string", _plain(text[1:-1])
    if text in _BOOLEANS:
        return "boolean", "true" if text[0] in "tT" else "false"
    if text[-1:] in ("i", "u") and _INTEGER.fullmatch(text, 0, len(text) - 1):
        n = int(text[:-1])
        low, high = (0, 2**64) if text[-1] == "u" else (-(2**63), 2**63)
        if not low <= n < high:
            raise ValueError(f"integer out of range: {text}")
        return "integer" if text[-1] == "i" else "unsigned", str(n)
    if not _FLOAT.fullmatch(text):
        raise ValueError(f"not a value: {text!r}")
    return "float", repr(float(text))


def parse_line(line: str) -> dict | None:
    """One record; None for an empty line or a comment; ValueError for a bad one."""
    text = line.strip()
    if not text or text[0] == "#":
        return None
    parts = [p for p in _split(text, " ", True) if p]
    if not 2 <= len(parts) <= 3:
        raise ValueError("a line has a measurement, fields and perhaps a timestamp")
    name, *tags = _split(parts[0], ",")
    if not name:
        raise ValueError("no measurement")

    def pairs(items: list[str], quotes: bool) -> list[tuple[str, str]]:
        out = []
        for item in items:
            key, *rest = _split(item, "=", quotes)
            if len(rest) != 1 or not key or (quotes and not rest[0]):
                raise ValueError(f"not a key and a value: {item!r}")
            out.append((_plain(key), rest[0]))
        return out

    ts = None
    if len(parts) == 3:
        if not _INTEGER.fullmatch(parts[2]) or not -(2**63) <= (ts := int(parts[2])) < 2**63:
            raise ValueError(f"not a timestamp: {parts[2]!r}")
    return {
        "measurement": _plain(name), "tags": {k: _plain(v) for k, v in pairs(tags, False)},
        "fields": {k: field_value(v) for k, v in pairs(_split(parts[1], ",", True), True)}, "ts": ts,
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (line number, value) as records; a bad line has an error and nothing else."""
    names = ["line", "measurement", "tags", "fields", "ts", "error"]

    def maps(held: list[dict | None], made) -> pa.MapArray:
        """Dicts as a map column, built from its flat parts."""
        ends, keys, values = [0], [], []
        for d in held:
            if d:
                keys += d
                values += d.values()
            ends.append(len(keys))
        return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), made(values))

    kinds = lambda v: pa.StructArray.from_arrays([pa.array([x[0] for x in v], pa.string()), pa.array([x[1] for x in v], pa.string())], ["kind", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for n, text in zip(batch["line"].to_pylist(), batch["value"].to_pylist(), strict=True):
                try:
                    r = parse_line(text or "")
                except ValueError as e:
                    out.append((n, None, None, None, None, str(e)))
                    continue
                if r:
                    out.append((n, r["measurement"], r["tags"], r["fields"], r["ts"], None))
            n, measurement, tags, fields, ts, error = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(measurement, pa.string()), maps(tags, lambda v: pa.array(v, pa.string())), maps(fields, kinds), pa.array(ts, pa.int64()), pa.array(error, pa.string())], names=names)

    made = lines.select(F.col("line").cast("long").alias("line"), "value").mapInArrow(run, RECORD)
    bad = F.col("error").isNotNull()
    return made.withColumn("tags", F.when(~bad, F.col("tags"))).withColumn("fields", F.when(~bad, F.col("fields")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a text file or folder.  Line numbers rise along the files."""
    return parse_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value"))


def strict(records: DataFrame) -> DataFrame:
    """Records if no line is bad; an error naming the first bad line otherwise.  Lines are parsed once, into a table."""
    records = written(records, "records")
    bad = records.where(F.col("error").isNotNull()).agg(F.min_by(F.struct("line", "error"), "line").alias("b")).first()["b"]
    if bad:
        raise ValueError(f"line {bad['line']}: {bad['error']}")
    return records


def points(records: DataFrame, field: str, precision: str = "ns", unit: str = "us") -> DataFrame:
    """measurement, series_key, tags, ts, value (text), seq of a numeric field; rows without the field or a timestamp are left out.

    A value that isn't finite is an error, also without a timestamp.
    """
    f = F.element_at("fields", field)
    rows = records.where(F.col("error").isNull() & f["kind"].isin("float", "integer", "unsigned"))
    ts = F.col("ts") * F.lit(NANOS[precision] // NANOS[unit]) if NANOS[precision] >= NANOS[unit] else F.call_function("div", F.col("ts") - F.pmod(F.col("ts"), F.lit(NANOS[unit] // NANOS[precision])), F.lit(NANOS[unit] // NANOS[precision]))
    value = F.when(f["text"].isin(*_ODD), F.raise_error(F.concat(F.lit("not a finite value: "), f["text"]))).otherwise(f["text"])
    made = rows.select("measurement", series_key(F.col("tags")).alias("series_key"), "tags", ts.alias("ts"), value.alias("value"), F.col("line").alias("seq"))
    return made.where(F.col("ts").isNotNull() | F.col("value").isNull())


class Refused(ValueError):
    """What a projection onto one series can't take: several series, values that aren't finite, no point at all."""


def one_series(records: DataFrame, field: str, precision: str = "ns", unit: str = "us", measurement: str | None = None) -> DataFrame:
    """:func:`points` of ``field`` by instant, if they are of one series at most; else Refused, naming the first line of the second one.

    ``measurement`` leaves out all others.  Records that give no point don't count, but a value that isn't finite is Refused.
    """
    records = records if measurement is None else records.where(F.col("measurement") == measurement)
    f = F.element_at("fields", field)
    odd = records.where((f["kind"] == "float") & f["text"].isin(*_ODD)).agg(F.min("line")).first()[0]
    records = records.where(~F.coalesce(f["text"].isin(*_ODD) & (f["kind"] == "float"), F.lit(False)))
    rows = points(records, field, precision, unit)
    first = rows.groupBy("measurement", "series_key").agg(F.min("seq").alias("line")).orderBy("line").limit(2).collect()
    if len(first) > 1 and (odd is None or first[1]["line"] < odd):
        named = [f"{r['measurement']} {r['series_key']!r}" for r in first]
        raise Refused(f"line {first[1]['line']}: {field!r} belongs to more than one series: {named[0]} (line {first[0]['line']}) and {named[1]}")
    if odd is not None:
        raise Refused(f"line {odd}: {field!r} isn't a finite number")
    return rows.orderBy("ts", "seq")


def ingest_lines(store: Store, aspect: str, records: DataFrame, measurement: str, field: str, precision: str = "ns", key: str | None = None) -> Receipt:
    """Seal the points of a measurement's field into a declared aspect, in its unit; their tags name the one series that they may belong to."""
    rows = one_series(strict(records), field, precision, store.aspect(aspect).unit, measurement)
    if rows.isEmpty():
        raise Refused(f"no point of {measurement!r} carries {field!r}")
    bad = rows.where(~valid_tags(F.col("tags"))).select("seq").limit(1).collect()
    if bad:
        raise Refused(f"line {bad[0][0]}: tags that no series may have")
    return store.ingest(aspect, rows.select("ts", "value", "tags", "seq"), key)
