"""Queries that write, ingest and read back, on events that share instants."""

import json
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempograin.queries import QUERIES
from tempograin.sources import formats
from tempograin.sources.store import Aspect, Store


def events(spark, tmp_path, n=120, instants=10, types=5):
    """n events on few instants, each with a value of its own."""
    at = f"file://{tmp_path}"
    e = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") % instants * 40_000_000_000).alias("ts"), F.lit(1).cast("long").alias("user_id"), F.concat(F.lit("t"), (F.col("id") % types).cast("string")).alias("event_type"), (F.col("id") / 4).alias("value"), F.lit("{}").alias("props"))
    e.write.parquet(f"{at}/events.parquet")
    return at, Counter((1_704_067_200_000_000 + k % instants * 40_000_000_000, k / 4) for k in range(n))


def test_stream_ingest_keeps_events_of_one_instant(spark, tmp_path):
    at, expected = events(spark, tmp_path)
    assert Counter(map(tuple, QUERIES["stream_ingest"](spark, at).collect())) == expected


def bodies(tmp_path, name, points):
    """A folder with a file of bodies: batch_id to (timestamp, value) pairs."""
    (tmp_path / name).mkdir()
    lines = [json.dumps({"batch_id": k, "tags": {"k": k}, "rows_per_page": 2, "require_sorted": True, "points": [{"timestamp": t, "value": v} for t, v in p]}) for k, p in points.items()]
    (tmp_path / name / "bodies.json").write_text("\n".join(lines))
    return f"file://{tmp_path}/{name}"


def new_store(spark, tmp_path, name):
    store = Store(spark, f"file://{tmp_path}/{name}")
    store.declare(Aspect("m", "scaled_i64", 2))
    return store


def test_bodies_share_their_jobs(spark, tmp_path):
    jobs = []
    for n in (2, 9):
        points = {f"b{k}": [(10 * k + i, str(k + i / 4)) for i in range(5)] for k in range(n)}
        points["empty"] = []
        at, store = bodies(tmp_path, f"in{n}", points), new_store(spark, tmp_path, f"store{n}")
        spark.sparkContext.setJobGroup(f"bodies-{n}", "")
        made = formats.ingest_json(store, "m", at)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bodies-{n}")))
        spark.sparkContext.setJobGroup("other", "")
        assert [(r.seal_seq, r.rows, r.replayed) for r in made] == [(k, 5 * (k < n), False) for k in range(n + 1)]
        again = formats.ingest_json(store, "m", at)
        assert [(r.seal_seq, r.rows, r.replayed) for r in again] == [(k, 5 * (k < n), True) for k in range(n + 1)]
        rows = store.read("m").select("series_key", "ts", F.col("value").cast("double"), "seal_seq").collect()
        assert Counter(map(tuple, rows)) == Counter((f"k\x1fb{k}", t, float(v), k) for k in range(n) for t, v in points[f"b{k}"])
        per_file = [r[0] for r in spark.read.parquet(f"file://{tmp_path}/store{n}/data").groupBy(F.input_file_name()).count().select("count").collect()]
        assert max(per_file) == 2
        # A body ingested by itself has the same fingerprint.
        alone = spark.createDataFrame([(t, v, i) for i, (t, v) in enumerate(points["b1"])], "ts long, value string, seq long").withColumn("value", F.col("value").cast("decimal(38,18)")).withColumn("tags", F.create_map(F.lit("k"), F.lit("b1")))
        assert store.ingest("m", alone, "b1").replayed
    assert jobs[0] == jobs[1]


def test_bodies_before_a_refused_one_are_sealed(spark, tmp_path):
    good = {f"b{k}": [(k, "1"), (k + 1, "2")] for k in range(5)}
    for name, bad, message in (("text", [(1, "x")], "not a finite decimal"), ("order", [(5, "1"), (4, "1")], "goes back from 5 to 4"), ("encoding", [(1, "0.001")], None)):
        store = new_store(spark, tmp_path, f"store-{name}")
        with pytest.raises(Exception, match=message):
            formats.ingest_json(store, "m", bodies(tmp_path, name, good | {"b3": bad}))
        assert {r[0] for r in store.read("m").select("series_key").collect()} == {"k\x1fb0", "k\x1fb1", "k\x1fb2"}
        made = formats.ingest_json(store, "m", bodies(tmp_path, f"{name}-mended", good))
        assert [r.replayed for r in made] == [True, True, True, False, False]
        with pytest.raises(ValueError, match="other points"):
            formats.ingest_json(store, "m", bodies(tmp_path, f"{name}-other", good | {"b1": [(1, "7")]}))


def test_json_ingested_keeps_events_of_one_instant(spark, tmp_path):
    at, expected = events(spark, tmp_path)
    rows = QUERIES["json_ingested"](spark, at).select("series_key", "ts", "value").collect()
    assert Counter((r.ts, r.value) for r in rows) == expected
    assert all(r.series_key == f"type\x1ft{int(4 * r.value) % 5}" for r in rows)


def test_arrow_streams_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    at, expected = events(spark, tmp_path)

    def refused(*_):
        raise AssertionError("rows came to the driver")

    monkeypatch.setattr(formats, "to_ipc", refused)
    assert Counter(map(tuple, QUERIES["arrow_round_trip"](spark, at).collect())) == expected
    d = spark.sql("SELECT * FROM VALUES (1, 1.50BD, 'a', array(1, NULL), timestamp'2024-01-01 00:00:00'), (NULL, NULL, NULL, NULL, NULL) AS t (a, b, c, d, e)").repartition(3)
    for name, rows in (("some", d), ("none", d.where("false"))):
        formats.write_arrow(rows, f"file://{tmp_path}/{name}", "ms")
        back = formats.read_arrow(spark, f"file://{tmp_path}/{name}")
        assert back.dtypes == d.dtypes and sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
        streams = [pa.ipc.open_stream(bytes(r[0])) for r in spark.read.parquet(f"file://{tmp_path}/{name}").collect()]
        assert {s.schema.metadata[b"time_unit"] for s in streams} == {b"ms"} and sum(s.read_all().num_rows for s in streams) == rows.count()
