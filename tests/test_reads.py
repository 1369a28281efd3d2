import pytest
from pyspark.sql import functions as F

from tempograin.functions import decimals, tags
from tempograin.operators import reads
from tempograin.sources.store import Aspect, Store


def stored(spark, rows):
    return spark.createDataFrame([("a", "", t, v, s, i) for i, (t, v, s) in enumerate(rows)], "aspect string, series_key string, ts long, value double, seal_seq long, row_seq long")


ROWS = [(1, 10.0, 0), (1, 11.0, 0), (2, 20.0, 0), (3, 30.0, 0), (2, None, 1), (3, 31.0, 1), (3, 32.0, 1)]


def test_newest_seal_wins_and_keeps_its_repeats(spark):
    got = [(r["ts"], r["value"]) for r in reads.time_range(stored(spark, ROWS), 1, 3).orderBy("ts", "row_seq").collect()]
    assert got == [(1, 10.0), (1, 11.0), (2, None), (3, 31.0), (3, 32.0)]


def test_points_see_behind_nulls_and_keep_the_request(spark):
    got = [(r["ts"], r["value"]) for r in reads.points(stored(spark, ROWS), [2, 9, 3, 2]).orderBy("request").collect()]
    assert got == [(2, 20.0), (9, None), (3, 32.0), (2, 20.0)]
    with pytest.raises(ValueError):
        reads.points(stored(spark, ROWS), list(range(10_001)))


def test_value_band_is_raw(spark):
    assert reads.value_range(stored(spark, ROWS), 30, 31).count() == 2


def test_pages_and_cursor_tile_the_rows(spark):
    rows, seen, cursor = stored(spark, ROWS), [], None
    while True:
        page = reads.page(rows, 3, after=cursor)
        got = [(r["ts"], r["row_seq"]) for r in page.collect()]
        if not got:
            break
        seen += got
        cursor = reads.cursor_of(page)
    assert seen == sorted((t, i) for i, (t, _, _) in enumerate(ROWS))


def test_ttl_and_order(spark):
    assert [r["ts"] for r in reads.live(stored(spark, ROWS), 5, 2 * 10**9, "s").collect()] == [3, 3, 3]
    assert reads.live(stored(spark, ROWS), 3, 1, "s").agg(F.min("ts")).first()[0] == 2  # under a tick counts as one
    bad = reads.order_violations(stored(spark, [(1, 0.0, 0), (5, 0.0, 0), (4, 0.0, 0), (4, 0.0, 0)])).first()
    assert (bad["row_seq"], bad["previous"], bad["current"]) == (2, 5, 4)


def test_tags(spark):
    df = spark.createDataFrame([({"region": "eu", "host": "a"},), ({},), (None,)], "tags map<string,string>")
    keys = [r[0] for r in df.select(tags.series_key(F.col("tags"))).collect()]
    assert keys == ["host\x1fa\x1eregion\x1feu", "", ""]
    back = df.select(tags.tags_of(tags.series_key(F.col("tags")))).first()[0]
    assert back == {"region": "eu", "host": "a"}
    pick = lambda w, exact: [r[0] for r in df.select(tags.select_series(F.col("tags"), w, exact)).collect()]
    assert pick({"host": "a"}, False) == [True, False, False] and pick({"host": "a"}, True) == [False, False, False] and pick({"x": None}, False) == [True, True, True]


def test_decimals(spark):
    t = spark.createDataFrame([("1.25",), ("-3.75",), ("0.1",)], "v string").withColumn("v", F.col("v").cast("decimal(18,4)"))
    errors = [[float(r[0]), float(r[1])] for r in t.select(decimals.encoding_error(F.col("v"), "f64"), decimals.encoding_error(F.col("v"), "scaled_i64", 1)).collect()]
    assert errors[0][0] == errors[1][0] == 0 and errors[2][0] > 0 and errors[0][1] == pytest.approx(0.05) and errors[2][1] == 0
    with pytest.raises(Exception, match="tolerance"):
        t.select(decimals.checked(F.col("v"), "scaled_i64", 1)).collect()
    assert decimals.recommend_encoding(t.where("v > 1"), "v").first()[0] == "f32"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.declare(Aspect("m", "scaled_i64", 2, unit="s"))
    store.declare(Aspect("m", "scaled_i64", 2, unit="s"))
    with pytest.raises(ValueError):
        store.declare(Aspect("m", "f64", 2, unit="s"))
    with pytest.raises(KeyError):
        store.aspect("none")
    points = spark.createDataFrame([(1, "1.50"), (2, "2.25"), (3, None)], "ts long, value string").withColumn("value", F.col("value").cast("decimal(18,4)"))
    first = store.ingest("m", points, key="k")
    assert (first.seal_seq, first.rows, first.replayed) == (0, 3, False) and store.ingest("m", points, key="k").replayed
    with pytest.raises(ValueError):
        store.ingest("m", points.where("ts > 1"), key="k")
    with pytest.raises(Exception, match="tolerance"):
        store.ingest("m", points.withColumn("value", F.lit("0.001").cast("decimal(18,4)")))
    store.ingest("m", points.where("ts = 2").withColumn("value", F.lit("9.00").cast("decimal(18,4)")))
    read = lambda: [(r["ts"], r["value"] and float(r["value"])) for r in store.read("m").orderBy("ts").collect()]
    assert read() == [(1, 1.5), (2, 9.0), (3, None)]
    assert [r["rows"] for r in store.changes_since("m", 0).collect()] == [1]
    store.ack_changes("m", 0)
    store.ack_changes("m", -1)
    assert [r["seal_seq"] for r in store.pending_changes("m").collect()] == [1]
    for a, b in ((10, 20), (15, 30), (40, 50)):
        store.mark_dirty("m", a, b)
    assert store.dirty("m") == [(10, 30), (40, 50)]
    store.clear_dirty("m")
    assert store.dirty("m") == []
    for keep in (store.reconcile, store.merge_overlaps, store.squash):
        keep("m")
        assert read() == [(1, 1.5), (2, 9.0), (3, None)]
    assert [float(r["value"]) for r in store.read_points("m", [2]).collect()] == [9.0]
    store.clear("m", 2, 2)
    assert read() == [(1, 1.5), (3, None)]
    store.purge_expired("m", 4, 10**9)
    assert read() == [(3, None)]
    store.declare(Aspect("m", "text", 2, unit="s"))  # widening is allowed
    assert store.aspects() == ["m"]


def test_upsert_keys(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.declare(Aspect("u", unit="s", upsert_keys=("host",)))
    p = spark.createDataFrame([(1, 1.0, {"host": "a"})], "ts long, value double, tags map<string,string>")
    store.ingest("u", p)
    with pytest.raises(Exception, match="upsert"):
        store.ingest("u", p.withColumn("tags", F.create_map(F.lit("rack"), F.lit("b"))))
