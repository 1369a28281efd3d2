"""The store's commits: all or nothing, once for a key, and without holes for readers."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from tempograin.plans.rollup import StoredRollups
from tempograin.sources import ilp, store as stores
from tempograin.sources.store import Aspect, Conflict, Store


def opened(spark, tmp_path, **how):
    store = Store(spark, f"file://{tmp_path}/store", **how)
    store.declare(Aspect("m", "scaled_i64", 2, unit="s"))
    return store


def points(spark, rows):
    return spark.createDataFrame([(t, str(v) if v is not None else None) for t, v in rows], "ts long, value string").withColumn("value", F.col("value").cast("decimal(18,2)"))


def held(store, **how):
    return sorted((r["ts"], float(r["value"])) for r in store.read("m", **how).collect())


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    store, p = opened(spark, tmp_path), points(spark, [(1, 1), (2, 2)])

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lost)
        with pytest.raises(RuntimeError):
            store.ingest("m", p, key="k")
    assert held(store) == [] and store.changes_since("m").count() == 0
    first = store.ingest("m", p, key="k")
    assert (first.seal_seq, first.replayed) == (0, False) and held(store) == [(1, 1.0), (2, 2.0)]
    again = Store(spark, store.root).ingest("m", p, key="k")  # another process, after a crash behind the commit
    assert again.replayed and again.seal_seq == 0 and held(store) == [(1, 1.0), (2, 2.0)]
    assert store.vacuum("m", older_than_ms=-60_000) == 1 and held(store) == [(1, 1.0), (2, 2.0)]


def test_writers_that_race_get_seals_of_their_own(spark, tmp_path):
    store, found = opened(spark, tmp_path), []

    def write(k):
        found.append(Store(spark, store.root).ingest("m", points(spark, [(10 * k + i, k) for i in range(5)]), key=f"k{k % 3}" if k < 3 else None).seal_seq)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == list(range(6)) and len(held(store)) == 30


def test_one_key_is_ingested_once_by_racing_writers(spark, tmp_path):
    store, found, p = opened(spark, tmp_path), [], points(spark, [(1, 1), (2, 2)])
    threads = [threading.Thread(target=lambda: found.append(Store(spark, store.root).ingest("m", p, key="k").replayed)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == [False, True, True, True] and held(store) == [(1, 1.0), (2, 2.0)]


def test_replace_and_clear_are_one_commit(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.ingest("m", points(spark, [(t, t) for t in range(10)]))
    before = store._log("m")
    receipt = store.replace("m", points(spark, [(4, 40)]), 3, 6, key="r")
    assert receipt.seal_seq == 1 and len(store._log("m")) == len(before) + 1
    assert held(store) == [(t, float(t)) for t in (0, 1, 2)] + [(4, 40.0)] + [(t, float(t)) for t in (7, 8, 9)]
    assert store.replace("m", points(spark, [(4, 40)]), 3, 6, key="r").replayed
    store.ingest("m", points(spark, [(5, 50)]))  # what comes later isn't cleared
    store.clear("m", None, 1)
    want = [(2, 2.0), (4, 40.0), (5, 50.0), (7, 7.0), (8, 8.0), (9, 9.0)]
    assert held(store) == want
    assert [tuple(r) for r in store.changes_since("m", 0).collect()] == [(1, 3, 6, 1), (2, 5, 5, 1), (3, None, 1, 0)]
    for rewrite in (store.reconcile, store.merge_overlaps, store.squash):
        rewrite("m")
        assert held(store) == want
    assert store._live(store._log("m"))[1] == []  # a rewrite has taken the cleared ranges out


def test_readers_keep_their_files_and_rewrites_don_t_lose_what_comes_meanwhile(spark, tmp_path, monkeypatch):
    store = opened(spark, tmp_path)
    store.ingest("m", points(spark, [(1, 1), (2, 2)]))
    reader = store.read("m")
    write, late = store._write, Store(spark, store.root)

    def slow(*a, **k):
        write(*a, **k)
        late.ingest("m", points(spark, [(3, 3)]))

    with monkeypatch.context() as m:
        m.setattr(store, "_write", slow)
        store.squash("m")
    assert reader.count() == 2 and held(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]

    def slower(*a, **k):
        write(*a, **k)
        late.squash("m")

    with monkeypatch.context() as m:
        m.setattr(store, "_write", slower)
        with pytest.raises(Conflict):
            store.squash("m")
    assert held(store) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_cold_segments_are_reconciled_alone(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.ingest("m", points(spark, [(2, 2), (1, 1)]).coalesce(1))
    store.ingest("m", points(spark, [(9, 9), (8, 8)]).coalesce(1))
    hot = store._log("m")[1]["attempt"]
    assert store.reconcile_all(cold_before=5) == {"m": True}
    assert hot in store._live(store._log("m"))[0] and len(store._live(store._log("m"))[0]) == 2 and len(held(store)) == 4


def test_snapshots_sum_up_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "SNAPSHOT", 3)
    monkeypatch.setattr(stores, "LITERAL", 2)
    store = opened(spark, tmp_path)
    for k in range(5):
        store.ingest("m", points(spark, [(k, k), (100, k)]), key=f"k{k}")
    assert [n for n in store._list("log/m") if n.startswith("snapshot")] == ["snapshot-000000000003.json"]
    assert [c["number"] for c in store._log("m")] == list(range(5)) and held(store, start=100) == [(100, 4.0)]
    assert store.ingest("m", points(spark, [(0, 0), (100, 0)]), key="k0").replayed


def test_time_to_live_and_pages(spark, tmp_path):
    now = [100]
    store = Store(spark, f"file://{tmp_path}/store", clock=lambda: now[0] * 10**9)
    store.declare(Aspect("m", "f64", unit="s", ttl_nanos=10 * 10**9))
    store.ingest("m", points(spark, [(t, t) for t in range(80, 100)]))
    assert [t for t, _ in held(store)] == list(range(90, 100)) and store.read_values("m", 0, 91.5).count() == 2
    now[0] = 105
    assert [t for t, _ in held(store)] == list(range(95, 100))
    assert StoredRollups(store, "m").materialize("10s").choose("10s", ["max"]) is None
    store.purge_expired("m")
    now[0] = 50
    assert [t for t, _ in held(store)] == list(range(95, 100))  # gone for good
    page, token = store.page("m", 3)
    assert [r["ts"] for r in page] == [95, 96, 97]
    rest, end = store.page("m", 3, token)
    assert [r["ts"] for r in rest] == [98, 99] and end is None
    with pytest.raises(ValueError, match="selection"):
        store.page("m", 3, token, start=1)
    store.ingest("m", points(spark, [(97, 7)]))
    with pytest.raises(ValueError, match="changed"):
        store.page("m", 3, token)


def test_catalog_size_and_refusals(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.ingest("m", points(spark, [(t, t) for t in range(100)]), most_rows_per_file=30)
    assert tuple(store.catalog().first()) == ("m", "scaled_i64", "s", 1, 100, 0, 99)
    size = store.size("m")
    assert size["rows"] == 100 and size["bytes_per_row"] == size["bytes"] / 100 > 0
    with pytest.raises(LookupError):
        store.interpolate("m", "1s", 1000, 1010, margin=5)
    with pytest.raises(ValueError, match="more than 50"):
        store.interpolate("m", "1s", 0, 99, "linear", most=50)
    whole = {(r["ts"], r["value"]) for r in store.interpolate("m", "1s", 0, 99, "linear").collect()}
    parts = [{(r["ts"], r["value"]) for r in p.collect()} for p in store.interpolated_parts("m", "1s", 0, 99, points=40, method="linear")]
    assert [len(p) for p in parts] == [40, 40, 20] and set().union(*parts) == whole


def test_rollups_of_a_store(spark, tmp_path):
    store = opened(spark, tmp_path)
    store.ingest("m", points(spark, [(t, t % 7) for t in range(200)]))
    tiers = StoredRollups(store, "m").materialize("10s", sketches=True)
    raw = lambda: sorted(map(tuple, store.downsample("m", "20s", ["max", "sum", "sketch_p50"]).collect()))
    got = lambda: sorted(map(tuple, tiers.downsample("20s", ["max", "sum", "sketch_p50"]).collect()))
    assert tiers.choose("20s", ["max", "sketch_p50"]) is not None and got() == raw()
    store.ingest("m", points(spark, [(35, 100), (41, 50)]))
    assert tiers.stale() == ["10s"] and tiers.choose("20s", ["max"]) is None and got() == raw()
    assert StoredRollups(store, "m").refresh() == ["10s"] and tiers.stale() == [] and tiers.choose("20s", ["max"]) is not None and got() == raw()
    store.replace("m", points(spark, [(70, 1)]), 60, 99)
    store.clear("m", 150)
    assert tiers.refresh() == ["10s"] and got() == raw()


def test_lines_are_refused_and_sealed(spark, tmp_path):
    store = opened(spark, tmp_path)
    lines = lambda *text: ilp.parse_lines(spark.createDataFrame(list(enumerate(text)), "line long, value string"))
    sealed = ilp.ingest_lines(store, "m", lines("cpu,host=a v=1.5 1000000000", "mem v=9 1000000000", "cpu,host=a v=2i 2000000000", "cpu,host=a w=1"), "cpu", "v", key="x")
    assert sealed.rows == 2 and held(store) == [(1, 1.5), (2, 2.0)] and store.read("m").first()["series_key"] == "host\x1fa"
    for text, match in ((["cpu,host=a v=1 1", "cpu,host=b v=2 2"], "line 1: .* more than one series"), (["cpu v=nan 1"], "line 0: .* finite"), (["mem v=1 1"], "no point"), (["cpu,__x=a v=1 1"], "line 0: tags"), (["cpu v=1 1", "cpu v="], "line 1")):
        with pytest.raises(ValueError, match=match):
            ilp.ingest_lines(store, "m", lines(*text), "cpu", "v")
    bad = lines("m v=1_0", "m v=１", "m v=1 99999999999999999999", "m v=1 1_0", "m v=9223372036854775808i", "m v=-1u", "m,=x v=1", "m v= 1", "m", "m v=1 1 1")
    assert bad.where("error is null").count() == 0 and bad.count() == 10
    good = {r["line"]: r["fields"]["v"]["text"] for r in lines("m v=+1.50", "m v=.5", "m v=1.", "m v=1E3", "m v=0.1000000000000000055", "m,t= v=+7i").collect()}
    assert good == {0: "1.5", 1: "0.5", 2: "1.0", 3: "1000.0", 4: "0.1", 5: "7"}


def test_declaring_twice_at_once(spark, tmp_path):
    store, failed = opened(spark, tmp_path), []

    def declare(scale):
        try:
            Store(spark, store.root).declare(Aspect("n", "scaled_i64", scale))
        except ValueError:
            failed.append(scale)

    threads = [threading.Thread(target=declare, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    time.sleep(0)
    assert len(failed) == 3 and store.aspect("n").scale not in failed


def test_only_changed_batches_are_handed_out(spark, tmp_path):
    from tempograin.streaming.ingest import Batches

    store = opened(spark, tmp_path)
    store.ingest("m", points(spark, [(t, t % 5) for t in range(0, 100, 2)]))
    queue = Batches(store, "m", "10s", 3)
    made, head = queue.unprocessed()
    assert made.count() == 8 and head == 0
    queue.done(made, head)
    assert queue.unprocessed()[0].count() == 0
    store.ingest("m", points(spark, [(44, 4)]))  # the value that is there already
    made, head = queue.unprocessed()
    assert made.count() == 0 and head == 1
    queue.done(made, head)
    store.ingest("m", points(spark, [(44, 99)]))
    made, head = queue.unprocessed()
    assert sorted(r["begin"] for r in made.collect()) == [20, 30, 40]
    queue.done(made, head)
    store.ingest("m", points(spark, [(105, 1)]))
    assert sorted(r["begin"] for r in queue.unprocessed()[0].collect()) == [80]


def test_runs_that_fail_fail_alone(spark):
    from tempograin.plans.analysis import Analysis, run_many

    good = spark.range(60).select(F.lit("g").alias("g"), (F.col("id") * 3600).alias("ts"), (F.col("id") % 7).cast("double").alias("value"), "id").withColumnRenamed("id", "seq")
    bad = good.withColumn("value", F.raise_error(F.lit("no")).cast("double"))
    runs = {n: Analysis(d, ["g"], "1h", "linear", 6, 4, {"average_static": 0.3}, "s") for n, d in (("a", good), ("b", bad), ("c", good))}
    for r in runs.values():
        r.detectors.register_builtin("peaks", everywhere=True)
    done, failed = run_many(runs)
    assert set(done) == {"a", "c"} and set(failed) == {"b"} and done["a"].patterns.count() > 0


def test_files_are_created_once_through_renames_too(spark, tmp_path):
    """As on file systems other than the local one, where a rename refuses to overwrite."""
    store = opened(spark, tmp_path)
    store._local = None
    assert store._put("x/a.json", {"n": 1}) and not store._put("x/a.json", {"n": 2}) and store._get("x/a.json") == {"n": 1}
    assert store._put("x/a.json", {"n": 3}, overwrite=True) and store._get("x/a.json") == {"n": 3} and store._list("x") == ["a.json"]
    store.ingest("m", points(spark, [(1, 1)]), key="k")
    assert store.ingest("m", points(spark, [(1, 1)]), key="k").replayed and held(store) == [(1, 1.0)]
