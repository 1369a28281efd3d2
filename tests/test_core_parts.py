"""Null groups, windows of large grids, chunks by rows, sketches in partials, dictionaries and size targets, against plain Python."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.operators import compress, detect, joins, reads, shapes, signals, similarity, sketch
from tempograin.operators.chunks import neighbours, same_join, with_chunks
from tempograin.operators.fill import fill
from tempograin.operators.interpolate import interpolate, interpolate_point
from tempograin.operators.reduce import coarsen, downsample, finish, merge, partials


def series(spark, rows):
    return spark.createDataFrame([(g, t, v, i) for i, (g, t, v) in enumerate(rows)], "g string, ts long, value double, seq long")


ROWS = [(g, t, float((t // 10 * 7) % 5 + k)) for k, g in enumerate(("a", None)) for t in (0, 10, 20, 50, 60, 90)]


def test_null_groups_are_groups(spark):
    d = series(spark, ROWS)
    for aggs in (["avg"], ["avg", "sketch_p50"], ["avg", "p50", "sketch_p50"], ["twa", "sketch_p99"]):
        got = downsample(d, "100s", aggs, ["g"], unit="s")
        assert {r["g"] for r in got.collect()} == {"a", None} and got.count() == 2
    at = interpolate(d, "5s", "linear", ["g"], 0, 90, unit="s").collect()
    assert len(at) == 38 and sum(r["g"] is None for r in at) == 19
    buckets = downsample(d, "10s", ["avg"], ["g"], unit="s")
    for method in ("null", "prev", "linear", "cubic", 0.0):
        assert fill(buckets, "10s", method, ["avg"], ["g"], unit="s").where("g is null").count() == 10, method
    assert detect.peaks(d, ["g"]).where("g is null").count() == detect.peaks(d, ["g"]).where("g = 'a'").count() > 0
    assert sketch.uniform_quantiles(d, ["g"], {"q": 0.5}).count() == 2
    men = spark.createDataFrame([(None, "e", 100, 110), (None, "e", 200, 220)], "g string, event string, start long, end long")
    occ = spark.createDataFrame([(None, 1, 80, 90), (None, 1, 310, 320)], "g string, pattern int, begin long, end long")
    cor = signals.correlate(men, occ.select("g", "pattern").distinct().withColumn("step", F.lit(10).cast("long")), ["g"])
    found = signals.signals(cor, men, occ, ["g"])
    assert cor.count() == 1 and found.where("not forward").count() == 6 and found.where("forward").count() == 1
    assert signals.expire(found, cor, 0, ["g"]).count() == 7 and signals.probabilities(found, cor, men, 400, ["g"]).count() == 3
    spans = spark.createDataFrame([(None, 5, 15), ("a", 55, 60)], "g string, start long, end long")
    assert sorted((r["g"] or "", r["ts"]) for r in joins.interval_join(d, spans, 7, ["g"]).collect()) == [("", 10), ("a", 60)]


def test_fill_of_nothing_and_of_a_window_of_a_long_grid(spark):
    none = downsample(series(spark, ROWS).where("false"), "10s", ["avg"], unit="s")
    assert [tuple(r) for r in fill(none, "10s", "null", ["avg"], start=0, end=20, unit="s").orderBy("bucket").collect()] == [(0, 0, None), (10, 0, None), (20, 0, None)]
    assert [r["avg"] for r in fill(none, "10s", 7.0, ["avg"], start=0, end=20, unit="s").collect()] == [7.0] * 3
    assert fill(none, "10s", "prev", ["avg"], start=0, unit="s").count() == 0
    year = 365 * 86_400
    ends = downsample(series(spark, [("a", 0, 1.0), ("a", 5 * year, None), ("a", 10 * year, 11.0), (None, 3, 5.0)]), "1s", ["avg"], ["g"], unit="s")
    got = fill(ends, "1s", "linear", ["avg"], ["g"], 5 * year - 2, 5 * year + 2, "s").orderBy("g", "bucket").collect()
    assert len(got) == 10 and [r["avg"] for r in got[5:]] == pytest.approx([6 + k * 10 / (10 * year) for k in range(-2, 3)], rel=1e-12) and all(r["avg"] is None for r in got[:5])
    assert {r["avg"] for r in fill(ends, "1s", "prev", ["avg"], ["g"], 5 * year, 5 * year + 1, "s").collect()} == {1.0, 5.0}


def test_chunks_hold_rows_not_ticks(spark):
    """One dense group among others: no chunk holds a tenth of its rows, and neighbours cross chunks."""
    n = 1_000_000
    d = spark.range(n).select(F.lit("dense").alias("g"), (F.col("id") + 1_700_000_000_000_000).alias("ts"), (F.col("id") % 97).cast("double").alias("value"))
    d = d.unionByName(spark.range(50).select(F.lit(None).cast("string").alias("g"), (F.col("id") * 86_400_000_000).alias("ts"), F.col("id").cast("double").alias("value")))
    sizes = with_chunks(d, ["g"], "c").groupBy("g", "c").count()
    assert sizes.agg(F.max("count")).first()[0] < n / 10 and sizes.where("g is null").count() == 1
    hit = detect.peaks(d, ["g"], everywhere=True)
    assert hit.count() == n // 97 and detect.crossings(d, 96.0, True, ["g"]).count() == n // 97
    r = neighbours(d, ["g"]).where("g = 'dense'").agg(F.count_if(F.expr("p is null")), F.count_if(F.expr("q is null")), F.max(F.col("ts") - F.col("pt")), F.max(F.col("qt") - F.col("ts"))).first()
    assert tuple(r) == (1, 1, 1, 1)
    at = joins.asof_join(d.where("ts % 1000 = 500"), d.where("ts % 1000 = 0"), ["g"]).where("g = 'dense'")
    assert at.count() == 1000 and at.where("ts - right_ts <> 500").count() == 0
    assert interpolate_point(d.where("g = 'dense'"), 1_700_000_000_000_000 + n // 2, "linear", ["g"]).first()["kind"] == "raw"


def test_sketches_merge_in_partials(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", None]), rnd.randrange(1000), rnd.choice([-1, 0, 1]) * rnd.random() ** 4 * 1000) for _ in range(4000)]
    d, q = series(spark, rows), ["sketch_p50", "sketch_p90", "sketch_p99"]
    whole = {(r["g"], r["bucket"]): r for r in downsample(d, "100s", ["min", "last", *q], ["g"], unit="s").collect()}
    a, b = (partials(d.where(F.col("seq") % 2 == k), "10s", ["g"], unit="s", sketches=True) for k in (0, 1))
    made = finish(coarsen(merge(a.unionByName(b), ["g"]), 10, ["g"]), "100s", ["min", "last", *q], ["g"], "s").collect()
    assert len(made) == len(whole) == 20 and all(tuple(whole[r["g"], r["bucket"]]) == tuple(r) for r in made)
    for (g, start), r in whole.items():
        mine = sorted(v for h, t, v in rows if h == g and start <= t < start + 100)
        for name, share in zip(q, (0.5, 0.9, 0.99), strict=True):
            true = mine[math.ceil(share * len(mine)) - 1]
            assert abs(r[name] - true) <= 0.0101 * abs(true)
    apart = sketch.sketch_quantiles(d.withColumn("bucket", F.col("ts") - F.col("ts") % 100), ["g", "bucket"], {"x": 0.9}, most=8)
    two = partials(d, "100s", ["g"], unit="s", sketches=True)
    ran, found = sketch.binned_quantiles(two, ["g", "idx"], {"x": 0.9}, 8)
    got = {(r[0], r[1] * 100): r[2] for r in ran.groupBy("g", "idx").agg(sketch.value_of_bin(found["x"])).collect()}
    assert got == {(r["g"], r["bucket"]): r["x"] for r in apart.collect()}
    with pytest.raises(ValueError):
        finish(partials(d, "10s", ["g"], unit="s"), "10s", ["sketch_p50"], ["g"], "s")


def brute_dictionary(rows, limits):
    def fits(a, b):
        if len(a) != len(b):
            return False
        for kind, limit in limits.items():
            x, y = ([abs(v) for v in a], [abs(v) for v in b]) if "_absolute" in kind else (a, b)
            share = lambda d, base: d / base * 100 if base else (0.0 if d == 0 else 10_000.0)
            measure, percent = kind.split("_")[0], kind.endswith("percentile")
            if measure == "sum":
                found = abs(sum(x) - sum(y))
                found = share(found, sum(y)) if percent else found
            elif measure == "max" and not percent:
                found = abs(max(x) - max(y))
            else:
                each = [share(abs(p - r), abs(r)) if percent else abs(p - r) for p, r in zip(x, y)]
                found = max(each) if measure == "max" else sum(each) / len(each)
            if not found <= limit:
                return False
        return True

    known = []
    for begin, shape in rows:
        hit = [k for k, (s, _) in enumerate(known) if fits(shape, s)]
        for k in hit:
            known[k][1].append(begin)
        if not hit:
            known.append((shape, [begin]))
    return {k: (s, spans) for k, (s, spans) in enumerate(known)}


@pytest.mark.parametrize("kind", similarity.CONSTRAINTS)
def test_dictionaries_under_every_constraint(spark, kind):
    rnd = random.Random(kind)
    rows = [(i, [rnd.choice([0.0, 1.0, rnd.uniform(-2, 3)]) for _ in range(rnd.choice([3, 3, 4]))]) for i in range(150)]
    limits = {kind: 60.0 if kind.endswith("percentile") else 0.8}
    d = spark.createDataFrame([(g, i, i + 1, s) for g in ("x", None) for i, s in rows], "g string, begin long, end long, shape array<double>")
    got = similarity.import_patterns(d.repartition(3), limits, ["g"]).collect()
    want = brute_dictionary(rows, limits)
    for g in ("x", None):
        assert {r["pattern"]: (list(r["shape"]), [o["begin"] for o in r["occurrences"]]) for r in got if r["g"] == g} == want
    pairs = spark.createDataFrame([(a, b) for (_, a), (_, b) in zip(rows, rows[1:]) if len(a) == len(b)], "a array<double>, b array<double>")
    for r in pairs.select("a", "b", similarity.constraint(kind, F.col("a"), F.col("b"), limits[kind]).alias("ok")).collect():
        assert r["ok"] == bool(similarity.holding(np.array(r["a"]), np.array([r["b"]]), limits)[0])


def test_dictionary_refusals_and_learning(spark):
    d = spark.createDataFrame([(i, i, [float(i), 0.0]) for i in range(10)], "begin long, end long, shape array<double>")
    with pytest.raises(ValueError):
        similarity.import_patterns(d, {"max": 1.0})
    with pytest.raises(Exception, match="more than 3 patterns"):
        similarity.import_patterns(d, {"max_static": 0.1}, most=3).collect()
    rnd, learned, known, want = random.Random(2), similarity.Learned(), [], {}
    rows = [(i, [rnd.gauss(i % 3 * 10, 0.5) for _ in range(4)]) for i in range(200)]
    for begin, shape in rows:
        a = np.array(shape)
        hit = learned.matches(a, np.array(known).reshape(-1, 4))
        for k in hit.tolist():
            want[k].append(begin)
        if not len(hit):
            want[len(known)] = [begin]
            known.append(a)
    got = similarity.import_patterns(spark.createDataFrame([(b, b, s) for b, s in rows], "begin long, end long, shape array<double>"), None).collect()
    assert {r["pattern"]: [o["begin"] for o in r["occurrences"]] for r in got} == want and len(want) < 100


def test_size_target_is_met_or_nothing_is_left_to_do(spark):
    rnd = random.Random(8)
    d = series(spark, [(g, 3600 * t, rnd.random()) for g in ("a", "b") for t in range(300)]).drop("seq")
    for target in (700, 600, 450, 200, 30, 1):
        out = compress.compress_by_size(d, target, "days", "hours", "linear", ["g"], "s")
        n = out.count()
        assert n <= target or n == 4, target  # both ends of both series
        first = out.groupBy("g").agg(F.min("ts"), F.max("ts")).collect()
        assert all(r[1] == 0 and r[2] == 3600 * 299 for r in first)
    assert compress.compress_by_size(d.where("false"), 1, "days", "hours", "linear", ["g"], "s").count() == 0


def test_value_bounds_keep_their_digits(spark):
    d = spark.createDataFrame([("a", "", 1, Decimal("20.00"), 0, 0), ("a", "", 2, Decimal("20.01"), 0, 1)], "aspect string, series_key string, ts long, value decimal(18,2), seal_seq long, row_seq long")
    assert reads.value_range(d, 20.005, 21).count() == 1 and reads.value_range(d, 20, 20.01).count() == 2 and reads.value_range(d, "-1e30", "1e30").count() == 2
    assert same_join(d.select("ts"), d.select(F.max("ts").alias("top")), []).where("top = 2").count() == 2


def test_sliding_windows_cross_runs(spark):
    rnd = random.Random(1)
    rows = [(g, 3 * t + rnd.randrange(3), float(t)) for g, n in (("a", 57), (None, 8), ("b", 4)) for t in range(n)]
    for size, run in ((5, 5), (5, 7), (3, 1000), (4, 1)):
        got = shapes.sliding(series(spark, rows), size, ["g"], "s", rows=run).collect()
        want = {}
        for g in ("a", None, "b"):
            mine = sorted((t, v) for h, t, v in rows if h == g)
            for k in range(len(mine) - size + 1):
                want[g, mine[k][0]] = (mine[k + size - 1][0], [(float(t), v) for t, v in mine[k : k + size]])
        assert {(r["g"], r["begin"]): (r["end"], [tuple(p) for p in r["points"]]) for r in got} == want and len(got) == len(want)


def test_signals_of_a_long_key_cross_chunks(spark, monkeypatch):
    rnd = random.Random(2)
    men = sorted({rnd.randrange(10_000) for _ in range(300)})
    occ = [(rnd.randrange(2), rnd.randrange(10_000)) for _ in range(700)]
    m = spark.createDataFrame([("e", s, s + 3) for s in men], "event string, start long, end long")
    o = spark.createDataFrame([(p, e - 5, e) for p, e in occ], "pattern int, begin long, end long")
    c = signals.correlate(m, o.select("pattern").distinct().withColumn("step", F.lit(10).cast("long")))
    want = {(p, s, max(e for q, e in occ if q == p and e < s)) for p in range(2) for s in men if any(q == p and e < s for q, e in occ)}
    for rows in (65_536, 20):
        monkeypatch.setattr(signals, "CHUNK_ROWS", rows)
        got = signals.signals(c, m, o).where("signal_type = 'start' and not forward").collect()
        assert {(r["pattern"], r["manifestation_start"], r["date"]) for r in got} == want and len(got) == len(want)


def test_rfc3339(spark):
    from tempograin.functions.grid import instant, rfc3339

    texts = ["2024-01-01T00:00:00Z", "2024-01-01t05:30:00.5+05:30", "1969-12-31T23:59:59.999999z", None, "2024-02-29T12:00:00.1234567-01:00"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(instant("t").alias("us"), instant("t", "s").alias("s"))
    assert [tuple(r) for r in d.collect()] == [(1_704_067_200_000_000, 1_704_067_200), (1_704_067_200_500_000, 1_704_067_200), (-1, -1), (None, None), (1_709_211_600_123_456, 1_709_211_600)]
    assert spark.range(1).select(F.lit(-1).cast("long").alias("x")).select(rfc3339("x")).first()[0] == "1969-12-31T23:59:59.999999Z"
    for bad in ("2024-01-01", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "now"):
        with pytest.raises(Exception, match="RFC 3339"):
            spark.createDataFrame([(bad,)], "t string").select(instant("t")).collect()
