import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.operators import compress, detect, joins, shapes, signals, similarity
from tempograin.sources import formats, ilp


def line(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "ts long, value double")


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize("f,values,expected", [
    (lambda d: detect.crossings(d, 10.0), [1, 2, 3, 10, 11], [(2, 3)]), (detect.peaks, [1, 5, 1, 5, 1], [(0, 2), (2, 4)]), (lambda d: detect.peaks(d, everywhere=True), [1, 5, 1, 4, 1], [(0, 2), (2, 4)]),
    (detect.valleys, [5, 1, 5, 1, 5], [(0, 2), (2, 4)]), (lambda d: detect.valleys(d, everywhere=True), [5, 1, 5, 2, 5], [(0, 2), (2, 4)]), (lambda d: detect.crossings(d, 3.0, up=False), [10, 3, 8, 2, 1], [(0, 1), (2, 3)]),
    (lambda d: detect.drawdown(d, 0.2), [120, 100, 95], [(0, 2)]), (lambda d: detect.drawdown(d, 0.2), [0, 0, 0], []), (detect.peaks, [], []),
])
def test_detectors(spark, f, values, expected):
    assert spans(f(line(spark, values))) == expected


def test_registry(spark):
    r = detect.Registry().register_builtin("drawdown", fraction=0.2)
    assert spans(r.run(line(spark, [120, 100, 95]), 1)) == []
    with pytest.raises(ValueError):
        r.register_builtin("drawdown", fraction=0.1)


def test_slope_changes(spark):
    assert [r["value"] for r in shapes.slope_changes(line(spark, [0, 10, 20, 15, 10])).orderBy("ts").collect()] == [0, 20, 10]


def test_shapes_against_numpy(spark):
    y = [3.0, 5, 4, 4, 8, 1]
    d = shapes.process(shapes.sliding(line(spark, y).withColumn("ts", F.col("ts") * 7), 6, unit="s")).first()["points"]
    x = np.arange(6) * 7.0
    at = (x - x[0]) / (x[-1] - x[0])
    lev = np.array(y) - y[0] * (1 - at) - y[-1] * at
    keep = [i for i in range(6) if i in (0, 5) or np.sign(lev[i] - lev[i - 1]) != np.sign(lev[i + 1] - lev[i])]
    assert [p["x"] for p in d] == pytest.approx(list(x[keep] / x[-1]))
    assert [p["y"] for p in d] == pytest.approx(list(lev[keep] / (lev[keep].max() - lev[keep].min())))
    assert shapes.process(shapes.sliding(line(spark, [2, 2, 2]), 3, unit="s")).count() == 0


def test_affected_windows(spark):
    changes = spark.createDataFrame([(10, 12), (11, 11), (0, 0)], "lo long, hi long")
    got = {r[0] for r in shapes.affected_windows(changes, 0, 1, 3).collect()}
    assert got == {0, 8, 9, 10, 11, 12}
    assert {r[0] for r in shapes.affected_windows(changes, 0, 1, 3, latest=12).collect()} == {0, 8, 9, 10}


def test_constraints_and_dictionary(spark):
    one = spark.createDataFrame([([1.0, -2.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])], "a array<double>, b array<double>")
    say = lambda k, limit: [r[0] for r in one.select(similarity.constraint(k, F.col("a"), F.col("b"), limit)).collect()]
    assert say("max_static", 1)[0] and say("average_static", 1) == [False, False, True] and say("sum_absolute_static", 0)[0]
    assert say("max_percentile", 199) == [False, True, True] and say("average_percentile", 100) == [True, True, True]
    rows = spark.createDataFrame([(i, i, s) for i, s in enumerate([[0.0, 1.0], [0.05, 1.0], [5.0, 9.0], [0.0, 1.02]])], "begin long, end long, shape array<double>")
    got = {r["pattern"]: [o["begin"] for o in r["occurrences"]] for r in similarity.import_patterns(rows, {"average_static": 0.1, "max_static": 0.1}).collect()}
    assert got == {0: [0, 1, 3], 1: [2]}
    assert similarity.import_patterns(rows, None).agg(F.sum(F.size("occurrences"))).first()[0] >= 4


def test_signals(spark):
    men = spark.createDataFrame([("e", 100, 110), ("e", 200, 220), ("e", 290, 300)], "event string, start long, end long")
    occ = spark.createDataFrame([(1, 80, 90), (1, 140, 150), (1, 310, 320)], "pattern int, begin long, end long")
    cor = signals.correlate(men, occ.select("pattern").distinct().withColumn("step", F.lit(10).cast("long")))
    assert cor.first()["average_distance"] == 9  # (10 + 9) / 2, cut
    s = signals.signals(cor, men, occ)
    past = {(r["manifestation_start"], r["signal_type"]): (r["date"], r["distance"]) for r in s.where("not forward").collect()}
    assert past[(100, "start")] == (90, 1) and past[(200, "mid")] == (150, 6) and past[(290, "end")] == (150, 15) and len(past) == 9
    ahead = s.where("forward").collect()
    assert [(r["date"], r["signal_type"], r["distance"]) for r in ahead] == [(320, "start", 1)]
    assert signals.expire(s, cor, 325).count() == 1
    p = {r["signal_type"]: r for r in signals.probabilities(s, cor, men, 330).collect()}
    assert p["start"]["probability_sum"] == pytest.approx((24 + 18 + 18 + 1) / 9)


def test_tiers_and_sizes(spark):
    year = 365
    a = lambda s, **k: spark.range(1).select(compress.tier_aggressiveness(F.lit(8 * year), 7 * year, year, 10, s, **k)).first()[0]
    assert a("exponential") == 0.5 and a("linear") == pytest.approx(0.1) and a("custom", custom=[0.3]) == 0.3
    assert compress.required(100, 50, 10) == {"reduction": 0.5, "aggressiveness": 0.6, "rows": 5} and compress.estimated_rows(100, 0.5) == 53


def test_joins(spark):
    left = spark.createDataFrame([(1,), (5,), (9,)], "ts long")
    right = spark.createDataFrame([(2, "a"), (5, "b"), (20, "c")], "ts long, value string")
    for chunk in (1, 4, 1000):
        back = [(r["ts"], r["right_value"]) for r in joins.asof_join(left, right, chunk=chunk).orderBy("ts").collect()]
        assert back == [(1, None), (5, "b"), (9, "b")]
        ahead = [r["right_value"] for r in joins.asof_join(left, right, forward=True, tolerance=4, chunk=chunk).orderBy("ts").collect()]
        assert ahead == ["a", "b", None]
    spans_ = spark.createDataFrame([(0, 5), (4, 100)], "start long, end long")
    assert sorted((r["ts"], r["start"]) for r in joins.interval_join(left, spans_, 3).collect()) == [(1, 0), (5, 0), (5, 4), (9, 4)]


def test_line_protocol(spark):
    text = ['cpu,host=a,region=eu\\ west usage=1.5,n=42i,ok=t,s="x, y=\\"z\\"" 1700000000000000000', "# comment", "", "mem used=7u", "bad line here x y", "cpu v=1e5 10"]
    lines = spark.createDataFrame(list(enumerate(text)), "line long, value string")
    got = {r["line"]: r for r in ilp.parse_lines(lines).collect()}
    assert got[0]["tags"] == {"host": "a", "region": "eu west"} and got[0]["fields"]["s"]["text"] == 'x, y="z"' and got[0]["fields"]["n"]["kind"] == "integer"
    assert got[3]["fields"]["used"]["kind"] == "unsigned" and got[3]["ts"] is None and got[4]["error"] and set(got) == {0, 3, 4, 5}
    with pytest.raises(ValueError, match="line 4"):
        ilp.strict(ilp.parse_lines(lines))
    p = ilp.points(ilp.parse_lines(lines), "usage").collect()
    assert [(r["series_key"], r["ts"], r["value"]) for r in p] == [("host\x1fa\x1eregion\x1feu west", 1_700_000_000_000_000, "1.5")]


def test_formats(spark, tmp_path):
    d = spark.createDataFrame([(1, "1.50"), (2, None)], "ts long, value string").withColumn("value", F.col("value").cast("decimal(18,2)"))
    formats.write_csv(d, f"file://{tmp_path}/csv", header=True)
    back = formats.read_csv(spark, f"file://{tmp_path}/csv", header=True)
    assert sorted((r["ts"], r["value"] and float(r["value"])) for r in back.collect()) == [(1, 1.5), (2, None)]
    (tmp_path / "bad.csv").write_text("1,nan\n")
    with pytest.raises(Exception, match="finite"):
        formats.read_csv(spark, f"file://{tmp_path}/bad.csv").collect()
    (tmp_path / "power.csv").write_text("Date;Time;P\n1/2/2024;00:01:00;1.5\n1/2/2024;00:02:00;?\n")
    p = formats.read_columns(spark, f"file://{tmp_path}/power.csv", "Time", "P", sep=";", format="HH:mm:ss").collect()
    assert [r["value"] is None for r in p] == [False, True]
    assert formats.from_ipc(spark, formats.to_ipc(d)).count() == 2


def test_learned_steps(spark):
    ramp, saw = np.linspace(0, 1, 33), np.array([0.0, 1, 0, 1, 0])
    assert similarity.steps_for([ramp] * 10) == 2 and similarity.steps_for([saw] * 10) == 5 and similarity.steps_for([]) is None
    d = spark.createDataFrame([(i, ramp.tolist()) for i in range(5)], "begin long, shape array<double>")
    assert similarity.learned_steps(d) == 2
