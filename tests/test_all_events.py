"""Signals and affected windows over all events, against plain Python."""

import random
from datetime import datetime, timedelta

from tempograin import queries

HOUR, DAY = queries.HOUR, queries.DAY


def written(spark, tmp_path, n=700):
    rnd = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i * 2300 + rnd.randrange(2000)), rnd.randrange(9), rnd.choice(["click", "view"]), round(rnd.random() * 100, 2)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return [(t, u % 3, queries.BEGIN + (ts - start) // timedelta(microseconds=1)) for _, ts, u, t, _ in rows]


def test_every_event_is_an_occurrence(spark, tmp_path):
    rows = written(spark, tmp_path)
    folder = f"file://{tmp_path}"
    ends = {(t, p, ts - ts % HOUR + 3 * HOUR) for t, p, ts in rows}
    men, occ, cor = queries._relations(spark, folder)
    assert {(r["event_type"], r["pattern"], r["end"]) for r in occ.collect()} == ends
    starts = [(r["event_type"], r["start"]) for r in men.collect()]
    want = set()
    for t, s in starts:
        for p in range(3):
            before = [e for u, q, e in ends if (u, q) == (t, p) and e < s]
            if before:
                want.add((t, p, s, max(before), (s - max(before)) // HOUR))
    found = queries.QUERIES["signals_found"](spark, folder).where("signal_type = 'start' and not forward").collect()
    assert len(found) == len(want) > 100
    assert {(r["event_type"], r["pattern"], r["manifestation_start"], r["date"], r["distance"]) for r in found} == want
    assert {(r["event_type"], r["pattern"]) for r in cor.collect()} == {(t, p) for t, p, _ in ends}


def test_every_event_affects_windows(spark, tmp_path):
    rows = written(spark, tmp_path, 40)
    days = {ts - ts % DAY for *_, ts in rows}
    starts = [queries.BEGIN + i * HOUR for i in range(800)]
    want = {s for s in starts for lo in days if s <= lo + 2 * HOUR and lo <= s + 23 * HOUR <= queries.BEGIN + 29 * DAY}
    assert {r["window"] for r in queries.QUERIES["affected_windows"](spark, f"file://{tmp_path}").collect()} == want
