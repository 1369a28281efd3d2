"""The whole analysis of two series against plain Python."""

import random
from collections import defaultdict

import pytest

from test_core_parts import brute_dictionary

from tempograin.plans.analysis import Analysis

STEP, BATCH, STEPS, LIMITS, THRESHOLD = 60, 6, 5, {"average_static": 0.25, "max_static": 0.5}, 50.0


def regular(points):
    points, out, k = sorted(points), [], 0
    for t in range(points[0][0], points[-1][0] + 1, STEP):
        while k + 2 < len(points) and points[k + 1][0] <= t:
            k += 1
        (a, x), (b, y) = points[k], points[k + 1]
        out.append((t, dict(points).get(t, x * (t - b) / (a - b) + y * (t - a) / (b - a))))
    return out


def shape(window):
    (x0, y0), (x1, y1) = window[0], window[-1]
    p = [(x - x0, y - y0 * (1 - (x - x0) / (x1 - x0)) - y1 * ((x - x0) / (x1 - x0)), abs(y) + abs(y0) + abs(y1)) for x, y in window]
    p = [(x, 0.0 if abs(y) <= 1e-13 * size else y) for x, y, size in p]  # a straight line has no shape
    sign = lambda v: (v > 0) - (v < 0)
    p = [q for i, q in enumerate(p) if i in (0, len(p) - 1) or sign(q[1] - p[i - 1][1]) != sign(p[i + 1][1] - q[1])]
    w, h = (max(q[k] for q in p) - min(q[k] for q in p) for k in (0, 1))
    if not w or not h:
        return None
    p, out = [(x / w, y / h) for x, y in p], []
    for i in range(STEPS):
        s = min(1.0, i / (STEPS - 1))
        (a, x), (b, y) = [q for q in p if q[0] <= s][-1], [q for q in p if q[0] >= s][0]
        out.append(x if a == b else x + (y - x) * (s - a) / (b - a))
    return out


def probabilities(points, now):
    series = regular(points)
    windows = [(series[i][0], series[i + BATCH - 1][0], shape(series[i : i + BATCH])) for i in range(len(series) - BATCH + 1)]
    ends = {b: e for b, e, _ in windows}
    assert any(s is None for _, _, s in windows)
    known = brute_dictionary([(b, s) for b, _, s in windows if s], LIMITS)
    events = {"peaks": [], "crossings": []}
    for (_, p), (t, v), (u, q), before in zip(series, series[1:], series[2:], [x[0] for x in series]):
        if p < v > q:
            events["peaks"].append((before, u))
    for (s, p), (t, v) in zip(series, series[1:]):
        if p < THRESHOLD <= v:
            events["crossings"].append((s, t))
    out = {}
    for name, men in events.items():
        if not men:
            continue
        mid = [s + (e - s) // 2 for s, e in men]
        gaps = [g for g in ((b[0] - a[0]) // STEP for a, b in zip(men, men[1:])) if g > 0]
        average = sum(gaps) // len(gaps) if gaps else None
        found = defaultdict(list)  # signal type -> (date, distance, base)
        for _, begins in known.values():
            occ, least = sorted(ends[b] for b in begins), None
            for k, (s, e) in enumerate(men):
                before = [o for o in occ if o < s]
                if before:
                    for kind, t in (("start", s), ("mid", mid[k]), ("end", e)):
                        found[kind].append((before[-1], (t - before[-1]) // STEP, mid[k - 1] if k else None))
                    d = (s - before[-1]) // STEP
                    least = d if d > 0 and (least is None or d < least) else least
            found["start"] += [(o, least, mid[-1]) for o in occ if o > men[-1][1] and least is not None]
        share = lambda since, avg: None if since is None else 0.0 if (now - since) // STEP <= 0 else (now - since) // STEP / avg if avg else None
        for kind, rows in found.items():
            rows = [r for r in rows if r[0] <= now]
            own = {"start": men[-1][0], "mid": mid[-1], "end": men[-1][1]}[kind]
            each = [[share(x, average if average is not None else d) for x in (date, base, own)] for date, d, base in rows]
            some = [[e[k] for e in each if e[k] is not None and e[k] > 0] for k in range(3)]
            out[name, kind] = (len(rows), sum(some[0]) if some[0] else None, *(sum(x) / len(x) if x else None for x in some[1:]))
    return out


def test_analysis_in_plain_python(spark):
    rnd = random.Random(6)
    rows = {g: sorted({rnd.randrange(5, 6000): None for _ in range(90)}) for g in ("a", None)}
    rows = {g: [(t, round(rnd.uniform(0, 100), 2)) for t in times] for g, times in rows.items()}
    d = spark.createDataFrame([(g, t, v, i) for g, points in rows.items() for i, (t, v) in enumerate(points)], "g string, ts long, value double, seq long")
    run = Analysis(d, ["g"], f"{STEP}s", "linear", BATCH, STEPS, LIMITS, "s")
    run.detectors.register_builtin("peaks", everywhere=True).register_builtin("crossings", threshold=THRESHOLD)
    for now in (4000, 7000):
        got = run.run().probabilities(now).collect()
        for g, points in rows.items():
            want = probabilities(points, now)
            mine = {(r["event"], r["signal_type"]): r for r in got if r["g"] == g}
            assert set(mine) == {k for k, v in want.items() if v[0]} and len(mine) == 6
            for k, r in mine.items():
                for x, y in zip((r["signals"], r["probability_sum"], r["probability_average"], r["event_probability"]), want[k], strict=True):
                    assert x is y is None or x == pytest.approx(y, rel=1e-9), (now, g, k, x, y)
