"""The near-dedup stage against all pairs' exact similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest

from test_llm_ops import prose

from tempograin.llm import similar


def brute_kept(rows):
    """The (doc_id, text) that stay: of each linked group the smallest doc_id, null last."""

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    return {min((r for r, x in zip(rows, label, strict=True) if x == k), key=lambda r: (r[0] is None, r[0] or 0)) for k in set(label)}


def test_planted_near_copies(spark):
    rnd = random.Random(8)
    rows = [(i, prose(rnd, rnd.choice([4, 12, 60, 200]), 4000)) for i in range(120)]
    for i in range(120):  # from one changed word to many, so pairs lie on both sides of the threshold
        w = rows[i][1].split()
        for _ in range(rnd.randint(1, max(1, len(w) // 30))):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(9)}"
        rows.append((1000 + i, " ".join(w)))
    frame = " ".join(f"frame{i}" for i in range(90))
    rows += [(2000 + i, f"{frame} {prose(rnd, 5 if i % 2 else 60, 4000)}") for i in range(30)]
    rows += [(3000, None), (3001, ""), (3002, " \t"), (3003, "One two"), (3004, "one  two"), (None, "one two"), (None, "alone")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, lang string, size int")
    want = brute_kept(rows)
    assert 120 < len(want) < len(rows) - 40
    got = corpus_pipeline.dedup_near(spark, docs, "")
    assert got.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("forests", [0, 4])
def test_blocks_of_a_bucket_and_failing_links(spark, monkeypatch, forests):
    """Buckets compared two members at a time, sketches so narrow that they refute nothing, and every pair at once after ``forests`` rounds."""
    monkeypatch.setattr(similar, "FORESTS", forests)
    monkeypatch.setattr(similar, "BITS", 64)
    monkeypatch.setattr(similar, "sketch", lambda hashes: np.zeros(8, np.uint8))
    rnd = random.Random(3)
    rows = []
    for g in range(4):
        base = prose(rnd, 60, 4000).split()
        for i in range(14):
            w = base[:]
            for _ in range(rnd.randint(1, 3)):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(4000)}"
            rows.append((100 * g + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2, 4096):
        got = similar.drop_similar(docs, block=block).collect()
        assert {(r["doc_id"], r["text"]) for r in got} == brute_kept(rows)


def test_sketches_and_bands():
    rnd = np.random.default_rng(5)
    a, b = similar.permutations(similar.ROWS * similar.bands_for())
    found = 0
    for n in (10, 700, 3000, 9000):
        for _ in range(25):
            x = rnd.integers(0, 2**63, n, np.uint64)
            y = np.concatenate((x[: -(-8 * n // 9)], rnd.integers(0, 2**63, n - -(-8 * n // 9), np.uint64)))
            x, y = np.unique(x), np.unique(y)
            s, t = (similar.sketch(z).view(np.uint64).reshape(1, -1) for z in (x, y))
            words = min(s.shape[1], t.shape[1])
            apart = int(np.bitwise_count(similar.folded(s, words) ^ similar.folded(t, words)).sum())
            assert apart <= len(np.setxor1d(x, y))
            assert (similar.folded(s, 32) == (np.packbits((np.bincount((x >> np.uint64(24)).astype(np.int64) % 2048, minlength=2048) & 1).astype(np.uint8), bitorder="little").view(np.uint64))).all()
            found += bool((similar.band_keys(x, a, b) == similar.band_keys(y, a, b)).any())
    assert found >= 99 and 1 - (1 - 0.8**similar.ROWS) ** similar.bands_for() >= similar.SURE
