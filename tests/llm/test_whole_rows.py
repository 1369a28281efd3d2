"""Rows pass through the stages whole, whatever their other columns are called, and hot keys don't change what is found."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_llm_ops import prose
from test_pipeline import tables
from test_similar import brute_kept

from tempograin.llm import decontaminate, exact_dedup, quality, simhash
from tempograin.llm.common import Scratch, bloom_test, lookup, shielded
from tempograin.llm.graph import components

EXTRA = ("score", "predicted", "q_letters", "n_words", "n_hit", "items", "spans", "_sha", "_key", "_reps", "_row", "_maybe", "_own_0", "root", "node", "sha", "meta.x", "a`b", "fp", "reps", "stays")


def widened(docs):
    """``docs`` with columns that clash with what the operators use inside; their values follow from the identifier."""
    own = [F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in EXTRA]
    return docs.select("*", *own, F.struct(F.col("doc_id").alias("text"), F.lit(1).alias("b.c")).alias("nested"))


def test_columns_pass_through_all_stages(spark, tmp_path):
    tables(spark, tmp_path)
    folder = f"file://{tmp_path}"
    docs = widened(spark.read.parquet(f"{folder}/documents.parquet"))
    before = {r["doc_id"]: tuple(r) for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/wide-{k}")
        docs = spark.read.parquet(f"{folder}/wide-{k}")
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) > 200 and all(before[r["doc_id"]] == tuple(r) for r in rows), name
    assert {"doc_id", "taken"} <= set(corpus_pipeline.STAGES[4][1](spark, docs, folder).columns)


def test_operators_take_clashing_columns(spark):
    docs = widened(spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None), (None, "")], "doc_id long, text string"))
    kept = [tuple(r)[:3] for r in exact_dedup.drop_exact_copies(docs).collect()]
    assert Counter(r[0] for r in kept) == Counter([2, None]) and all(r[2] == f"score:{'-' if r[0] is None else r[0]}" for r in kept)
    assert sorted((r["doc_id"] or 0, r["meta.x"]) for r in simhash.drop_near_copies(docs).collect()) == [(0, "meta.x:-"), (1, "meta.x:1")]
    inner, restore = shielded(docs, "text")
    assert restore(quality.quality_scores(inner, quality.Rules())).columns == docs.columns
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    found = restore(decontaminate.benchmark_hits(inner, bench).where("n_hit = 4"))
    assert found.count() == 3 and found.columns == docs.columns


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, simhash.drop_near_copies, lambda d: corpus_pipeline.dedup_near(None, d, "")])
def test_rows_that_repeat_leave_one(spark, drop):
    """A third of all rows are one row, a third share its text."""
    text = prose(random.Random(5), 40)
    rows = [(7, text)] * 400 + [(i, text) for i in range(1000, 1400)] + [(i, f"{i} {prose(random.Random(i), 30, 9000)}") for i in range(2000, 2400)]
    left = drop(widened(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).select("doc_id").collect()
    assert len(left) == 401 and sum(r[0] < 2000 for r in left) == 1


def test_similar_groups_of_many_edits(spark):
    """Copies of one text with edits of their own, most of them near each other only through others, and a frame that many texts share."""
    rnd = random.Random(31)
    base, frame = prose(rnd, 120, 5000).split(), prose(rnd, 60, 5000)
    rows = []
    for i in range(260):
        w = base[:]
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(4000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"{frame} {prose(rnd, rnd.randint(3, 30), 9000)}") for i in range(260)]
    want = brute_kept(rows)
    got = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == want and 20 < len(want) < 400


def test_components_with_a_hub_and_a_large_component(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chains = spark.range(100_000).select((F.col("id") * 3 + 1_000_000).alias("a"), (F.col("id") * 3 + 1_000_001).alias("b"))
    roots = components(star.unionByName(chains), Scratch(spark, "hub"))
    assert roots.count() == 300_001 and roots.where("root = 0").count() == 100_001
    assert roots.where("root <> 0 and root <> node and root <> node - 1").count() == 0


def test_filter_and_lookup(spark):
    keys = spark.range(0, 5000, 5).select(F.xxhash64("id").alias("h"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("h"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("d"))
    for key in ("h", "d"):
        found = rows.where(bloom_test(keys, key, 1000)(F.col(key)))
        assert found.where("id % 5 = 0").count() == 1000 and found.count() < 1100
    left = Scratch(spark, "lookup").table(spark.range(9000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), "id"), "left")
    got = lookup(left, spark.range(1).select(F.col("id").alias("k"), F.lit("x").alias("v")), "k", F.col("id"))
    assert got.count() == 9000 and got.where("v = 'x'").count() == 6001 and got.columns == ["k", "id", "v"]


def test_no_rule_gives_the_constant_model():
    x, y = np.ones((200, len(quality.STATS))), np.arange(200) % 2
    model = quality.fit(x, y.astype(float))
    assert not model.rules and model.score(x[:1])[0] == pytest.approx(0.5)
