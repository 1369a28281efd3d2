"""The pipeline's stages on a small corpus, against plain Python."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_llm_ops import brute_components, brute_fingerprint, prose


def tables(spark, tmp_path):
    rnd = random.Random(21)
    rows = [(i, prose(rnd, 60, 4000) + ".", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, "win now!! " * 30, "s0") for i in range(120)]
    copies = [(2000 + i, rows[i][1], "s1") for i in range(20)]
    near = [(3000 + i, rows[30 + i][1] + " ok", "s2") for i in range(10)]
    items = [(k, prose(rnd, 20, 9000)) for k in range(4)]
    leaks = [(4000 + k, f"{prose(rnd, 40, 4000)} {t} {prose(rnd, 10, 4000)}.", "s0") for k, (_, t) in enumerate(items)]
    docs = [(i, t, "en", s, len(t)) for i, t, s in rows + junk + copies + near + leaks] + [(5000, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, *_ in rows[::2]] + [(i, 0, 0) for i, *_ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {i: t for i, t, *_ in docs}, {i for i, *_ in junk}, {i for i, *_ in leaks}


def test_stages(spark, tmp_path):
    texts, junk, leaks = tables(spark, tmp_path)
    folder = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not kept[0] & junk and len(set(texts) - junk - kept[0]) <= 1  # only the empty one may go
    by_text = {}
    for i in sorted(kept[0]):
        by_text[texts[i]] = i
    assert kept[1] == set(by_text.values())
    fps = {i: brute_fingerprint(texts[i]) for i in kept[1]}
    roots = brute_components(set(fps.values()))
    least = {}
    for i in sorted(kept[1], reverse=True):
        least[roots[fps[i]]] = i
    assert kept[2] == set(least.values()) and kept[3] == kept[2] - leaks and kept[4] == kept[3]
    mixed = docs.collect()
    assert sum(r["taken"] for r in mixed) > 1.3 * sum(r["size"] for r in mixed) and all(r["taken"] <= 2 * r["size"] for r in mixed)
    assert all(r["size"] == len(re.findall(r"\S+", texts[r["doc_id"]] or "")) for r in mixed)


def test_run_and_no_rows(spark, tmp_path):
    tables(spark, tmp_path)
    folder = f"file://{tmp_path}"
    whole = corpus_pipeline.run(spark, folder)
    assert whole.agg(F.sum("taken")).first()[0] > 0
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
