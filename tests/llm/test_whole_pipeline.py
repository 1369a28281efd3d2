"""All stages against plain Python, the near-dedup stage by five words and a similarity of 0.8."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from test_pipeline import tables
from test_similar import brute_kept


def test_stages_in_plain_python(spark, tmp_path):
    texts, junk, leaks = tables(spark, tmp_path)
    folder = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/whole-{k}")
        docs = spark.read.parquet(f"{folder}/whole-{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert not kept[0] & junk and len(set(texts) - junk - kept[0]) <= 1
    by_text = {}
    for i in sorted(kept[0]):
        by_text[texts[i]] = i
    assert kept[1] == set(by_text.values())
    assert kept[2] == {i for i, _ in brute_kept([(i, texts[i]) for i in sorted(kept[1])])}
    assert {3000 + k for k in range(10)} & kept[1] and not {3000 + k for k in range(10)} & kept[2]  # copies with a word added
    assert kept[3] == kept[2] - leaks and kept[4] == kept[3]
    assert all(r["size"] == len(re.findall(r"\S+", texts[r["doc_id"]] or "")) for r in docs.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert {tuple(r) for r in whole.select("doc_id", "size", F.round("target", 6), "taken").collect()} == {tuple(r) for r in docs.select("doc_id", "size", F.round("target", 6), "taken").collect()}
