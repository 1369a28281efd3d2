"""A corpus from raw documents to a training mix, in five stages that each call one corpus operator.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; the driver
writes it as Parquet and rereads it as the next stage's ``docs``.  Rows may hold nulls, repeat or be missing altogether: no rows give no
rows, and each docstring states what else holds.  Columns beside doc_id, text and source may have any names; all stages but the last carry them along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, shielded
from tempograin.llm.decontaminate import WINDOW, benchmark_hits
from tempograin.llm.exact_dedup import drop_exact_copies
from tempograin.llm.mixing import mix
from tempograin.llm.quality import learn, quality_scores
from tempograin.llm.similar import drop_similar


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as quality 1; it learns from their labels, save the held-out third.

    Null and empty texts are scored as any other; rows that repeat are judged alike and stay or go together.
    """
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner, restore = shielded(docs, "text")
    return restore(quality_scores(inner, model).where("predicted = 1"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    Null counts as an empty text, a null doc_id loses to any other, and of rows that repeat both one stays.
    """
    return drop_exact_copies(docs, keep="largest")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles with a Jaccard similarity of 0.8 or more the row with the smallest doc_id.

    Operator 9's fingerprints and blocks retrieve, MinHash bands add what they can't, whole texts verify.  Null counts as an empty
    text, texts without words are alike, a null doc_id comes last, and of rows that repeat both doc_id and text one stays.
    """
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Goes: whoever holds windows of two items or more, or as many words in occurrences as a full window.  A single item that is
    shorter than a window may occur by chance: such documents stay as they are.  Null and empty texts stay.
    """
    inner, restore = shielded(docs, "text")
    found = benchmark_hits(inner, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restore(found.where((F.size("items") < 2) & (F.col("n_hit") < WINDOW)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; documents that it takes none of have 0.

    Null texts have no words, null sources are one source, and rows that repeat are separate documents.
    """
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("decontamination", decontaminate),
    ("source mix", mix_sources),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold ``run`` against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 0:
            scratch.drop(f"stage-{k - 1}")
    return docs
