"""SimHash near-dedup by pigeonhole blocks.

The 64 bits are cut into blocks.  Two fingerprints that differ in at most ``distance`` bits agree in at least ``blocks - distance``
whole blocks, so each choice of that many blocks is a join key and no close pair is missed.  Distinct fingerprints meet once
per key; Hamming distances are verified inside a key and only a spanning forest of the close pairs leaves it,
never all pairs.  Keys with very many fingerprints are instead linked through common midpoints: two fingerprints within
2r bits share a point within r bits of both, and grouping by that point costs time in proportion to their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, heavy_light_join, own_columns, partitions, sha_of, shielded, without_copies
from tempograin.llm.graph import components

BITS = 64
SEED = 42
#: Fingerprints under one key that are compared directly; more go through midpoints.
DIRECT = 16_384
TILE = 1024


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; fewer words than a shingle, or none, make one."""
    flat = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - width + 1].tolist()
    view, h = memoryview(flat), xxhash.xxh64_intdigest
    return np.array([h(view[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the text's word shingles as an unsigned 64-bit number; 0 without words."""
    words = words_of(text)
    return majority(shingle_hashes(words, width)) if words else 0


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sha"], pa.array(fps.view(np.int64))], names=["doc_id", "sha", "fp"])

    return run


def masks(distance: int, blocks: int) -> list[int]:
    """The bits of each join key: every choice of ``blocks - distance`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(x, y)) for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return [sum(c) for c in combinations(own, blocks - distance)]


def blocks_for(n: int, distance: int) -> int:
    """The fewest blocks whose keys are expected to pair each of n random fingerprints with at most four others."""
    for blocks in range(distance + 1, distance + 7):
        keys = masks(distance, blocks)
        if sum(n / 2.0 ** m.bit_count() for m in keys) <= 4:
            break
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect what is within ``distance`` among distinct fingerprints; at most one fewer than there are."""
    label = np.arange(len(fps))
    for i in range(0, len(fps), TILE):
        for j in range(i, len(fps), TILE):
            x, y = np.nonzero(np.bitwise_count(fps[i : i + TILE, None] ^ fps[None, j : j + TILE]) <= distance)
            x, y = x + i, y + j
            keep = x < y
            x, y = x[keep], y[keep]
            while len(x):  # hook the larger label under the smaller, then halve the paths
                a, b = label[x], label[y]
                apart = a != b
                if not apart.any():
                    break
                x, y, a, b = x[apart], y[apart], a[apart], b[apart]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]
    kids = np.flatnonzero(label != np.arange(len(fps)))
    return fps[kids], fps[label[kids]]


def _links(distance: int, direct: int):
    """Rows (key, block, fp) sorted by key and block -> links; ``b`` is null for a fingerprint whose key has more than ``direct``."""

    def crowd(fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.nulls(len(fps), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            fps = np.concatenate(parts)
            if len(fps) < 2 or (len(fps) == 2 and int(fps[0] ^ fps[1]).bit_count() > distance):
                return
            a, b = forest(fps, distance)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        parts, held, at = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, block = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "block"))
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1, [len(key)]))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                here = (key[x], block[x])
                if here != at:
                    if parts:
                        yield from done(parts)
                    parts, held, at = [], 0, here
                held += y - x
                parts.append(fps[x:y])
                if held > direct:  # this key's later ones follow at once, so that no key fills the memory
                    yield crowd(np.concatenate(parts))
                    parts = []
        if parts:
            yield from done(parts)

    return run


def midpoint_links(fps: DataFrame, distance: int) -> DataFrame:
    """Exact links in time proportional to the number of fingerprints: all that share a point within half the distance."""
    r = (distance + 1) // 2
    points = [0] + [sum(1 << b for b in c) for k in range(1, r + 1) for c in combinations(range(BITS), k)]
    flips = F.array(*[F.lit(_signed(p)) for p in points])
    near = fps.select(F.col("a"), F.explode(F.transform(flips, lambda m: F.col("a").bitwiseXOR(m))).alias("point"))
    least = near.groupBy("point").agg(F.min("a").alias("b"), F.max("a").alias("top")).where("b <> top")
    links = near.join(least, "point").where("a <> b").select("a", "b").distinct()
    # With an odd distance a shared point allows one bit more than wanted; such links are not given by this way.
    return links if distance % 2 == 0 else links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def close_links(reps: DataFrame, count: int, distance: int, scratch: Scratch, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) that connect all of ``count`` distinct fingerprints ``fp`` within ``distance`` bits, an even number."""
    spark, keys = reps.sparkSession, masks(distance, blocks_for(count, distance))
    cut = F.array(*[F.struct(F.lit(i).cast("int").alias("key"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("block")) for i, m in enumerate(keys)])
    blocks = reps.select("fp", F.inline(cut)).repartition(max(partitions(spark), count * len(keys) // 1_000_000 + 1), "key", "block")
    links = scratch.table(blocks.select("key", "block", "fp").sortWithinPartitions("key", "block").mapInArrow(_links(distance, direct), "a long, b long"), "links")
    edges = links.where("b is not null").distinct()
    crowd = links.where("b is null").select("a").distinct()
    if not crowd.isEmpty():
        edges = edges.unionByName(midpoint_links(scratch.table(crowd, "crowd"), distance))
    return edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, direct: int = DIRECT, with_sha: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed 64-bit), root (least fingerprint of its group), component_id
    (smallest doc_id reachable by links), component_size; with ``with_sha`` also sha (SHA-256 of the text).

    Texts lower-case A-Z and split at ASCII white space; null counts as empty, and texts without words have fingerprint zero.
    Rows may repeat; each has its answer.  A null identifier is no candidate for component_id, which is null
    only if no member has one.  No rows give no rows; further columns are ignored.  ``distance`` must be even.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "simhash")
    d = own_columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fps = scratch.table(d.withColumn("sha", sha_of() if with_sha else F.lit(None).cast("binary")).mapInArrow(_fingerprints(width), "doc_id long, sha binary, fp long"), "fingerprints")
    reps = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    total, count = (int(x or 0) for x in reps.agg(F.sum("n"), F.count("fp")).first())
    edges = close_links(reps, count, distance, scratch, direct)
    roots = components(edges, scratch)
    named = reps.join(roots, reps.fp == roots.node, "left").select("fp", "n", "least_id", F.coalesce("root", "fp").alias("root"))
    named = scratch.table(named, "named")
    many = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("n").alias("component_size"), F.count(F.lit(1)).alias("m")).where("m > 1")
    answer = heavy_light_join(named, many, "root", "m", count, F.col("fp"))
    answer = answer.select("fp", "n", "root", F.when(F.col("m").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component_size", "n").alias("component_size"))
    answer = scratch.table(answer, "answer")
    scratch.drop("distinct", "links", "named")
    out = heavy_light_join(fps, answer, "fp", "n", total, F.col("doc_id"))
    return out.select("doc_id", "fp", "root", "component_id", "component_size", *["sha"] * with_sha)


def hex_fingerprint(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(rows: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``rows`` (doc_id, sha, root; one row per row of ``docs``): the smallest doc_id (null last), then sha."""
    rows = scratch.table(rows.groupBy("root", "doc_id", "sha").agg(F.count(F.lit(1)).alias("reps")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    best = rows.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("members"), F.sum("reps").alias("reps")).where("reps > 1")
    met = heavy_light_join(rows.withColumn("own", order), best.select("root", "best", "members"), "root", "members", rows.count(), F.col("sha")).where("members is not null")
    return without_copies(docs, met.select("doc_id", "sha", "reps", F.col("own").eqNullSafe(F.col("best")).alias("stays")), scratch)


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of linked fingerprints, that with the smallest doc_id (null last), with all their columns.

    Null texts count as empty; of rows that repeat both text and identifier one stays.  Further columns may have any names.
    """
    inner, restore = shielded(docs, "doc_id", "text")
    work = Scratch(docs.sparkSession, "simhash")
    found = simhash_components(inner, with_sha=True, scratch=work, **how)
    left = restore(one_of_each(found.select("doc_id", "sha", "root"), inner, Scratch(docs.sparkSession, "simhash-copies")))
    work.drop()  # what goes is written by now
    return left
