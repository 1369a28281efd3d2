"""Exact dedup by a log-structured merge index of text digests.

1. Each map task fills a *memtable* with (digest, identifier) pairs.  A full memtable is combined, sorted by
   digest and flushed as a run: one segment per digest shard, each with its own Bloom filter.
2. *Compaction* gathers the segments of a shard.  A segment's entries that no earlier filter
   knows are appended without a search; the others are looked up by binary search.  Runs are merged
   size-tiered.  For each digest the smallest identifier under the wanted order stays, and a count.
3. *Hits* (digests seen more than once) receive byte verification: each copy's text is compared with the
   text of the kept document.  Rows whose digest agrees but whose bytes don't are regrouped by their text.

Only digests and identifiers are shuffled, combined before they move; texts move only for hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import FILTER_BITS, Scratch, bloom_test, digests_of, heavy_light_join, own_columns, partitions, probes, shielded, without_copies

#: Copies that are compared with one shipped text of the kept document.
VERIFY_GROUP = 64
#: Runs that a shard holds before they are merged.
FAN_IN = 8

SEGMENT = "shard int, digests binary, ids binary, rows binary, counts binary, filter binary"
ENTRY = "digest binary, best_id long, best_row long, n long"


def bloom(keys: np.ndarray) -> bytes:
    bits = max(64, len(keys) * FILTER_BITS)
    field = np.zeros(bits, dtype=bool)
    field[probes(keys, bits).ravel()] = True
    return np.uint32(bits).tobytes() + np.packbits(field).tobytes()


def may_hold(filt: bytes, keys: np.ndarray) -> np.ndarray:
    bits = int(np.frombuffer(filt, "<u4", 1)[0])
    field, at = np.frombuffer(filt, np.uint8, offset=4), probes(keys, bits)
    return ((field[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def combine(digests: np.ndarray, ids: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sort by (digest, identifier) and keep the smallest identifier and the count of each digest."""
    order = np.lexsort((rows, ids, digests))
    digests, ids, rows, counts = digests[order], ids[order], rows[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], digests[1:] != digests[:-1]))) if len(digests) else np.zeros(0, np.int64)
    return digests[first], ids[first], rows[first], np.add.reduceat(counts, first) if len(first) else counts


def _shards(digests: np.ndarray, shards: int) -> np.ndarray:
    head = digests.view(np.uint8).reshape(-1, 32)[:, :8].copy().view(">u8").ravel()
    return ((head >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def flush_runs(shards: int, memtable_rows: int):
    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        digests, ids, rows, counts = combine(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        shard = _shards(digests, shards)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
        out = {k: [] for k in ("shard", "digests", "ids", "rows", "counts", "filter")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out["shard"].append(int(shard[a]))
            for k, x in (("digests", digests), ("ids", ids), ("rows", rows), ("counts", counts)):
                out[k].append(x[a:b].tobytes())
            out["filter"].append(bloom(digests[a:b]))
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("digests", "ids", "rows", "counts", "filter"))], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((digests_of(batch["digest"]), batch["ord"].to_numpy(zero_copy_only=False), batch["row"].to_numpy(zero_copy_only=False), np.ones(batch.num_rows, np.int64)))
                held += batch.num_rows
            if held >= memtable_rows:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


class Shard:
    """The runs of one digest shard, merged size-tiered."""

    def __init__(self):
        self.runs: list[list] = []  # [filter, digests, ids, rows, counts]

    def add(self, digests, ids, rows, counts, filt) -> None:
        fresh = np.ones(len(digests), bool)
        for run in self.runs:
            todo = np.flatnonzero(fresh)
            todo = todo[may_hold(run[0], digests[todo])] if len(todo) else todo
            if not len(todo):
                continue
            at = np.searchsorted(run[1], digests[todo])
            hit = (at < len(run[1])) & (run[1][np.minimum(at, len(run[1]) - 1)] == digests[todo])
            at, todo = at[hit], todo[hit]
            less = (ids[todo] < run[2][at]) | ((ids[todo] == run[2][at]) & (rows[todo] < run[3][at]))
            run[4][at] += counts[todo]
            run[2][at[less]], run[3][at[less]] = ids[todo[less]], rows[todo[less]]
            fresh[todo] = False
        if fresh.any():
            self.runs.append([filt if fresh.all() else bloom(digests[fresh]), digests[fresh], ids[fresh], rows[fresh], counts[fresh]])
        if len(self.runs) > FAN_IN:
            self.runs.sort(key=lambda r: -len(r[1]))
            while len(self.runs) > FAN_IN // 2:
                a, b = self.runs.pop(), self.runs.pop()
                merged = combine(*(np.concatenate((x, y)) for x, y in zip(a[1:], b[1:], strict=True)))
                self.runs.append([bloom(merged[0]), *merged])
                self.runs.sort(key=lambda r: -len(r[1]))

    def entries(self) -> tuple[np.ndarray, ...]:
        return combine(*(np.concatenate([r[k] for r in self.runs]) for k in range(1, 5)))


def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by shard -> entries of the digests that occur more than once."""

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        digests, ids, rows, counts = shard.entries()
        many = np.flatnonzero(counts > 1)
        if len(many):
            raw = digests[many].view("V32")
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in raw], pa.binary()), pa.array(ids[many]), pa.array(rows[many]), pa.array(counts[many])], names=["digest", "best_ord", "best_row", "n"])

    shard, at = Shard(), None
    for batch in batches:
        for r in batch.to_pylist():
            if at is not None and r["shard"] != at:
                yield from out(shard)
                shard = Shard()
            at = r["shard"]
            longs = [np.frombuffer(r[k], np.int64).copy() for k in ("ids", "rows", "counts")]
            shard.add(np.frombuffer(r["digests"], "V32").copy().view("S32"), *longs, r["filter"])
    if at is not None:
        yield from out(shard)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bits: int = 256, memtable_rows: int = 1 << 20, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts (null counts as empty; nothing is normalised) form a group of ``group_size`` rows, of which the row with the
    ``smallest`` or ``largest`` identifier stays.  A null identifier loses to any other; if a whole group has none, keep_id is null.
    Of rows that repeat both text and identifier exactly one is kept.  No rows give no rows; further columns are ignored.
    ``digest_bits`` under 256 shortens the index's digests; byte verification keeps the result exact.  ``scratch`` holds the index until the caller drops it.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    sign = {"smallest": 1, "largest": -1}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = F.sha2(text, 256)
    short = F.rpad(F.substring(sha, 1, digest_bits // 4), 64, "0")
    d = own_columns(docs, id_col, text_col)
    # The order is two's complement: ~id reverses it without overflow; a null comes last in both.
    order = F.coalesce(F.col("doc_id") if sign > 0 else F.bitwise_not("doc_id"), F.lit(2**63 - 1))
    log = scratch.table(d.select(F.col(id_col).cast("long").alias("doc_id"), sha.alias("text_sha256"), F.unhex(short).alias("digest"), F.monotonically_increasing_id().alias("row")), "log")
    total = log.count()
    shards = max(partitions(spark), total // 1_000_000 + 1)
    runs = log.select("digest", order.alias("ord"), "row").mapInArrow(flush_runs(shards, memtable_rows), SEGMENT)
    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard")
    index = scratch.table(dealt.mapInArrow(compact, ENTRY.replace("best_id", "best_ord")), "index")
    hits = heavy_light_join(log, index, "digest", "n", total, F.col("row")).withColumn("leads", F.col("row") == F.col("best_row"))

    # Byte verification: texts of hits only, compared with the leading document's text.
    salts = F.ceil(F.col("n") / VERIFY_GROUP).cast("int")
    probe = d.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body"), F.unhex(short).alias("digest"))
    probe = probe.where(bloom_test(index, "digest", index.count())(F.col("digest")))
    copies = heavy_light_join(probe, index.select("digest", "n", "best_ord"), "digest", "n", total, F.col("doc_id")).where("n is not null")
    copies = scratch.table(copies.withColumn("part", F.pmod(F.xxhash64("doc_id", "body"), salts).cast("int")), "copies")
    lead = copies.where(order == F.col("best_ord")).dropDuplicates(["digest"])
    lead = lead.select("digest", F.col("body").alias("lead_body"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("part"))
    differ = copies.join(lead, ["digest", "part"]).where(F.col("body").cast("binary") != F.col("lead_body").cast("binary"))
    mixed = scratch.table(differ.select("digest").distinct(), "mixed")
    if mixed.isEmpty():
        scratch.drop("copies")
        return _answer(hits, sign)
    # Some digests stand for several texts: their rows are grouped by the text itself.
    rows = scratch.table(copies.join(mixed, "digest", "left_semi").select("doc_id", "body", F.monotonically_increasing_id().alias("row")), "rows")
    best = rows.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(order.alias("o"), "row")).alias("b"))
    # Texts that agree in both of two long digests are equal; only these move on, never the texts.
    both = F.concat(F.sha2("body", 512), F.sha2("body", 256))
    best = best.select(both.alias("both"), "n", F.col("b.o").alias("best_ord"), F.col("b.row").alias("best_row"))
    again = heavy_light_join(rows.select("doc_id", "row", both.alias("both"), F.sha2("body", 256).alias("text_sha256")), best, "both", "n", total, F.col("row"))
    again = again.withColumn("leads", F.col("row") == F.col("best_row"))
    return _answer(hits.join(mixed, "digest", "left_anti"), sign).unionByName(_answer(again, sign))


def _answer(hits: DataFrame, sign: int) -> DataFrame:
    return hits.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(_id_of("best_ord", sign)).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("leads", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _id_of(order: str, sign: int):
    found = F.col(order) if sign > 0 else F.bitwise_not(F.col(order))
    return F.when(F.col(order) != F.lit(2**63 - 1), found)


def drop_exact_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops, with all their columns.

    Null texts count as empty, null identifiers lose to any other, and of rows that repeat both text and identifier one stays.  Further columns
    may have any names.
    """
    inner, restore = shielded(docs, "doc_id", "text")
    index = Scratch(docs.sparkSession, "exact-dedup")
    found = exact_dedup(inner, keep=keep, scratch=index).where("group_size > 1").groupBy("doc_id", "text_sha256")
    copies = found.agg(F.count(F.lit(1)).alias("reps"), F.max("kept").alias("stays")).withColumn("sha", F.unhex("text_sha256"))
    left = restore(without_copies(inner, copies, Scratch(docs.sparkSession, "exact-copies")))
    index.drop()  # what goes is written by now
    return left
