"""Near copies by shingle similarity: SimHash blocks and MinHash bands retrieve, sketches choose, whole texts verify.

Fingerprints as :mod:`tempograin.llm.simhash` makes them, of five-word shingles, meet by pigeonhole blocks; what is within 4 bits is a candidate.  At a
Jaccard similarity of 0.8 two fingerprints differ in about ten of 64 bits, which no choice of blocks can retrieve at an affordable cost, so
bands of minima complete the search: texts at that similarity or above share a bucket with probability ``SURE``.

No pair is formed by a join.  The members of a bucket meet in one task with a sketch each, in blocks where they are many, and only a forest leaves
it that connects what the sketches can't tell apart.  Its links are verified on whole texts.  Where all of them hold the bucket is settled, for
whatever is similar in it is connected; a bucket with a link that fails goes through another round without that link.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, bloom_test, heavy_light_join, lookup, own_columns, partitions, sha_of, shielded
from tempograin.llm.graph import components
from tempograin.llm.simhash import close_links, majority, one_of_each, shingle_hashes, words_of

#: Words of a shingle, and the similarity from which texts are near copies, as a fraction of whole numbers.
WIDTH, SHARE = 5, (4, 5)
#: Bits within which fingerprints make a candidate.
DISTANCE = 4
#: Minima of a band, and the probability with which texts at the least similarity share one.
ROWS, SURE = 6, 0.9999
#: Least bits of a set's sketch.
BITS = 2048
#: Members of a bucket that one task compares with each other; a larger bucket is compared block by block.
BLOCK = 4096
#: Rounds in which a bucket sends a forest; one that still has failing links then sends all that are left.
FORESTS = 1
#: Links of one text that are verified with one shipped copy of it.
VERIFY_GROUP = 256


def bands_for(share: tuple[int, int] = SHARE, rows: int = ROWS, sure: float = SURE) -> int:
    return math.ceil(math.log(1 - sure) / math.log(1 - (share[0] / share[1]) ** rows))


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``n`` hash functions."""
    rnd = np.random.default_rng(20_240_101)
    return rnd.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rnd.integers(0, 2**63, n, np.uint64)


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band: a hash of its minima and its number."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), 512):
            np.minimum(least, (hashes[i : i + 512, None] * a + b).min(axis=0), out=least)
        low = (least >> np.uint64(24)).reshape(-1, rows)
        key = np.arange(1, len(low) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(rows):
            key = (key ^ low[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the members in each of some slots, at least twice as many as members: two sets differ in at least as many members as their sketches in bits.

    The number of slots is a power of two, so that the halves of a sketch, one laid on the other, are the sketch of half the slots.
    """
    slots = max(BITS, 1 << (2 * len(hashes) - 1).bit_length())
    at = (hashes >> np.uint64(24)).astype(np.int64) & (slots - 1)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) laid down to ``words``."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


class Bucket:
    """The members of one bucket (or two blocks of it), and which of them earlier links connect."""

    def __init__(self, nodes: np.ndarray, sizes: np.ndarray, roots: np.ndarray, bits: list[bytes], refuted: set[tuple[int, int]], share: tuple[int, int]):
        self.nodes, self.sizes, self.share = nodes, sizes, share
        self.label = np.unique(roots, return_inverse=True)[1]
        where = {int(n): i for i, n in enumerate(nodes)}
        self.refuted = np.array(sorted({where[a] * len(nodes) + where[b] for x, y in refuted if x in where and y in where for a, b in ((x, y), (y, x))}), np.int64)
        width = np.array([len(x) for x in bits]) // 8
        # Sets that may be similar have at most a quarter more members, so their sketches are as wide or twice as wide.
        self.classes = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        self.bits = {w: np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w) for w, at in self.classes.items()}

    def hopeful(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of members that nothing connects and that may be similar, and by which share of theirs they differ at least; some at a time."""
        p, q = self.share
        for w, at in self.classes.items():
            others, bits = at, self.bits[w]
            if 2 * w in self.classes:
                others, bits = np.concatenate((at, self.classes[2 * w])), np.concatenate((bits, folded(self.bits[2 * w], w)))
            few = max(1, 2048 // min(w, 64))
            for i in range(0, len(at), 512):
                mine = at[i : i + 512]
                for j in range(i // 1024 * 1024, len(others), 1024):
                    yours = others[j : j + 1024]
                    apart = self.label[mine][:, None] != self.label[yours]
                    if not apart.any():
                        continue
                    m = self.sizes[mine][:, None] + self.sizes[yours]
                    differ = np.zeros(apart.shape, np.int64)
                    for r in range(0, len(mine), few):
                        for k in range(0, w, 64):
                            differ[r : r + few] += np.bitwise_count(self.bits[w][i + r : min(i + r + few, i + 512), None, k : k + 64] ^ bits[None, j : j + 1024, k : k + 64]).sum(axis=2, dtype=np.int64)
                    least, most = np.minimum(self.sizes[mine][:, None], self.sizes[yours]), np.maximum(self.sizes[mine][:, None], self.sizes[yours])
                    x, y = np.nonzero(apart & (differ * (q + p) <= m * (q - p)) & (least * q >= most * p))
                    far = differ[x, y] / m[x, y]
                    x, y = mine[x], yours[y]
                    keep = x != y
                    if len(self.refuted):
                        keep &= ~np.isin(x * len(self.nodes) + y, self.refuted)
                    yield x[keep], y[keep], far[keep]

    def forest(self) -> list[tuple[int, int]]:
        """Links that connect whatever is hopeful, the likeliest of each block of members first; fewer than there are members."""
        out: list[tuple[int, int]] = []
        for x, y, far in self.hopeful():
            order = np.argsort(far, kind="stable")
            x, y = x[order], y[order]
            while True:
                a, b = self.label[x], self.label[y]
                apart = a != b
                if not apart.any():
                    break
                x, y, a, b = x[apart], y[apart], a[apart], b[apart]
                parent: dict[int, int] = {}

                def find(k: int) -> int:
                    while k in parent:
                        k = parent[k]
                    return k

                for k in np.unique(a, return_index=True)[1].tolist():  # the first link of each label
                    r, s = find(int(a[k])), find(int(b[k]))
                    if r != s:
                        parent[max(r, s)] = min(r, s)
                        out.append((int(self.nodes[x[k]]), int(self.nodes[y[k]])))
                names = np.arange(self.label.max() + 1)
                for k in parent:
                    names[k] = find(k)
                self.label = names[self.label]
        return out

    def every(self) -> list[tuple[int, int]]:
        return [(int(a), int(b)) for x, y, _ in self.hopeful() for a, b in zip(self.nodes[x], self.nodes[y], strict=True)]


MEMBER = "key long, i long, j long, node long, size long, root long, bits binary, other long"


def _compare(share: tuple[int, int], whole: bool):
    """Rows of MEMBER sorted by key and block -> (key, a, b); a row with ``other`` is a link of the bucket that failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(at: tuple, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(parts)
            failed = rows["other"].is_valid().to_numpy()
            nodes = rows["node"].to_numpy()
            refuted = set(zip(nodes[failed].tolist(), rows["other"].to_numpy(zero_copy_only=False)[failed].astype(np.int64).tolist(), strict=True)) if failed.any() else set()
            keep = np.flatnonzero(~failed)
            if len(keep) < 2:
                return
            bits = rows["bits"].to_pylist()
            bucket = Bucket(nodes[keep], rows["size"].to_numpy()[keep], rows["root"].to_numpy()[keep], [bits[k] for k in keep], refuted, share)
            links = bucket.every() if whole else bucket.forest()
            if links:
                a, b = (np.array(x, np.int64) for x in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), at[0])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["key", "a", "b"])

        parts: list[pa.RecordBatch] = []
        at: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch[c].to_numpy() for c in ("key", "i", "j")]
            cuts = np.concatenate(([0], np.flatnonzero(sum(np.diff(x) != 0 for x in names)) + 1, [batch.num_rows]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = tuple(int(n[x]) for n in names)
                if here != at:
                    if parts:
                        yield from done(at, parts)
                    parts, at = [], here
                parts.append(batch.slice(x, y - x))
        if parts:
            yield from done(at, parts)

    return run


def similar_roots(docs: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, distance: int = DISTANCE, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, sha (SHA-256 of the text), root, equal for all that links reach.

    Links are pairs of texts whose word shingles have a Jaccard similarity of ``share`` (numerator, denominator) or more: no others, and each of them
    is found with probability SURE at least.  Texts lower-case A-Z and split at ASCII white space; null counts as empty, and texts without words are
    alike.  Texts are told apart by 64 bits of the SHA-256 of their words, shingles by 64-bit hashes.  Rows may repeat and keep null
    identifiers; no rows give no rows; further columns are ignored.
    """
    spark, (p, q) = docs.sparkSession, share
    scratch = scratch or Scratch(spark, "similar")
    d = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", sha_of().alias("sha"))
    factors = permutations(ROWS * bands_for(share))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, fps, keys, bits = [], [], [], [], []
            for text in batch["text"]:
                words = words_of(text.as_py())
                whole = shingle_hashes(words, width)
                hashes = np.unique(whole)
                nodes.append(int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:8], "little", signed=True))
                sizes.append(len(hashes))
                fps.append(majority(whole) if words else 0)
                bits.append(sketch(hashes).tobytes())
                keys.append(band_keys(hashes, *factors))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), len(factors[0]) // ROWS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sha"], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), lists], names=["doc_id", "sha", "node", "size", "fp", "bits", "keys"])

    cuts = scratch.table(d.mapInArrow(cut, "doc_id long, sha binary, node long, size long, fp long, bits binary, keys array<long>"), "cuts")
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    # Fingerprints that are equal or close: each text with the least of its fingerprint, and those with each other.
    held = scratch.table(cuts.groupBy("fp").agg(F.min("node").alias("lead"), F.max("node").alias("most"), F.count(F.lit(1)).alias("n")), "fingerprints")
    rows, count = (int(x or 0) for x in held.agg(F.sum("n"), F.count("n")).first())
    alike = heavy_light_join(cuts.select("fp", "node"), held.where("lead <> most"), "fp", "n", rows, F.col("node")).where("node <> lead").select(pair("lead", "node"))
    close = scratch.table(close_links(held.select("fp"), count, distance, scratch), "close")
    # A fingerprint hangs from others in as many keys at most as it has; as a hub it may have any number.
    close = lookup(close, held.select(F.col("fp").alias("b"), F.col("lead").alias("lead_b")), "b", F.col("a"))
    close = close.join(held.select(F.col("fp").alias("a"), F.col("lead").alias("lead_a")), "a").select(pair("lead_a", "lead_b"))

    # Buckets that several texts share, and their members.
    every = cuts.select("node", F.explode("keys").alias("key"))
    shared = scratch.table(every.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key"), "shared")
    some = scratch.table(every.where(bloom_test(shared, "key", shared.count())(F.col("key"))).distinct(), "some")
    other = F.min_by("node", F.xxhash64("node", "key")).alias("other")
    ends = scratch.table(some.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), other, F.count(F.lit(1)).alias("n")).where("n > 1"), "ends")
    members = scratch.table(heavy_light_join(some, ends, "key", "n", some.count(), F.col("node")).where("n is not null"), "members")
    # In very large buckets first of all every member with three of them.
    stars = members.where(F.col("n") > block).select("node", F.explode(F.array("low", "high", "other")).alias("star")).where("node <> star").select(pair("star", "node"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among candidate pairs (a, b)."""
        pairs = dealt(scratch.table(pairs.distinct(), f"{name}-pairs"), f"{name}-dealt")
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        where = cuts.select("node", "sha").join(nodes, "node", "left_semi").groupBy("node", "sha").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct("sha", "n")).alias("x"))
        where = scratch.table(where.select("node", "x.sha", "x.n"), f"{name}-where")
        texts = d.where(bloom_test(where, "sha", where.count())(F.col("sha"))).select("sha", "text")
        texts = heavy_light_join(texts, where, "sha", "n", max(1, rows), F.xxhash64("text")).where("node is not null").dropDuplicates(["node"])
        texts = scratch.table(texts.select("node", "text"), f"{name}-texts")
        links = scratch.table(with_both(pairs, texts).mapInArrow(verify, "a long, b long"), name)
        scratch.drop(*[f"{name}-{x}" for x in ("texts", "where", "dealt-a", "dealt-b", "pairs")])
        return links

    def dealt(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs with part_a and part_b where some text has very many of them: as many copies of it are joined to them then."""
        degrees = [pairs.groupBy(x).agg(F.count(F.lit(1)).alias("n")) for x in "ab"]
        if (degrees[0].unionByName(degrees[1].withColumnRenamed("b", "a")).agg(F.max("n")).first()[0] or 0) <= VERIFY_GROUP:
            return pairs
        for x, y, n in zip("ab", "ba", degrees, strict=True):
            parts = F.ceil(F.coalesce("n", F.lit(1)) / VERIFY_GROUP)
            pairs = heavy_light_join(pairs, n.where(f"n > {VERIFY_GROUP}"), x, "n", max(1, pairs.count()), F.col(y)).withColumn(f"part_{x}", F.pmod(F.xxhash64(y), parts).cast("long")).withColumn(f"parts_{x}", parts.cast("long")).drop("n")
            pairs = scratch.table(pairs, f"{name}-{x}")
        return pairs

    def with_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
        for x in "ab":
            own = held.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in held.columns])
            if f"part_{x}" in pairs.columns:
                copies = pairs.where(f"parts_{x} > 1").groupBy(x).agg(F.max(f"parts_{x}").alias("parts"))
                own = own.join(copies, x, "left").withColumn(f"part_{x}", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
                pairs = pairs.join(own, [x, f"part_{x}"])
            else:
                pairs = pairs.join(own, x)
        return pairs

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members_of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.clear()
                known[node] = np.unique(shingle_hashes(words_of(text.as_py()), width))
            return known[node]

        known: dict[int, np.ndarray] = {}
        for batch in batches:
            good = []
            for a, b, s, t in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), batch["text_a"], batch["text_b"], strict=True):
                x, y = members_of(a, s), members_of(b, t)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(q * both >= p * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = alike.unionByName(close).unionByName(stars)
    links, k, open_, failed = verified(first, "links-0"), 0, None, None
    roots = components(links, scratch)
    none = F.lit(None)
    while True:
        k += 1
        named = members.select("key", "node", "n") if open_ is None else members.select("key", "node", "n").join(open_, "key", "left_semi")
        # A text is in no more buckets than there are bands.
        named = scratch.table(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"rooted-{k}")
        mixed = named.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("m")).where("least <> most").select("key", "m")
        named = heavy_light_join(named, mixed, "key", "m", max(1, named.count()), F.col("node")).where("m is not null").drop("m")
        named = scratch.table(named, f"mixed-{k}")
        sketched = cuts.select("node", "size", "bits").join(named.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
        many = F.ceil(F.col("n") / block)
        own = F.pmod(F.xxhash64("node"), many)
        rows_of = named.join(sketched, "node").withColumn("b", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
        rows_of = rows_of.select("key", F.least("b", "with").alias("i"), F.greatest("b", "with").alias("j"), "node", "size", "root", "bits", none.cast("long").alias("other"))
        if failed is not None:
            blocks = members.select("key", "n").join(open_, "key", "left_semi").distinct()
            x, y = (F.pmod(F.xxhash64(c), many) for c in "ab")
            again = failed.join(blocks, "key").select("key", F.least(x, y).alias("i"), F.greatest(x, y).alias("j"), F.col("a").alias("node"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("root"), none.cast("binary").alias("bits"), F.col("b").alias("other"))
            rows_of = rows_of.unionByName(again)
        rows_of = rows_of.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        edges = scratch.table(rows_of.mapInArrow(_compare(share, k > FORESTS), "key long, a long, b long"), f"edges-{k}")
        scratch.drop(f"rooted-{k}", f"mixed-{k}")
        if edges.isEmpty():
            break
        good = verified(edges.select("a", "b"), f"links-{k}")
        wrong = scratch.table(edges.distinct().join(good, ["a", "b"], "left_anti"), f"failed-{k}")
        links = links.unionByName(good)
        roots = components(links, scratch)
        if k > FORESTS or wrong.isEmpty():
            break
        failed = wrong if failed is None else failed.unionByName(wrong)
        open_ = scratch.table(wrong.select("key").distinct(), f"next-{k}")
    out = lookup(cuts.select("doc_id", "sha", "node"), roots, "node", F.col("sha"))
    return out.select("doc_id", "sha", F.coalesce("root", "node").alias("root"))


def drop_similar(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group of linked texts, that with the smallest doc_id (null last), with all their columns.

    Null texts count as empty; of rows that repeat both text and identifier one stays.  Further columns may have any names.
    """
    inner, restore = shielded(docs, "doc_id", "text")
    work = Scratch(docs.sparkSession, "similar")
    left = restore(one_of_each(similar_roots(inner, scratch=work, **how), inner, Scratch(docs.sparkSession, "similar-copies")))
    work.drop()  # what goes is written by now
    return left
