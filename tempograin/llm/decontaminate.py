"""Benchmark decontamination by an FM-index of each training shard.

A shard is a stretch of a partition's documents as sequences of words.  Words that no test phrase holds are all one separator, and
stretches between separators that are shorter than the shortest phrase can hold none, so neither is indexed.  The rest is suffix-sorted
by prefix doubling; its Burrows-Wheeler transform is kept in a wavelet matrix.  All phrases are searched backwards at once, each
step a rank in the matrix.  Rows of the ranges found walk to the nearest sampled suffix position; occurrences become word spans, which are
merged for removal.

Documents don't move: the phrases, whose size is checked, are broadcast block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempograin.llm.common import Scratch, quoted
from tempograin.llm.secrets import code_points

WINDOW = 8
#: Text in one shard's index, distance of sampled positions, and benchmark text of one broadcast, whose arrays take about ten times as much.
SHARD_BYTES, SAMPLE, BLOCK_BYTES = 24 << 20, 8, 4 << 20

#: Lower-cases A-Z; bytes other than digits, letters and those of non-ASCII characters separate words.
FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[np.minimum(word, len(self.words) - 1)] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Symbols below 2**levels with access and rank."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        for k in range(levels - 1, -1, -1):
            bits = (symbols >> k) & 1 == 1
            self.rows.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, end = np.zeros_like(at), at
        for k, row, zeros in zip(range(self.levels - 1, -1, -1), self.rows, self.zeros, strict=True):
            one = (symbol >> k) & 1 == 1
            a, b = row.rank(start), row.rank(end)
            start, end = np.where(one, zeros + a, start - a), np.where(one, zeros + b, end - b)
        return end - start

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at
        for row, zeros in zip(self.rows, self.zeros, strict=True):
            bit = row.get(end)
            symbol = symbol * 2 + bit
            a, b = row.rank(start), row.rank(end)
            start, end = np.where(bit == 1, zeros + a, start - a), np.where(bit == 1, zeros + b, end - b)
        return symbol, end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, where zeros are separators that differ from each other, earlier ones less."""
    n = len(text)
    apart = text == 0
    rank = np.where(apart, np.cumsum(apart) - 1, text.astype(np.int64) + int(apart.sum()))
    h = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - h] = rank[h:] + 1
        key = rank * np.int64(int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        h *= 2
        if fresh[-1] == n - 1 or h >= n:
            return order


class FMIndex:
    """Counts and locates phrases of symbols over 0 in a text whose zeros are separators; it begins and ends with one."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        levels = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << levels) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # rows before those that begin with a symbol
        self.matrix = WaveletMatrix(text[order - 1], levels)  # what precedes each suffix
        # A walk may not cross a separator, so what follows one is sampled besides every so many.
        kept = (order % sample == 0) | (text[order - 1] == 0)
        self.marks, self.places, self.rows = Bits(kept), order[kept], len(text)

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, which are the rows of an array padded at the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows, np.int64)
        for t in range(phrases.shape[1]):
            live = np.flatnonzero((t < sizes) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - t]
            known = c < 1 << self.matrix.levels
            c = np.where(known, c, 0)
            base = self.first[c]
            both = self.matrix.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            lo[live] = base + both[: len(live)]
            hi[live] = np.where(known, base + both[len(live) :], lo[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        place, steps, todo = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.marks.get(rows[todo]) == 1
            done, todo = todo[hit], todo[~hit]
            place[done] = self.places[self.marks.rank(rows[done])] + steps[done]
            symbol, rank = self.matrix.step(rows[todo])
            rows[todo] = self.first[symbol] + rank
            steps[todo] += 1
        return place


class Phrases:
    """The windows of benchmark items, as the broadcast holds them: flat arrays of 32-bit numbers and the words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        number = {x: i for i, x in enumerate(sorted({item for item, text in items if words_of(text)}))}
        parts, sizes, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                short = max(0, window - len(ids))
                rows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(short, np.int32), ids)), window)
                parts.append(rows)
                sizes.append(np.full(len(rows), window - short, np.int32))
                owners.append(np.full(len(rows), number[item], np.int32))
        # Padded at the left by zeros, which are no words, windows of different sizes differ.
        self.table, first, which = np.unique(np.concatenate(parts), axis=0, return_index=True, return_inverse=True)
        self.sizes = np.concatenate(sizes)[first].astype(np.int64)
        pairs = np.unique(np.stack((which.reshape(-1).astype(np.int64), np.concatenate(owners))), axis=1)
        self.names = sorted(number)
        self.owner_at = np.searchsorted(pairs[0], np.arange(len(self.table) + 1))
        self.owners = pairs[1].astype(np.int32)
        self.least = int(self.sizes.min()) if len(self.table) else 0

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words as numbers of the vocabulary, 0 for all that isn't in it."""
        words = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int32, len(words))


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and of which range each is."""
    n = end - start
    which = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), which


def hits(docs: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """For each document of a shard, its words as numbers, the merged word spans of all occurrences, and the numbers of the items that own them."""
    out: list[tuple[list[tuple[int, int]], list[int]]] = [([], []) for _ in docs]
    if not len(phrases.table):
        return out
    parts, doc_at, word_at, text_at, size = [np.zeros(1, np.int32)], [], [], [], 1
    for k, ids in enumerate(docs):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ids > 0, [0])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= phrases.least:
                parts += [ids[a:b], parts[0]]
                doc_at.append(k)
                word_at.append(a)
                text_at.append(size)
                size += b - a + 1
    if not doc_at:
        return out
    index = FMIndex(np.concatenate(parts))
    lo, hi = index.search(phrases.table, phrases.sizes)
    found = np.flatnonzero(lo < hi)
    rows, which = _spread(lo[found], hi[found])
    if not len(rows):
        return out
    phrase, place = found[which], index.locate(rows)
    run = np.searchsorted(np.array(text_at), place, side="right") - 1
    doc = np.array(doc_at)[run]
    start = np.array(word_at)[run] + place - np.array(text_at)[run]
    end = start + phrases.sizes[phrase]
    order = np.lexsort((end, start, doc))
    for d, a, b in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
        spans = out[d][0]
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    # However often a phrase occurs in a document its owners count once, and owners are spread for one document at a time.
    held = np.unique(doc * len(phrases.table) + phrase)
    doc, phrase = held // len(phrases.table), held % len(phrases.table)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        item, _ = _spread(phrases.owner_at[phrase[a:b]], phrases.owner_at[phrase[a:b] + 1])
        out[int(doc[a])][1].extend(np.unique(phrases.owners[item]).tolist())
    return out


_WORD = re.compile(rb"[^ ]+")


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word spans, in order, as code points of ``text`` (start, end exclusive) and as words (first, last exclusive)."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data.translate(FOLD))]
    point = code_points(data, len(text))
    return [{"start": point(at[a][0]), "end": point(at[b - 1][1]), "first": a, "last": b} for a, b in spans]


#: A span to remove.
SPAN = "struct<start:long,end:long,first:long,last:long>"
HIT_COLUMNS = f"n_words long, n_hit long, items array<string>, spans array<{SPAN}>"


def _scan(docs: DataFrame, phrases: Phrases, shard_bytes: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(phrases)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "first", "last")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value

        def shard(held: list[tuple[pa.RecordBatch, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            found = iter(hits([w for _, words in held for w in words], phrases))
            for batch, words in held:
                mine = [next(found) for _ in words]
                texts = batch["text"]
                spans = [char_spans(texts[i].as_py(), s) if s else [] for i, (s, _) in enumerate(mine)]
                extra = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(b - a for a, b in s) for s, _ in mine], pa.int64()), pa.array([[phrases.names[i] for i in x] for _, x in mine], pa.list_(pa.string())), pa.array(spans, kind)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "n_words", "n_hit", "items", "spans"])

        held, size = [], 0
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                held.append((batch, [phrases.numbers(t.as_py()) for t in batch["text"]]))
                size += batch["text"].nbytes
                if size > shard_bytes:
                    yield from shard(held)
                    held, size = [], 0
        if held:
            yield from shard(held)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *StructType.fromDDL(HIT_COLUMNS).fields]))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (at least: text) with n_words, n_hit, items (sorted as strings, each once) and spans to remove.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; an item's windows are its ``window``
    consecutive words, or all its words if there are fewer.  ``n_hit`` counts a document's words inside any occurrence, ``spans`` are its merged
    occurrences in code points.  Null and empty texts have no words and no hits; so have items, and with no items nothing is
    hit.  Items that share a window all count; rows that repeat an item_id are one item; a null item_id is the item ``null``.
    A span is given in code points (start, end) and in words (first, last), ends exclusive.  Other columns of ``docs`` pass through, but n_words, n_hit, items and spans are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    block = lambda k: Phrases([tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()], window)
    if blocks == 1:
        return _scan(docs, block(0), shard_bytes)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = scratch.table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = None
    for k in range(blocks):
        part = _scan(rows.select("_row", "text"), block(k), shard_bytes)
        part = scratch.table(part.drop("text") if k == 0 else part.where("n_hit > 0").drop("text"), f"block-{k}")
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    whole = whole.withColumn("spans", F.expr(f"""aggregate(spans, cast(array() as array<{SPAN}>), (a, s) ->
        if(size(a) > 0 and s.first <= element_at(a, -1).last,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(s.end, element_at(a, -1).end) as end, element_at(a, -1).first as first, greatest(s.last, element_at(a, -1).last) as last))),
           concat(a, array(s))))"""))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return rows.join(whole.withColumn("n_hit", hit), "_row").select(*[F.col(quoted(c)) for c in docs.columns], "n_words", "n_hit", "items", "spans")


def without_spans(text: str = "text", spans: str = "spans") -> Column:
    """The text outside the spans, as a column expression."""
    return F.expr(f"""if(size({spans}) = 0, {text}, concat(
        array_join(transform({spans}, (s, i) -> substring({text}, cast(if(i = 0, 0, {spans}[i - 1].end) as int) + 1, cast(s.start - if(i = 0, 0, {spans}[i - 1].end) as int))), ''),
        substring({text}, cast(element_at({spans}, -1).end as int) + 1, length({text}))))""")
