"""Token counts by a two-tier, map-side look-up of pre-token lengths.

A text's count is the sum over its pre-tokens, which the library's own pre-tokenizer cuts.  The first tier is a compact table of the lengths of frequent
pre-tokens, counted over a sample of the texts and broadcast to all workers.  The second tier is a cache in each worker process, which tasks share: what
the first lacks is encoded once, and a stretch of text between two spaces is summed once.  Nothing is shuffled, and counts don't depend on what
either tier holds.
"""

from __future__ import annotations

import os
import re
from collections import Counter as Tally
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import own_columns

#: About so many texts say which pre-tokens are frequent; so many at most are broadcast, and so many at most come from one partition.
SAMPLE, FREQUENT, PART = 2_000, 50_000, 2_000
#: Entries of each of a worker's caches, after which it starts anew (under 250 MB), and the longest stretch that is kept.
CACHE, LONGEST = 1_500_000, 64
#: A word of Latin letters, which is one pre-token with the space before it, and perhaps marks, which are another.
_WORD = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
#: How byte-level pre-tokens write a byte, printable Latin-1 as itself and the others in order from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
SPACE = BYTE_CHARS[0x20]
#: A stretch begins at a space before something else: no pre-token reaches over such a place, whatever lies on its sides.
_STRETCH = re.compile("(?= [^\\s\u180e])")


def opened(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def frequent(texts: DataFrame, path: str, sample: int = SAMPLE, most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of about ``sample`` of the ``texts`` (text); each partition counts its own, the driver adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, tally = None, Tally()
        for batch in batches:
            cut = cut or opened(path).pre_tokenizer.pre_tokenize_str
            for text in batch["text"]:
                tally.update(word for word, _ in cut(text.as_py() or ""))
        top = tally.most_common(PART)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"])

    n = texts.count()
    some = texts.sample(min(1.0, sample / n), seed=11) if n else texts
    rows, tally = some.mapInArrow(run, "word string, n long").toArrow(), Tally()
    for word, n in zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True):
        tally[word] += n
    return [w for w, _ in tally.most_common(most)]


def packed(words: list[str], path: str) -> bytes:
    """The first tier as one blob: pre-tokens and their lengths."""
    model = opened(path).model
    words = [w for w in words if w and "\0" not in w]
    sizes = np.array([min(len(model.tokenize(w)), 65_535) for w in words], "<u2")
    kept = [w for w, n in zip(words, sizes, strict=True) if n < 65_535]
    return np.uint32(len(kept)).tobytes() + sizes[sizes < 65_535].tobytes() + "\0".join(kept).encode()


def unpack(blob: bytes) -> dict[str, int]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    return dict(zip(blob[4 + 2 * n :].decode().split("\0") if n else [], np.frombuffer(blob, "<u2", n, 4).tolist(), strict=True))


class Irregular(Exception):
    """A text whose spaces don't all begin a stretch."""


class Lengths(dict):
    """Both tiers as one look-up of pre-tokens: what isn't there yet is encoded once and kept."""

    def __init__(self, first: dict[str, int], model, most: int):
        super().__init__(first)
        self.first, self.model, self.most = first, model, most + len(first)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.first)
        n = self[word] = len(self.model.tokenize(word))
        return n


class Stretches(dict):
    """Counts of stretches by what follows their leading space.  A plain word's own length isn't kept beside its stretch's."""

    def __init__(self, lengths: Lengths, other, most: int):
        super().__init__()
        self.lengths, self.first, self.tokenize, self.other, self.most = lengths, lengths.first, lengths.model.tokenize, other, most

    def __missing__(self, rest: str) -> int:
        plain = _WORD.fullmatch(rest)
        if plain:
            word, marks = plain.groups()
            word = SPACE + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS))
            n = self.first.get(word) or len(self.tokenize(word))
            if marks:
                n += self.lengths[marks]
        elif not rest or rest[0].isspace() or rest[0] == "\u180e":
            raise Irregular
        else:
            n = self.other(" " + rest)
        if len(rest) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[rest] = n
        return n


class Counter:
    """Counts tokens of texts with both tiers."""

    def __init__(self, path: str, blob: bytes, cache: int = CACHE):
        self.tok = opened(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cut, self.lengths = self.tok.pre_tokenizer.pre_tokenize_str, Lengths(unpack(blob), self.tok.model, cache)
        self.stretches = Stretches(self.lengths, self.stretch, cache)

    def whole(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def stretch(self, text: str) -> int:
        lengths = self.lengths
        return sum([lengths[word] for word, _ in self.cut(text)])

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return (self.stretch(first) if first else 0) + sum(map(self.stretches.__getitem__, rest))
        except Irregular:
            return sum(map(self.stretch, _STRETCH.split(text)))


#: The worker process's counter, which outlives its tasks: one, for the table that was used last.
_HELD: dict[tuple, Counter] = {}


def held(key: tuple, path: str, blob: bytes, cache: int) -> Counter:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Counter(path, blob, cache)
    return _HELD[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``tokenizer`` is the path of a byte-level BPE's JSON file, the same on every worker.  Begin, end and other special tokens are not added; their
    strings inside a text are handled as the library does by default, which then encodes that text.  Null counts as empty, which has 0 tokens.  Rows
    may repeat and keep their null identifiers; no rows give no rows; further columns are ignored.
    """
    d = own_columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    blob = packed(frequent(d.select("text"), tokenizer, sample), tokenizer)
    sent, key = docs.sparkSession.sparkContext.broadcast(blob), (tokenizer, cache, hash(blob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = held(key, tokenizer, sent.value, cache).count
            n = [count(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return d.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
