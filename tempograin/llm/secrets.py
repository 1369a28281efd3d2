"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a maximal run of key-like characters, and each part of one between separators, so that a name before a key does
not change how the key is judged.  Its character class (digits, hexadecimal, letters, letters and digits, base 64, plain words) sets the
window and the entropy that a window must reach.  Counts are updated as the window slides: one character enters and
one leaves, and with n log2 n tabulated each step costs a few additions.  Windows over the threshold merge into spans.  An
allow-list cuts out of a candidate what is known to be harmless, and only that; it never suppresses what the fixed patterns find.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import own_columns

#: The kinds in their order, their patterns and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: By character class: window length and bits a character that a window must reach.
CLASSES = {"digit": (24, 2.9), "hex": (24, 3.0), "letter": (24, 3.9), "alnum": (24, 3.9), "base64": (24, 4.0), "words": (24, 4.25)}
LEAST_RUN = 24
PART = re.compile(r"[A-Za-z0-9]{%d,}" % LEAST_RUN)
#: Runs of words and numbers between separators, as in paths and slugs; their letters repeat less than a language's but for a key.
WORDS = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+)(?:[-_/=+]+(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+))+[-_/=+]*")
#: Spans of a candidate that are no secrets: UUIDs, dates and versions, alphabets, placeholders.
ALLOW = re.compile(
    r"""(?<![0-9A-Za-z])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z])
    |(?<![0-9A-Za-z])[0-9]{1,4}(?:[-_/][0-9]{1,4})+(?![0-9A-Za-z])
    |abcdefgh|ABCDEFGH|0123456789|123456789|qwertyuiop|EXAMPLE|example|x{5,}|X{5,}""",
    re.VERBOSE,
)


def _class_table(chars: str) -> bytes:
    return bytes(120 if chr(i) in chars else 32 for i in range(256))


HEX_TABLE = _class_table("0123456789abcdef")
RUN_TABLE = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-")
N_LOG_N = [0.0, 0.0] + [n * log2(n) for n in range(2, 65)]


def runs(data: bytes, table: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of the table's characters of at least ``least`` bytes."""
    marked, need, found, at = data.translate(table), b"x" * least, [], 0
    while (at := marked.find(need, at)) >= 0:
        end = marked.find(b" ", at + least)
        end = len(marked) if end < 0 else end
        found.append((at, end))
        at = end
    return found


def char_class(s: str) -> str:
    if s.isdigit():
        return "digit"
    if all(c in "0123456789abcdef" for c in s) or all(c in "0123456789ABCDEF" for c in s):
        return "hex"
    if s.isalpha():
        return "letter"
    return "alnum" if s.isalnum() else "words" if WORDS.fullmatch(s) else "base64"


def entropy_spans(s: str, classes: dict[str, tuple[int, float]] = CLASSES) -> list[tuple[int, int]]:
    """Merged windows of ``s`` whose Shannon entropy reaches its class's threshold."""
    width, bits = classes[char_class(s)]
    if len(s) < width:
        return []
    counts: dict[str, int] = {}
    load = 0.0  # sum of n log2 n over the counts; entropy = log2(width) - load / width
    most = (log2(width) - bits) * width + 1e-9
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        load += N_LOG_N[n + 1] - N_LOG_N[n]
        if i >= width:
            n = counts[s[i - width]]
            counts[s[i - width]] = n - 1
            load += N_LOG_N[n - 1] - N_LOG_N[n]
        if i >= width - 1 and load <= most:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def run_spans(s: str, allow: re.Pattern = ALLOW, classes: dict[str, tuple[int, float]] = CLASSES) -> list[tuple[int, int]]:
    """Merged spans of a run and of its parts between separators, each by its own class, without what is allowed."""
    spans, at = [], 0
    for m in [*allow.finditer(s), None]:
        end = len(s) if m is None else m.start()
        if end - at >= LEAST_RUN:
            piece = s[at:end]
            spans += [(at + a, at + b) for a, b in entropy_spans(piece, classes)]
            for part in PART.finditer(piece):
                if len(part[0]) < len(piece):
                    spans += [(at + part.start() + a, at + part.start() + b) for a, b in entropy_spans(part[0], classes)]
        at = len(s) if m is None else m.end()
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def code_points(data: bytes, length: int) -> Callable[[int], int]:
    """What turns byte positions at characters, given in rising order, into code points; each byte is decoded once."""
    if len(data) == length:
        return lambda i: i
    byte = point = 0

    def at(i: int) -> int:
        nonlocal byte, point
        point += len(data[byte:i].decode("utf-8", "surrogatepass"))
        byte = i
        return point

    return at


def scan(text: str, allow: re.Pattern = ALLOW, classes: dict[str, tuple[int, float]] = CLASSES) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans in code points, sorted; the base kinds are 0, 1, 2 and entropy is 3."""
    data = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    at = code_points(data, len(text))
    found += [((x := at(a)), 2, x + b - a) for a, b in runs(data, HEX_TABLE, HEX_LEAST)]
    at = code_points(data, len(text))
    for a, b in runs(data, RUN_TABLE, LEAST_RUN):
        if spans := run_spans(data[a:b].decode("ascii"), allow, classes):
            x = at(a)
            found += [(x + y, 3, x + z) for y, z in spans]
    return sorted(found)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (kind, start, end) in code points, end exclusive, by start and kind.

    Null counts as empty and has no spans.  Rows may repeat and keep null identifiers; no rows give no rows; further
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t.as_py() or "")] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    d = own_columns(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def spans_digest(spans: str = "spans") -> list:
    """The contract's columns out of ``spans``."""

    def said(only: str) -> Column:
        return F.expr(f"array_join(transform(filter({spans}, s -> {only}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    counts = [F.expr(f"cast(size(filter({spans}, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:3]]
    return [*counts, F.sha2(said("s.kind <> 'entropy'"), 256).alias("base_sha256"), said("true").alias("spans")]


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<SECRET>") -> str:
    """``text`` with merged spans replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
