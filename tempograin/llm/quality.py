"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled rows.  Every path from a root becomes a rule, a conjunction of
threshold conditions on statistics; a lasso-penalised logistic regression weighs the rules and drops most.  What remains is compiled
into one Spark column expression, so scoring is part of the plan.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tempograin.llm.common import own_columns, quoted

#: Most labelled rows that are fitted on, in the order of a hash of their doc_id.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 24, 3, 0.3, 32, 20
LASSO = (0.01, 0.003, 0.001, 0.0003)

STATS = (
    "log_words", "word_length", "letters", "digits", "symbols", "pipes", "bangs", "capitals", "stops", "commas",
    "distinct_words", "distinct_pairs", "top_word", "same_word", "same_line", "line_words", "odd_lines", "longest_word", "non_ascii",
)
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"


def _without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def statistics(text: str | None) -> tuple[float, ...]:
    """The numbers of STATS for a whole text; all 0 for a text without words."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(STATS)
    dense = sum(map(len, words))
    letters, high = _without(data, _LETTERS), dense - len(b"".join(words).translate(None, bytes(range(128, 256))))
    capitals = _without(data, _LETTERS[:26])
    lines = [x for x in data.split(b"\n") if x.strip()]
    odd = 0
    for line in lines:
        m = len(line.split())
        odd += m * (_without(line, _SYMBOLS + b"|") > m or line.count(b"!") > m or (m > 3 and len(set(line.split())) < 0.3 * m))
    counts = Counter(words)
    return (
        float(np.log1p(n)), dense / n, (letters + high) / dense, _without(data, b"0123456789") / dense, _without(data, _SYMBOLS) / n,
        data.count(b"|") / n, (data.count(b"!") + data.count(b"?")) / n, capitals / max(1, letters), data.count(b".") / n, data.count(b",") / n,
        len(counts) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1), max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), n / len(lines), odd / n, float(max(map(len, words))), high / dense,
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of STATS as ``q_<name>`` (replacing any of that name)."""
    docs = docs.drop(*[f"q_{s}" for s in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch["text"]]).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=[*batch.schema.names, *(f"q_{s}" for s in STATS)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(f"q_{s}", DoubleType()) for s in STATS)]))


#: A condition: statistic, whether it must exceed, threshold.
Condition = tuple[int, bool, float]


@dataclass
class Rules:
    """Weighted conjunctions; the score is the logistic of intercept plus the weights of the rules that hold."""

    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self) -> Column:
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = None
            for k, above, t in conditions:
                c = F.col(f"q_{STATS[k]}") > F.lit(float(t)) if above else F.col(f"q_{STATS[k]}") <= F.lit(float(t))
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for conditions, weight in self.rules:
            total += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in conditions:
        out &= x[:, k] > t if above else x[:, k] <= t
    return out


def grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rate: float = RATE) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """One tree on gradients ``g`` and curvatures ``h``: its paths (of every length) and its step for each row."""
    paths: list[tuple[Condition, ...]] = []
    step = np.zeros(len(x))

    def node(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        best = (1e-6, None, None)
        if len(path) < DEPTH and len(rows) >= 2 * LEAF:
            gs, hs = g[rows].sum(), h[rows].sum()
            for k, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[rows, k]
                n, gl, hl = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (None, g[rows], h[rows]))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), k, int(gain.argmax()))
        if best[1] is None:
            step[rows] = -rate * g[rows].sum() / (h[rows].sum() + 1)
            return
        _, k, cut = best
        left = binned[rows, k] <= cut
        for side, above in ((rows[left], False), (rows[~left], True)):
            paths.append((*path, (k, above, float(edges[k][cut]))))
            node(side, paths[-1])

    node(np.arange(len(x)), ())
    return paths, step


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression with an L1 penalty on all but the first coefficient, by accelerated proximal steps."""
    w = v = start.copy()
    t = 1.0
    x = np.ones(z.shape[1])
    for _ in range(12):  # largest curvature
        x = z.T @ (z @ x)
        x /= np.linalg.norm(x)
    rate = 4 * len(z) / float(x @ (z.T @ (z @ x)))
    for _ in range(rounds):
        new = v - rate * (z.T @ (1 / (1 + np.exp(-(z @ v))) - y)) / len(z)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t, was = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (was - 1) / t * (new - w), new
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """Rules from statistics and 0/1 labels; without both labels, or a rule that tells rows apart, the constant share of 1 (0.5 without any)."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    constant = Rules(float(np.log(share / (1 - share))))
    if len(y) < 4 * LEAF or y.min() == y.max():
        return constant
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    edges = [e[e < x[:, k].max()] for k, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    total, paths = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        new, step = grow(x, binned, edges, p - y, p * (1 - p))
        total += step
        paths |= dict.fromkeys(new)
    rules, seen = [], set()
    for path in paths:
        c = holds(x, path)
        if (key := c.tobytes()) not in seen and LEAF <= c.sum() <= len(y) - LEAF:
            seen.add(key)
            rules.append(path)
    if not rules:
        return constant
    z = np.concatenate((np.ones((len(y), 1), np.float32), np.stack([holds(x, r) for r in rules], axis=1).astype(np.float32)), axis=1)
    check = np.arange(len(y)) % 5 == 0
    best, w = (np.inf, LASSO[0]), np.zeros(z.shape[1])
    for penalty in LASSO:
        w = lasso(z[~check], y[~check], penalty, w, 120)
        p = np.clip(1 / (1 + np.exp(-(z[check] @ w))), 1e-6, 1 - 1e-6)
        best = min(best, (float(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()), penalty))
    w = lasso(z, y, best[1], w)
    return Rules(float(w[0]), [(r, float(c)) for r, c in zip(rules, w[1:], strict=True) if abs(c) > 1e-4])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Rules:
    """Fit on at most ``sample`` labelled documents that aren't held out.

    Only text statistics are inputs.  Null labels and identifiers teach nothing; a document labelled both ways counts both ways.
    """
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)  # small enough to broadcast, by this bound
    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text")
    rows = with_statistics(rows).drop("text").dropDuplicates(["doc_id", "quality"]).orderBy("doc_id", "quality").toArrow()
    x = np.stack([rows[f"q_{s}"].to_numpy() for s in STATS], axis=1) if rows.num_rows else np.zeros((0, len(STATS)))
    return fit(x, rows["quality"].to_numpy().astype(float))


def quality_scores(docs: DataFrame, model: Rules) -> DataFrame:
    """``docs`` (at least: text) with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null counts as empty, which has a score as any other text.  Rows may repeat; no rows give no rows.  Other columns pass through, but score and
    predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    out = with_statistics(docs).withColumn("score", model.column())
    return out.select(*[F.col(quoted(c)) for c in docs.columns], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
