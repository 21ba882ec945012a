"""Quality classifier: a generalised additive model with pairwise interactions.

A text gives a few dozen numbers. Each is cut into bins at quantiles; boosting goes round the features,
fitting a shallow tree on one feature's bins at a time and adding its leaves to that feature's lookup
table. Then the pairs of features that explain most of what is left get tables over two coarser
binnings, boosted likewise by trees of two cuts. A score is a sum of table entries through the logistic
function, so scoring is vectorised binning and additions.

Labels are learned from a bounded sample: the ROWS labelled documents with the least hashes. The
tables go to the executors, a few kilobytes; all texts are scored whole.

Defined results: a null text is empty; empty and blank texts are scored by their numbers like others;
labels that are null are not learned from, and a document with several labels is learned from by the
least; where nothing is labelled all scores are 0.5; repeated rows get equal scores; an empty table
gives no rows; other columns are not read (score) or carried unchanged, whatever their names (keep_good).
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import fresh

ROWS = 20_000
UPPER, LOWER, DIGITS = (x.encode() for x in (string.ascii_uppercase, string.ascii_lowercase, string.digits))
MARKS, SYMBOLS, BLANKS, HIGH = b".,;:'\"?-", b"#$%&*@^~|<>{}[]\\/_+=`", b" \t\n\r\v\f", bytes(range(128, 256))
FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "distinct_words", "top_word", "upper", "lower", "digits", "marks", "symbols", "bangs", "bars", "high",
    "line_length", "distinct_lines", "repeated_line_share", "short_lines", "compressed", "ends", "odd_ends", "upper_words",
)


def features(text: bytes) -> list[float]:
    """FEATURES of a text in UTF-8."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (len(FEATURES) - 1)
    count = Counter(words)
    has = lambda chars: (n - len(text.translate(None, chars))) / n
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    own = Counter(lines)
    chars = sum(map(len, lines))
    sample = list(count)
    ends = sum(c for w, c in count.items() if w[-1] in b".!?")
    odd = sum(c for w, c in count.items() if w[-1] in SYMBOLS or w[-1] == 33)
    shouted = sum(c for w, c in count.items() if w.isupper())
    return [
        math.log1p(n), math.log1p(len(words)), sum(map(len, words)) / len(words), math.log1p(max(map(len, sample))), len(count) / len(words), max(count.values()) / len(words),
        has(UPPER), has(LOWER), has(DIGITS), has(MARKS), has(SYMBOLS), text.count(b"!") / n, text.count(b"|") / n, has(HIGH),
        math.log1p(chars / len(lines)), len(own) / len(lines), sum(len(x) * (c - 1) for x, c in own.items()) / chars, sum(len(x) < 30 for x in lines) / len(lines),
        len(zlib.compress(text, 1)) / n, ends / len(words), odd / len(words), shouted / len(words),
    ]


@dataclass
class Model:
    """Cut points and tables; pairs hold (feature, feature, table) over the coarse cut points."""

    prior: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.prior)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            logit += table[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, table in self.pairs:
            logit += table[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-logit))


def _gain(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, l2: float, least: int) -> np.ndarray:
    """Leaf values by bin of a tree on one feature's sums, grown best split first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a < 2:
                continue
            lg, lh, ln = (np.cumsum(x[a:b])[:-1] for x in (g, h, n))
            tg, th, tn = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
            won = np.where((ln >= least) & (tn - ln >= least), _gain(lg, lh, l2) + _gain(tg - lg, th - lh, l2) - _gain(tg, th, l2), -1.0)
            k = int(won.argmax())
            if won[k] > best[0]:
                best = (won[k], (a, a + k + 1, b))
        if best[1] is None:
            break
        a, k, b = best[1]
        parts = [p for p in parts if p != (a, b)] + [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each of two features: its gain and its leaf values over the grid."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = (np.arange(1, s) for s in g.shape)
    if not len(a) or not len(b):
        return 0.0, np.zeros(g.shape)

    def four(c):
        x = c[np.ix_(a, b)]
        return [x, c[a, -1][:, None] - x, c[-1, b][None, :] - x, c[-1, -1] - c[a, -1][:, None] - c[-1, b][None, :] + x]

    qg, qh = four(cg), four(ch)
    won = sum(_gain(x, y, l2) for x, y in zip(qg, qh, strict=True))
    i, j = np.unravel_index(int(won.argmax()), won.shape)
    v = [x[i, j] / (y[i, j] + l2) for x, y in zip(qg, qh, strict=True)]
    out = np.empty(g.shape)
    out[: a[i], : b[j]], out[: a[i], b[j] :], out[a[i] :, : b[j]], out[a[i] :, b[j] :] = v
    return float(won[i, j] - _gain(g.sum(), h.sum(), l2)), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pair_rounds: int = 60, pairs: int = 8, rate: float = 0.1, leaves: int = 3, l2: float = 1.0, least: int = 5) -> Model:
    """Cyclic boosting on the features, then on the most telling pairs."""
    if not len(y):
        return Model()
    cut = lambda k: [np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1])) for c in x.T]
    model = Model(math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), cut(bins), [], cut(coarse))
    at = [np.searchsorted(c, v, side="right") for c, v in zip(model.cuts, x.T, strict=True)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(at, model.tables, strict=True)]
    logit = np.full(len(y), model.prior)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, t, n in zip(at, model.tables, counts, strict=True):
            g, h = slopes()
            leaf = rate * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)), n, leaves, l2, least)
            t += leaf
            logit += leaf[b]
    low = [np.searchsorted(c, v, side="right") for c, v in zip(model.coarse, x.T, strict=True)]
    width = [len(c) + 1 for c in model.coarse]

    def grid(i, j, v):
        return np.bincount(low[i] * width[j] + low[j], v, width[i] * width[j]).reshape(width[i], width[j])

    g, h = slopes()
    told = sorted(((_quadrants(grid(i, j, g), grid(i, j, h), l2)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)[:pairs]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for won, i, j in told if won > 0]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            leaf = rate * _quadrants(grid(i, j, g), grid(i, j, h), l2)[1]
            t += leaf
            logit += leaf[low[i], low[j]]
    return model


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(x or b"") for x in texts]).reshape(len(texts), len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = ROWS, **options) -> Model:
    """Fits the bounded sample of labels that learnable (an expression over labels) marks."""
    lab = labels.where(F.coalesce(learnable, F.lit(False))).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y is not null")
    chosen = lab.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    chosen = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)  # rows at most
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.DoubleType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    found = texts.select("id", F.col("text").cast("binary"), "y").mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id", "x").limit(rows).collect()
    return fit(np.array([r["x"] for r in found]).reshape(len(found), len(FEATURES)), np.array([r["y"] for r in found]), **options)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1).to_pylist())), pa.float64())], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without those that score below the threshold; whole rows pass the scorer, so none is joined."""
    text = fresh(docs.columns, "scored_text")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.score(_matrix(batch.column(batch.num_columns - 1).to_pylist())) >= threshold
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(good))

    return docs.withColumn(text, F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, docs.schema)
