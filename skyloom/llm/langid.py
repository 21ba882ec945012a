"""Language identification by cross-parsing entropy.

For each language that labels name, a bounded sample of labelled text becomes a suffix automaton, which
reads exactly the substrings of the sample. A text is parsed into the longest phrases that the
automaton reads; a text of n characters that needs c phrases against a sample of m characters has a
cross-entropy of about c * log2(m) / n. The language with the least wins.

The sample of a language: its labelled documents with the least hashes among those of at most ROW_CHARS
characters, ROWS at most, each whole (the shortest one where all are longer; fewer rows where the
languages would share more than TOTAL_ROWS). Only these texts are sent to the executors; workers build the
automata. Texts are read whole, in lower case, with runs of anything but letters as one blank.

A letter that the sample lacks is a phrase of its own. Long texts are parsed in stretches of LANE symbols
side by side: each stretch is parsed from its start, then on beyond its end until one of its phrases begins
where one of a later stretch does; from there on the two parses are one. So phrases are counted as one
parse from the start would count them.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is any text where
nothing could be learned; ties go to the language first by code point; score is 1 less the ratio of
the least cross-entropy to the next (1 if there is one language only); rows with a null identifier
are predicted, never learned from, and not held out; repeated rows get equal results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of what is learned from: rows of a language, characters of a row, rows of all languages.
ROWS, ROW_CHARS, TOTAL_ROWS = 16, 3_000, 4_096
#: Symbols are 0 for letters that the sample lacks, 1 for blanks, then its letters, commonest first. So many have
#: columns of a table; moves by others are searched for.
DENSE = 64
LANE = 256
MISS = np.uint32(1 << 31)
STATE = np.uint32((1 << 31) - 1)

_letters: list[np.ndarray] = []
_automata: dict[str, list[Automaton]] = {}


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Automaton:
    """The suffix automaton of a text as one table: (state * size + symbol) -> next state * size.

    Where a state can't read a symbol the table holds what the root would go to, with the MISS bit. The
    last state reads nothing: parses begin there, and letters that the text lacks lead there.
    """

    def __init__(self, text: str):
        points = code_points(text)
        known = [c for c, _ in Counter(points[letters()[points]].tolist()).most_common()]
        self.symbol = np.where(letters(), 0, 1).astype(np.uint32)
        self.symbol[known] = np.arange(2, len(known) + 2)
        self.size, read = min(DENSE, len(known) + 2), squeeze(self.symbol[points])
        self.length = len(read)
        moves = suffix_moves(read.tolist())
        n = len(moves)
        self.start = np.uint32(n * self.size)
        table = np.full((n + 1, self.size), MISS | self.start, np.uint32)
        self.root = np.full(len(known) + 2, MISS | self.start, np.uint32)
        for c, s in moves[0].items():
            self.root[c] = MISS | np.uint32(s * self.size)
        table[:, 1:] = self.root[1 : self.size]
        states = np.repeat(np.arange(n), [len(x) for x in moves])
        by = np.array([c for x in moves for c in x], np.int64)
        to = np.array([s for x in moves for s in x.values()], np.uint32) * np.uint32(self.size)
        dense = by < self.size
        table[states[dense], by[dense]] = to[dense]
        self.table = table.reshape(-1)
        rare = states[~dense] * len(self.root) + by[~dense]
        order = np.argsort(rare)
        self.rare, self.rare_to = np.append(rare[order], np.iinfo(np.int64).max), np.append(to[~dense][order], np.uint32(0))

    def read(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What each state goes to by its symbol, with the MISS bit where a new phrase begins."""
        if len(self.rare) == 1:
            return self.table[state + symbol]
        seldom = symbol >= self.size
        got = self.table[state + np.where(seldom, 0, symbol)]
        at = np.flatnonzero(seldom)
        if len(at):
            key = (state[at] // np.uint32(self.size)).astype(np.int64) * len(self.root) + symbol[at]
            found = np.searchsorted(self.rare, key)
            got[at] = np.where(self.rare[found] == key, self.rare_to[found], self.root[symbol[at]])
        return got


def suffix_moves(symbols: list[int]) -> list[dict[int, int]]:
    """The moves of each state of the suffix automaton of symbols; the root is the first."""
    link, longest, moves, last = [-1], [0], [{}], 0
    for c in symbols:
        new, p = len(link), last
        link.append(0)
        longest.append(longest[last] + 1)
        moves.append({})
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] != longest[p] + 1:
                copy = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                moves.append(dict(moves[q]))
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    return moves


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """Runs of blanks as one."""
    if not len(symbols):
        return symbols
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)
    return symbols[keep]


def phrases(automaton: Automaton, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and symbols of each text; the texts' code points stand end to end, none is empty."""
    symbols = automaton.symbol[points]
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)
    keep[ends[:-1]] = True  # each text begins anew
    stops = np.cumsum(keep)[ends - 1]
    symbols, sizes = symbols[keep], np.diff(stops, prepend=0)
    lanes = -(-sizes // LANE)
    first = np.cumsum(lanes) - lanes
    text = np.repeat(np.arange(len(sizes)), lanes)
    nth = np.arange(len(text)) - first[text]
    start, end = (stops - sizes)[text] + nth * LANE, stops[text]
    order = np.argsort(-np.minimum(LANE, end - start), kind="stable")
    begins, size = start[order], np.minimum(LANE, end - start)[order]
    active = np.searchsorted(-size, -np.arange(LANE), side="left")  # lanes longer than each step
    state, marks = np.full(len(begins), automaton.start, np.uint32), np.zeros(len(symbols) + 1, bool)
    for step in range(LANE):
        m = active[step]
        if not m:
            break
        got = automaton.read(state[:m], symbols[begins[:m] + step])
        marks[begins[:m] + step] = got >= MISS
        state[:m] = got & STATE
    before = np.concatenate([[0], np.cumsum(marks)])
    # beyond their stretches, until phrases begin where another lane's do
    lane = order[(begins + size < end[order])]
    at, now, more, meets = start[lane] + LANE, state[begins + size < end[order]], np.zeros(len(text), np.int64), end.copy()
    while len(lane):
        got = automaton.read(now, symbols[at])
        new = got >= MISS
        met = new & marks[at]
        meets[lane[met]] = at[met]
        more[lane[new & ~met]] += 1
        at, now = at + 1, got & STATE
        on = ~met & (at < end[lane])
        lane, at, now = lane[on], at[on], now[on]
    own = before[np.minimum(start + LANE, end)] + more
    counts = np.zeros(len(sizes), np.int64)
    single = lanes == 1
    counts[single] = own[first[single]] - before[start[first[single]]]
    for k in np.flatnonzero(~single).tolist():
        p, stop, low, total = int(stops[k] - sizes[k]), int(stops[k]), int(stops[k] - sizes[k]), 0
        while p < stop:
            j = int(first[k]) + (p - low) // LANE
            total += int(own[j] - before[p])
            p = int(meets[j])
        counts[k] = total
    return counts, sizes


def automata(samples: list[str]) -> list[Automaton]:
    """Built once in a worker."""
    key = hashlib.sha1("\0".join(samples).encode("utf-8", "surrogatepass")).hexdigest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = [Automaton(x) for x in samples]
    return _automata[key]


def rates(models: list[Automaton], texts: list[str]) -> np.ndarray:
    """The cross-entropy of each text (all with letters) under each automaton, bits a symbol."""
    points = [code_points(x.lower()) for x in texts]
    ends, flat = np.cumsum([len(x) for x in points]), np.concatenate(points)
    out = np.empty((len(texts), len(models)))
    for j, model in enumerate(models):
        c, n = phrases(model, flat, ends)
        out[:, j] = c * math.log2(model.length + 2) / n
    return out


def learn(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str, rows: int = ROWS, row_chars: int = ROW_CHARS) -> dict[str, str]:
    """The sample of each language, from rows that learnable marks."""
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(learnable, F.lit(False)).alias("ok"))
    own = own.where("ok and lang is not null and text is not null and id is not null").withColumn("tie", F.xxhash64("text"))
    over = F.greatest(F.length("text") - row_chars, F.lit(0))
    slim = own.select("lang", "id", "tie", F.xxhash64("id").alias("hash"), over.alias("over"))
    order = Window.partitionBy("lang").orderBy("over", "hash", "id", "tie")
    chosen = slim.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= rows) & ((F.col("over") == 0) | (F.col("rank") == 1)))
    found = chosen.collect()  # rows times languages
    per = max(1, TOTAL_ROWS // max(1, len({r["lang"] for r in found})))
    ids = docs.sparkSession.createDataFrame([r for r in found if r["rank"] <= per], chosen.schema).select("lang", "id", "tie", "rank")
    texts: dict[str, list[str]] = {}
    for r in own.join(F.broadcast(ids), ["lang", "id", "tie"]).select("lang", "rank", "text").distinct().orderBy("lang", "rank").collect():
        texts.setdefault(r["lang"], []).append(r["text"].lower())
    samples = {k: " ".join(x) for k, x in sorted(texts.items())}
    return {k: x for k, x in samples.items() if any(map(str.isalpha, x))}


def predict(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    names, texts = list(samples), list(samples.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = automata(texts)
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                found = batch.column(1).to_pylist()
                at = [i for i, x in enumerate(found) if x and any(map(str.isalpha, x))] if models else []
                lang, score = ["und"] * len(found), [0.0] * len(found)
                if at:
                    bits = rates(models, [found[i] for i in at])
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(at)), best]
                    bits[np.arange(len(at)), best] = np.inf
                    margin = 1 - least / bits.min(axis=1)
                    for i, b, s in zip(at, best.tolist(), margin.tolist(), strict=True):
                        lang[i], score[i] = names[b], s
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def identify(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **sample) -> DataFrame:
    """Learns from the rows that learnable marks and predicts all: doc_id, lang_pred and score."""
    return predict(docs, learn(docs, learnable, id_col, text_col, lang_col, **sample), id_col, text_col)
