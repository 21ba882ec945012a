"""Periodic runs of words: stretches that repeat one sequence, found by dyadic catchers.

A text is read as it grows. Blocks of each power of two of words are catchers once they are complete: a
catcher of L words waits for the words L to 2L places on, and where these equal its own it has caught part
of a square. Squares of one period that adjoin merge; comparing the words before and after them one by one
gives the whole run. A run of at least three periods holds a complete catcher of every length up to its
period, so none escapes; catchers inside a known run of smaller period are spared, as their squares only
repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import fresh

#: Words that a task looks at together; a longer text is looked at alone.
TOGETHER = 400_000
#: Comparisons held in memory at once.
WIDE = 1 << 20
RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _agree(words: np.ndarray, at: np.ndarray, apart: np.ndarray, step: int) -> np.ndarray:
    """How many words in a row, from at on in steps of 1 or -1, equal those the given distance after them.

    Separators, each unlike all else, end every text and lie before the first, so comparisons end there.
    """
    out, going, width = np.zeros(len(at), np.int64), np.arange(len(at)), 8
    while len(going):
        part = max(1, WIDE // width)
        ahead = []
        for k in range(0, len(going), part):
            own = going[k : k + part]
            i = np.clip((at[own] + step * out[own])[:, None] + step * np.arange(width), 0, len(words) - 1)
            same = words[i] == words[np.clip(i + apart[own][:, None], 0, len(words) - 1)]
            n = np.where(same.all(1), width, same.argmin(1))
            out[own] += n
            ahead.append(own[n == width])
        going, width = np.concatenate(ahead), min(2 * width, 4096)
    return out


class Known:
    """Runs found so far, and whether a stretch lies within one of them."""

    def __init__(self) -> None:
        self.start = self.end = self.period = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        start, end, period = np.append(self.start, start), np.append(self.end, end), np.append(self.period, period)
        order = np.argsort(start, kind="stable")
        self.start, self.end, self.period = start[order], end[order], period[order]

    def holds(self, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
        """By runs of period most or less: where a stretch has another period too, and is as long as both, the smaller divides it."""
        if not len(self.start):
            return np.zeros(len(start), bool)
        reach, k = np.maximum.accumulate(np.where(self.period <= most, self.end, 0)), np.searchsorted(self.start, start, "right") - 1
        return (k >= 0) & (reach[np.maximum(k, 0)] >= end)


def word_runs(texts: list[np.ndarray], least: int = 24, times: float = 3.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of every run of at least least words and times (3 or more) periods, by text, start and period.

    texts hold numbers for words, from 0 on. A run is a stretch whose smallest period it keeps, and which no neighbouring
    word extends.
    """
    if times < 3 or least < 1:
        raise ValueError("runs are of three periods and one word at least")
    sizes = np.array([len(x) for x in texts], np.int64)
    begins = np.cumsum(np.append(1, sizes[:-1] + 1)).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    words = np.full(int(sizes.sum()) + len(sizes) + 1, -1, np.int64)
    for b, x in zip(begins, texts, strict=True):
        words[b : b + len(x)] = x
    cuts = words < 0
    words[cuts] = words.max(initial=0) + 1 + np.arange(int(cuts.sum()))
    known, level = Known(), 1
    while 2 * level <= (2 * least / 3 + 1) / 2:
        level *= 2
    prints, size = _mixed(words.astype(np.uint64)), 1
    lowest = level
    while True:
        long = sizes >= max(least, times * (1 if level == lowest else level))
        if not long.any():
            break
        while size < level:  # fingerprints of twice as many words
            a, b = prints[:-size], prints[size:]
            prints, size = _mixed(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(29)))), 2 * size
        n = np.where(long, sizes // level, 0)
        blocks = np.repeat(begins, n) + level * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        for low, high in [(q, q + 1) for q in range(1, 2 * level)] if level == lowest else [(level, 2 * level)]:
            at, apart = _caught(prints, blocks, level, low, high)
            new = ~known.holds(at, at + apart + level, level)
            known.add(*_merged(words, at[new], apart[new], level, least, times))
        level *= 2
    text = np.searchsorted(begins, known.start, "right") - 1
    order = np.lexsort((known.period, known.start))
    return text[order], (known.start - begins[text])[order] if len(order) else known.start, (known.end - known.start)[order], known.period[order]


def _caught(prints: np.ndarray, blocks: np.ndarray, level: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of each catcher whose words come again at a distance from low to high - 1."""
    blocks = blocks[blocks + low < len(prints)]
    later = np.lib.stride_tricks.sliding_window_view(np.append(prints, np.zeros(high - low, np.uint64)), high - low)
    at, apart, part = [], [], max(1, WIDE // (high - low))
    for k in range(0, len(blocks), part):
        own = blocks[k : k + part]
        i, j = np.nonzero(later[own + low] == prints[own][:, None])
        real = own[i] + low + j < len(prints)
        at.append(own[i][real])
        apart.append((low + j)[real])
    return (np.concatenate(at), np.concatenate(apart)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merged(words: np.ndarray, at: np.ndarray, apart: np.ndarray, level: int, least: int, times: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (start, end, period) of caught squares: adjoining ones of one period are one, which goes on as far as words agree."""
    order = np.lexsort((at, apart))
    at, apart = at[order], apart[order]
    first = np.ones(len(at), bool)
    first[1:] = (np.diff(apart) != 0) | (np.diff(at) != level)
    last = np.append(first[1:], True) if len(at) else first
    start, end, period = at[first], at[last] + level, apart[first]
    sure = _agree(words, start, period, 1) >= end - start  # fingerprints agree for equal words, and for others all but never
    start, end, period = start[sure], end[sure], period[sure]
    start, end = start - _agree(words, start - 1, period, -1), end + _agree(words, end, period, 1) + period
    good = end - start >= np.maximum(least, times * period)
    return start[good], end[good], period[good]


def kept_words(size: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of size words are in no run after its first period."""
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: float = 3.0) -> DataFrame:
    """Per row its id, its runs (start and length in words, period; by start, then period) and its text without repetitions: collapsed.

    Words end at ASCII white space; collapsed joins those that are kept, by one blank. A null or blank text
    has no runs and an empty collapsed text; repeated rows each get a row; null ids stay null; an empty table
    gives an empty one. Other columns are left out. Rows never leave their tasks, so no key can be hot.
    """
    key, runs, collapsed = fresh([], id_col, "runs", "collapsed") if id_col.lower() not in ("runs", "collapsed") else (id_col, *fresh([id_col], "runs", "collapsed"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField(runs, RUNS), T.StructField(collapsed, T.StringType())])

    def together(texts: list[list[bytes]]) -> tuple[list, list]:
        number: dict[bytes, int] = {}
        coded = [np.fromiter((number.setdefault(w, len(number)) for w in x), np.int64, len(x)) for x in texts]
        owner, start, length, period = word_runs(coded, least, times)
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        found, short = [], []
        for k, words in enumerate(texts):
            own = slice(edges[k], edges[k + 1])
            found.append([{"start": a, "length": b, "period": c} for a, b, c in zip(start[own].tolist(), length[own].tolist(), period[own].tolist(), strict=True)])
            if found[-1]:
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), start[own], length[own], period[own]))]
            short.append(b" ".join(words).decode())
        return found, short

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            begin, texts, words = 0, [], 0
            for k in range(batch.num_rows):
                texts.append((batch.column(1)[k].as_py() or "").encode().split())
                words += len(texts[-1])
                if words >= TOGETHER or k + 1 == batch.num_rows:
                    found, short = together(texts)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)).cast(arrow.field(0).type), pa.array(found, arrow.field(1).type), pa.array(short, arrow.field(2).type)], schema=arrow)
                    begin, texts, words = k + 1, [], 0

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)
