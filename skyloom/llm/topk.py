"""Exact top-k search by integer inner product over a bit-sliced index.

Components become floor(scale * x). Rows are dealt into tiles of bounded bytes, the queries likewise, and every
tile of rows meets every tile of queries once: a tile's index is built once for each group of queries (one group
where there are tiles enough), and queries stream past it. In a tile, an attribute is a stack of bitmaps, one bitmap of all
rows for each binary digit of (value - smallest value). A query adds, for each set digit of each of its
coefficients, the attribute's slices at that shift, with full adders over whole bitmaps; a negative
coefficient adds the complemented slices, and a constant sets that right. The sum is again a stack of
slices, read from the most significant one down to keep the k best rows; rows tied at the boundary go
by smaller id. Scores of chosen rows are computed once more from their values, exactly whatever their size.

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows with a
null id, take no part; vectors meet those with as many components only; rows with the query's id are
not its candidates; a query given by several rows counts once, with the smallest vector; repeated
candidate rows are all ranked; empty tables give no rows. Scaled components of 2^62 or more, and scores among the
k best that a long does not hold, are errors. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.vectors import meet, tiles

#: A score is high * 2^62 + low; far beyond a long, high stands still.
SCHEMA = "query_id long, vec_id long, high long, low long"
BITS = 62
#: Scaled components are below this; the bytes of a tile.
LARGEST, TILE_BYTES = 1 << BITS, 32 << 20


class Slices:
    """The bit-sliced index of a tile's integer matrix."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data, n = ids, data, len(ids)
        self.words = -(-n // 64)
        self.low = data.min(axis=0)
        shifted = (data - self.low).T
        self.digits = [int(x).bit_length() for x in shifted.max(axis=1)]
        self.slices = [[self.bitmap((row >> j) & 1) for j in range(m)] for row, m in zip(shifted, self.digits, strict=True)]
        self.inverse = [[~x for x in own] for own in self.slices]
        self.all = self.bitmap(np.ones(n, np.uint8))

    def bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the query's scores, up to a constant, least significant first."""
        levels: list[list[np.ndarray]] = []
        for d, q in enumerate(query.tolist()):
            own, q, shift = (self.slices if q > 0 else self.inverse)[d], abs(q), 0
            while q:
                if q & 1:
                    for j, x in enumerate(own, shift):
                        while len(levels) <= j:
                            levels.append([])
                        levels[j].append(x)
                q, shift = q >> 1, shift + 1
        out, at = [], 0
        while at < len(levels):
            here = levels[at]
            if len(here) > 1 and at + 1 == len(levels):
                levels.append([])
            while len(here) > 2:
                a, b, c = here.pop(), here.pop(), here.pop()
                x = a ^ b
                carry = a & b
                carry |= x & c
                x ^= c
                here.append(x)
                levels[at + 1].append(carry)
            if len(here) == 2:
                a, b = here
                levels[at + 1].append(a & b)
                here = [a ^ b]
            out.append(here[0] if here else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> np.ndarray:
        """The positions of the k best rows; ties by id."""
        tied = self.all.copy()
        own = np.searchsorted(self.ids, [query_id, query_id + 1])
        for at in range(*own):
            tied[at >> 6] &= ~np.uint64(1 << (at & 63))
        sure, n_sure = np.zeros_like(tied), 0
        if int(np.bitwise_count(tied).sum()) > k:
            for x in reversed(self.sums(query)):
                high = tied & x
                n = int(np.bitwise_count(high).sum())
                if n_sure + n > k:
                    tied = high
                else:
                    sure |= high
                    tied &= ~x
                    n_sure += n
                if n_sure == k:
                    break
        return np.concatenate([self.rows(sure), self.rows(tied)[: k - n_sure]])


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as whole numbers."""
    out = np.floor(scale * x)
    if out.size and not np.abs(out).max() < LARGEST:
        raise OverflowError(f"a scaled component is not below 2^{BITS}")
    return out


def exact_scores(data: np.ndarray, query: np.ndarray) -> list[int]:
    if len(data) and float(np.abs(data).max()) * float(np.abs(query.astype(float)).sum()) < LARGEST:
        return (data @ query).tolist()
    own = query.tolist()
    return [sum(a * b for a, b in zip(row, own, strict=True)) for row in data.tolist()]


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Streams of meet: what each tile's best rows for each query are."""
    now, tile = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            part, turn, dim, asks = (batch.column(j)[i].as_py() for j in range(4))
            ids, data = np.frombuffer(batch.column(4)[i].as_buffer(), "<i8"), np.frombuffer(batch.column(5)[i].as_buffer(), "<i8").reshape(-1, dim)
            if not asks:
                now, tile = (part, turn, dim), Slices(ids.copy(), data.copy())
                continue
            if now != (part, turn, dim):
                continue  # no rows of that many components in the tile
            out: list[tuple] = []
            for query_id, query in zip(ids.tolist(), data, strict=True):
                at = tile.best(query_id, query, k)
                out += zip([query_id] * len(at), tile.ids[at].tolist(), exact_scores(tile.data[at], query), strict=True)
            if out:
                q, v, s = zip(*out, strict=True)
                high = [max(-LARGEST, min(LARGEST, x >> BITS)) for x in s]
                yield pa.RecordBatch.from_pydict({k: pa.array(x, pa.int64()) for k, x in (("query_id", q), ("vec_id", v), ("high", high), ("low", [x & (LARGEST - 1) for x in s]))})


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", tile_rows: int = 65_536
) -> DataFrame:
    """For each row that is_query marks, its k best other rows: query_id, rank, vec_id, score.

    A tile of queries holds 1/64 of them, at least 64 and at most tile_rows, whatever their number is.
    """
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    n, asks, dim = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vec"))).first()
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile_rows = max(64, min(tile_rows, TILE_BYTES // (8 * max(1, dim or 1))))
    parts, per = max(1, -(-n // tile_rows)), min(tile_rows, max(64, -(-asks // 64)))
    q_parts = max(1, -(-asks // per))
    groups = max(1, min(q_parts, -(-partitions // parts)))  # more than one only where tiles are too few for all tasks
    queries = rows.where("asks and id is not null and vec is not null").groupBy("id").agg(F.min("vec").alias("vec"))
    floor = lambda x: scaled(x, scale)
    found = meet(tiles(rows, parts, floor, "<i8"), parts, tiles(queries, q_parts, floor, "<i8"), groups, max(partitions, parts)).mapInArrow(lambda x: search(x, k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.col("high").desc(), F.col("low").desc(), "vec_id")
    score = F.when(F.col("high").between(-2, 1), F.col("high") * LARGEST + F.col("low")).otherwise(F.raise_error(F.lit("a score is beyond a long")).cast("long"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
