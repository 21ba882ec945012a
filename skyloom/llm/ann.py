"""Approximate nearest neighbours over balanced posting lists.

A bounded sample of the vectors is halved again and again at the median between two centres, which
gives lists of equal size; their means are the centroids. Every vector is then indexed: it goes to
its nearest centroid's list and, if it lies near a boundary, to further lists whose centroids are
nearly as close and not close to one another. Centroids are searched by a beam over an in-memory graph of
near neighbours; a query reads the lists whose centroids are within a ratio of its nearest one.
Distances are then exact, on the original vectors, in double precision.

Of equal vectors only the k + 1 smallest ids can be among the nearest k of anything, so the others
are left out before vectors move. Lists are split by a hash of the id where they are long, and so are the queries
that read a list where they are many: every part of a list meets every share of its queries, and no task
holds more than about PART_ROWS vectors and ASKS queries of a list. Queries whose lists hold fewer than k rows, though
there are more, read all lists.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite components, and
rows with a null id, take no part; vectors meet those with as many components only (a number of
components that the sample lacks has one list); rows with the query's id are not its candidates;
repeated rows of an id and vector count once, and an id's query is its smallest vector; ties go to the
smaller id; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import materialize
from skyloom.llm.vectors import rows_by_dim

#: Bounds of the fit: rows of the sample, bytes of it, and lists.
SAMPLE_ROWS, SAMPLE_BYTES, LISTS = 20_000, 64 << 20, 4_096
#: Rows of the table for each list, while there are fewer lists than LISTS.
LIST_ROWS = 128
NEIGHBOURS, FAR, PART_ROWS, ASKS = 12, 4, 8_192, 16_384
#: Of a vector: lists at most, how much further than the nearest their centroids may be, and how close, against
#: that distance, centroids of two of its lists may not be.
COPIES, NEAR, APART = 6, 0.15, 0.25
#: Of a query: the least breadth of the beam, and so lists at most, its share of all lists, and the same ratio.
BEAM, BEAM_SHARE, READ = 96, 1 / 16, 0.3


@dataclass
class Centroids:
    """Centres of one number of components, their graph, and the number of the first list."""

    first: int
    centres: np.ndarray
    graph: np.ndarray

    @staticmethod
    def fit(rows: np.ndarray, lists: int, first: int) -> Centroids:
        rng = np.random.default_rng(0)
        parts, depth = [rows], 0
        while 2 ** (depth + 1) <= lists and len(rows) >= 2 ** (depth + 2):
            parts, depth = [half for x in parts for half in _halves(x, rng)], depth + 1
        centres = np.unique(np.array([x.mean(axis=0) for x in parts if len(x)]), axis=0)
        m = min(NEIGHBOURS, max(1, len(centres) - 1))
        near = np.empty((len(centres), m), np.int32)
        for low in range(0, len(centres), 512):
            d = _square(centres[low : low + 512], centres)
            d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
            near[low : low + 512] = np.argsort(d, axis=1, kind="stable")[:, :m] if len(centres) > 1 else 0
        far = rng.integers(0, len(centres), (len(centres), FAR), dtype=np.int32)  # so that no part of the graph is cut off
        return Centroids(first, centres, np.concatenate([near, far], axis=1))

    def nearest(self, x: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Centres near each row, nearest first, and their distances; inf fills up."""
        k, b = len(self.centres), len(x)
        if k <= beam:
            d = _square(x, self.centres)
            at = np.argsort(d, axis=1, kind="stable")
            return at, np.sqrt(np.take_along_axis(d, at, axis=1))
        centres, x = self.centres.astype(np.float32), x.astype(np.float32)  # good enough to choose lists
        norms, own = (centres**2).sum(axis=1), (x**2).sum(axis=1)
        seen, line = np.zeros((b, k), bool), np.arange(b)[:, None]
        at = np.broadcast_to(np.linspace(0, k - 1, beam).astype(np.int32), (b, beam)).copy()
        seen[:, at[0]] = True
        d = own[:, None] - 2 * x @ centres[at[0]].T + norms[at[0]]
        done = np.zeros((b, beam), bool)
        order = np.argsort(d, axis=1, kind="stable")
        at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
        while True:
            pick = np.argsort(np.where(done, np.inf, d), axis=1, kind="stable")[:, :step]
            if np.take_along_axis(done, pick, 1).all():
                break
            fresh = ~np.take_along_axis(done, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            new = self.graph[np.take_along_axis(at, pick, 1)].reshape(b, -1)
            dist = own[:, None] - 2 * np.matmul(centres[new], x[:, :, None])[:, :, 0] + norms[new]
            known = seen[line, new] | ~np.repeat(fresh, self.graph.shape[1], axis=1)
            again = np.sort(new, axis=1)
            if (again[:, 1:] == again[:, :-1]).any():  # the same centre from two nodes
                order = np.argsort(new, axis=1, kind="stable")
                sorted_ = np.take_along_axis(new, order, 1)
                twice = np.zeros_like(known)
                np.put_along_axis(twice, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], 1)
                known |= twice
            seen[line, new] = True
            dist[known] = np.inf
            at, d, done = np.concatenate([at, new], 1), np.concatenate([d, dist], 1), np.concatenate([done, np.isinf(dist)], 1)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            at, d, done = (np.take_along_axis(y, order, 1) for y in (at, d, done))
        return at, np.sqrt(np.maximum(d, 0))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1), 0)


def _halves(rows: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Two halves of equal size around two centres."""
    if len(rows) < 2:
        return [rows]
    a, b = rows[rng.choice(len(rows), 2, replace=False)]
    for _ in range(6):
        order = np.argsort(_square(rows, np.array([a, b])) @ np.array([1.0, -1.0]), kind="stable")
        one, two = rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]
        a, b = one.mean(axis=0), two.mean(axis=0)
    return [one, two]


def chosen_lists(model: Centroids, rows: np.ndarray, beam: int, most: int, ratio: float, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest list and those within the ratio; apart leaves out lists much nearer to a chosen one than to the row."""
    at, d = model.nearest(rows, beam)
    at, d = at[:, :most], d[:, :most]
    take = d <= (1 + ratio) * d[:, :1]
    if apart:
        for j in range(1, at.shape[1]):
            for i in range(j):
                gap = np.sqrt(((model.centres[at[:, i]] - model.centres[at[:, j]]) ** 2).sum(axis=1))
                take[:, j] &= ~(take[:, i] & (gap < APART * d[:, j]))
    row, col = np.nonzero(take & np.isfinite(d))
    return row, at[row, col] + model.first


def _deal(vectors: DataFrame, models: dict[int, Centroids], beam: int, most: int, ratio: float, apart: bool) -> DataFrame:
    """vectors (id, vec) as (list, id, data), in every list that chosen_lists tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                for dim, (ids, rows) in rows_by_dim(batch.slice(low, 1024)).items():
                    row, list_ = chosen_lists(models[dim], rows, beam, most, ratio, apart) if dim in models else (np.arange(len(ids)), np.full(len(ids), -dim))
                    data = np.ascontiguousarray(rows, "<f8")
                    yield pa.RecordBatch.from_pydict({"list": pa.array(list_, pa.int32()), "id": pa.array(ids[row], pa.int64()), "data": pa.array([data[i].tobytes() for i in row], pa.binary())})

    return vectors.select("id", "vec").mapInArrow(run, "list int, id long, data binary")


def _nearest_in_part(rows: pa.Table, asks: pa.Table, k: int) -> pa.Table:
    out: list[tuple] = []
    if rows.num_rows and asks.num_rows:
        own = {(i, x) for i, x in zip(rows["id"].to_pylist(), rows["data"].to_pylist(), strict=True)}
        ids = np.array([i for i, _ in own])
        data = np.frombuffer(b"".join(x for _, x in own), "<f8").reshape(len(ids), -1)
        for query, x in zip(asks["id"].to_pylist(), asks["data"].to_pylist(), strict=True):
            gap = data - np.frombuffer(x, "<f8")
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            d[ids == query] = np.inf
            near = np.flatnonzero(d <= np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1])
            near = near[np.lexsort((ids[near], d[near]))][:k]
            out += [(query, i, s) for i, s in zip(ids[near].tolist(), d[near].tolist(), strict=True) if s < np.inf]
    q, v, s = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", ratio: float = READ, beam: int = BEAM) -> DataFrame:
    """For each row that is_query marks, the k nearest rows found: query_id, rank, vec_id, score (Euclidean distance)."""
    spark = vectors.sparkSession
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    fine = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and vec is not null").where(fine)
    first = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    held = materialize(rows.select("id", "vec").distinct().withColumn("nth", first).where(F.col("nth") <= k + 1).select("id", "vec"), "ann-rows")
    n, dim = held.agg(F.count("*"), F.max(F.size("vec"))).first()
    size = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * (dim or 1))))
    sample: dict[int, list] = {}
    for r in held.orderBy(F.xxhash64("id"), "id").limit(size).collect():
        sample.setdefault(len(r["vec"]), []).append(r["vec"])
    models: dict[int, Centroids] = {}
    for d, own in sorted(sample.items()):
        lists = min(LISTS, max(1, n // LIST_ROWS))
        models[d] = Centroids.fit(np.array(own), max(1, lists * len(own) // max(1, sum(map(len, sample.values())))), sum(len(m.centres) for m in models.values()))
    postings = materialize(_deal(held, models, 4 * COPIES, COPIES, NEAR, True), "ann-postings")
    parts = materialize(postings.groupBy("list").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "ann-parts")
    queries = rows.where("asks").groupBy("id").agg(F.min("vec").alias("vec"))

    def search(asks: DataFrame) -> DataFrame:
        """The k nearest rows of each query in the lists that asks (list, id, data) deals it to."""
        shares = asks.groupBy("list").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("shares"))
        both = parts.join(shares, "list")
        to_parts = asks.join(both, "list").withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        to_shares = postings.join(both, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        by = ["list", "part", "share"]
        found = to_shares.select(*by, "id", "data").groupBy(*by).cogroup(to_parts.select(*by, "id", "data").groupBy(*by)).applyInArrow(lambda a, b: _nearest_in_part(a, b, k), "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    lists = sum(len(m.centres) for m in models.values())
    beam = max(beam, int(lists * BEAM_SHARE))
    near = materialize(search(materialize(_deal(queries, models, beam, beam, ratio, False), "ann-asks")), "ann-found")
    got = near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("got"))
    there = held.groupBy(F.size("vec").alias("dim")).agg((F.count("*") - 1).alias("there"))  # a row for each number of components
    short = queries.withColumn("dim", F.size("vec")).join(there, "dim").join(got, "id", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), "there")).select("id", "vec")
    short = materialize(short, "ann-short")
    if not short.limit(1).count():
        return near
    more = search(materialize(_deal(short, models, lists + 1, lists + 1, float("inf"), False), "ann-asks"))
    return near.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(more)
