"""Vectors in Arrow batches, and tiles of them that meet in pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_SCHEMA = "part int, dim int, ids binary, data binary"


def rows_by_dim(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """ids and float64 rows of a batch (id long, vec array<double>) by number of components.

    Rows with a null id, a null or empty vector, or a null or non-finite component are left out.
    """
    ids, vec = batch.column("id"), batch.column("vec")
    values = vec.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    offsets = vec.offsets.to_numpy()
    size = np.diff(offsets)
    there = vec.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    known = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(size[there & (size > 0)]):
        at = np.flatnonzero(there & (size == dim))
        rows = values[offsets[at][:, None] + np.arange(dim)]
        fine = np.isfinite(rows).all(axis=1)
        if fine.any():
            out[int(dim)] = known[at[fine]], rows[fine]
    return out


def tiles(df: DataFrame, parts: int, keep: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """df (id, vec) dealt evenly into parts; a row for each part and number of components.

    keep makes the stored matrix of numbers of the given kind from float64 rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, list] = {}
        for batch in batches:
            for dim, (ids, rows) in rows_by_dim(batch).items():
                found.setdefault(dim, []).append((ids, keep(rows).astype(kind)))
        part = TaskContext.get().partitionId()
        for dim, own in found.items():
            ids, rows = (np.concatenate(x) for x in zip(*own, strict=True))
            order = np.argsort(ids, kind="stable")
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "data": [np.ascontiguousarray(rows[order]).tobytes()]}
            )

    return df.select("id", "vec").repartition(parts).mapInArrow(pack, TILE_SCHEMA)


def meet(rows: DataFrame, n_rows: int, queries: DataFrame, groups: int, partitions: int) -> DataFrame:
    """A stream for each tile of rows and group of queries: the tile (asks 0), then the group's tiles of queries (asks 1).

    A tile of rows is copied once for each group, a tile of queries to every tile of rows; streams are sorted within
    their partitions, so a task holds one tile of each side at a time, however many queries there are.
    """
    left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("turn"), F.lit(0).alias("asks"))
    dealt = queries.select(F.pmod("part", F.lit(groups)).alias("turn"), "dim", "ids", "data")
    right = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("part"), F.lit(1).alias("asks"))
    keys = ["part", "turn", "dim"]
    return left.unionByName(right).repartition(partitions, *keys).sortWithinPartitions(*keys, "asks").select(*keys, "asks", "ids", "data")

