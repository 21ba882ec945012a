"""Bootstrap intervals and randomisation tests of any statistic that sums determine, in one pass over the rows.

A statistic is a list of column expressions, whose weighted sums over rows are its state, and a function from
the sums to a value. A task keeps a vector of states, one for each replicate, for each group it meets, and these
vectors add up; so rows are never copied once for each replicate, and a hot group is only many small vectors.
Weights come from a plain integer mixing of (seq, replicate), so reruns agree, and SQL can follow them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers that a task keeps before it hands its vectors on.
HELD = 1 << 21
_MASK = (1 << 31) - 1


@dataclass(frozen=True)
class Statistic:
    """parts: what is summed of a row; value: the statistic of the sums, an array column."""

    parts: tuple[Column, ...]
    value: Callable[[Column], Column]


def mean(of: Column) -> Statistic:
    return Statistic((of, F.lit(1.0)), lambda s: s[0] / F.nullif(s[1], F.lit(0.0)))


def ratio(above: Column, below: Column) -> Statistic:
    return Statistic((above, below), lambda s: s[0] / F.nullif(s[1], F.lit(0.0)))


def deviation(of: Column) -> Statistic:
    return Statistic((of * of, of, F.lit(1.0)), lambda s: F.sqrt(F.greatest(s[0] / F.nullif(s[2], F.lit(0.0)) - (s[1] / F.nullif(s[2], F.lit(0.0))) * (s[1] / F.nullif(s[2], F.lit(0.0))), F.lit(0.0))))


def median(of: Column, low: float, high: float, bins: int = 64) -> Statistic:
    """The middle of the bin of equal width from low to high that holds the median; values beyond count in the last bins."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((of - low) / (high - low) * bins)))

    def value(s: Column) -> Column:
        half = F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / 2
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
        below = F.aggregate(s, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["below"] + F.when(a["sum"] + x < half, 1).otherwise(0)).alias("below")))["below"]
        return F.when(half > 0, low + (below + 0.5) * (high - low) / bins)

    return Statistic(tuple(F.when(at == k, 1.0).otherwise(0.0) for k in range(bins)), value)


def unit(seq: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """Even numbers from 0 to 1 of every row and replicate, by whole numbers below 2^31."""
    x = (seq.astype(np.int64)[:, None] % (_MASK + 1) + replicate[None, :] * 7919) & _MASK
    x = (x * 1103515245 + 12345) & _MASK
    x ^= x >> 15
    x = (x * 1664525 + 1013904223) & _MASK
    x ^= x >> 13
    x = (x * 69069 + 1) & _MASK
    return (x ^ (x >> 16)) / float(_MASK + 1)


def poisson_cuts(most: int = 8) -> list[float]:
    """Where the cumulated Poisson probabilities of mean 1 lie: a weight is the number of cuts below a unit number."""
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(most):
        total += p
        cuts.append(total)
        p /= k + 1
    return cuts


def replicate_sums(rows: DataFrame, by: list[str], parts: tuple[Column, ...], replicates: int, share: Column | None = None, seq: str = "seq") -> DataFrame:
    """(by, replicate, sums) with replicate 0 for the rows as they are.

    Each row counts with a Poisson weight of mean 1; with share, as often as a unit number is below it, 0 or 1. Rows whose
    parts hold a null or whose seq is null are left out.
    """
    keys = T.StructType([rows.schema[c] for c in by])
    schema = T.StructType([*keys.fields, T.StructField("replicate", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])
    m, cuts, drawn = len(parts), np.array(poisson_cuts()), share is not None
    own = rows.select(*by, F.col(seq).cast("long").alias("_seq"), (F.lit(-1.0) if share is None else share).alias("_share"), F.array(*[p.cast("double") for p in parts]).alias("_parts"))
    own = own.where(F.col("_seq").isNotNull() & F.col("_share").isNotNull() & ~F.exists("_parts", lambda x: x.isNull()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, sums, turns = to_arrow_schema(schema), {}, np.arange(1, replicates + 1)

        def out() -> pa.RecordBatch:
            rows = [dict(zip(by, key, strict=True)) | {"replicate": r, "sums": v.tolist()} for key, s in sums.items() for r, v in enumerate(s)]
            sums.clear()
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        for batch in batches:
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))], strict=True)) if by else [()] * batch.num_rows
            place: dict[tuple, int] = {}
            group = np.array([place.setdefault(k, len(place)) for k in names], np.int64)
            at = len(by)
            seqs, shares, values = batch.column(at).to_numpy(), batch.column(at + 1).to_numpy(), batch.column(at + 2).flatten().to_numpy().reshape(-1, m)
            for key, g in place.items():
                where = np.flatnonzero(group == g) if len(place) > 1 else np.arange(len(group))
                for a in range(0, len(where), 1 << 14):
                    i = where[a : a + (1 << 14)]
                    u = unit(seqs[i], turns)
                    w = u < shares[i][:, None] if drawn else (u[:, :, None] > cuts).sum(2)
                    here = np.concatenate([values[i].sum(0)[None], w.T.astype(float) @ values[i]])
                    sums[key] = sums[key] + here if key in sums else here
                if len(sums) * (replicates + 1) * m > HELD:
                    yield out()
        if sums:
            yield out()

    partial = own.mapInArrow(work, schema)
    return partial.groupBy(*by, "replicate").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(m)]).alias("sums"))


def bootstrap(rows: DataFrame, by: list[str], statistic: Statistic, replicates: int = 200, level: float = 0.95, seq: str = "seq") -> DataFrame:
    """Estimate, percentile interval and spread of a statistic of each group; null where sums give no value."""
    values = replicate_sums(rows, by, statistic.parts, replicates, seq=seq).withColumn("value", statistic.value(F.col("sums")))
    drawn, half = F.when(F.col("replicate") > 0, F.col("value")), (1 - level) / 2
    return values.groupBy(*by).agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), F.percentile(drawn, F.lit(half)).alias("low"), F.percentile(drawn, F.lit(1 - half)).alias("high"), F.stddev_pop(drawn).alias("spread"))


def randomisation_test(rows: DataFrame, by: list[str], statistic: Statistic, label: str, rounds: int = 200, seq: str = "seq") -> DataFrame:
    """Two-sided p of the difference of a statistic between rows with the label and those without, for groups that have both.

    In each round every row has the label with the group's share of labels, whatever its own; a round in which one
    side is empty counts as far as the observed one.
    """
    first = rows.where(F.col(label).isNotNull())
    share = first.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("_p")).where("_p > 0 and _p < 1")
    m, own = len(statistic.parts), F.col(label)
    both = first.join(share, by)
    mine = replicate_sums(both, by, (*statistic.parts, *[F.when(own, p.cast("double")).otherwise(0.0) for p in statistic.parts]), rounds, F.col("_p"), seq)
    whole = mine.where("replicate = 0").select(*by, F.col("sums").alias("whole"))
    # replicate 0 has the true labels' sums in its second half, the others drawn sums in their first
    one = F.when(F.col("replicate") == 0, F.slice("sums", m + 1, m)).otherwise(F.slice("sums", 1, m))
    apart = mine.join(whole, by).withColumn("one", one).withColumn("rest", F.zip_with(F.slice("whole", 1, m), F.col("one"), lambda a, b: a - b))
    apart = apart.withColumn("d", F.abs(statistic.value(F.col("one")) - statistic.value(F.col("rest"))))
    seen = apart.where("replicate = 0").select(*by, F.col("d").alias("observed"))
    far = F.count_if(F.coalesce(F.col("d") >= F.col("observed"), F.lit(True)))
    return apart.where("replicate > 0").join(seen, by).groupBy(*by).agg(F.max("observed").alias("observed"), ((far + 1) / F.lit(rounds + 1)).alias("p_value"))
