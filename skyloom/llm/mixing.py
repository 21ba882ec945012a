"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1],
``w(t) = weight * (1 + tilt * (2t - 1))``, whose integral over the whole run is its weight. The
integrals share the words of the corpus, within a bound on repeats; each copy of a document stands at
some cumulative number of words of its source's demand, and the inverse of the integrated schedule at
that number is its training position. The mix is the documents range-sorted by position.

Only sums by (source, hash bucket) are gathered for the running totals, so that one source with a
third of the rows is spread over BUCKETS windows.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows of
size 0 take nothing; rows alike in every column that orders them (identifier, size, text) are
interchangeable; an empty table gives an empty mix; other columns are carried unchanged, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import fresh, materialize, word_count

#: Hash buckets of a source: three hexadecimal digits of the order key.
BUCKET_DIGITS = 3


def cyclic_weights(rank: Column) -> Column:
    """1, 2, 3, 1, ... for ranks 1, 2, 3, 4, ..."""
    return F.pmod(rank - 1, F.lit(3)).cast("double") + 1


def default_tilt(weight: Column) -> Column:
    """Light sources early, heavy ones late, the middle ones evenly."""
    return (weight - 2) / 2


def shares(sizes: DataFrame, weights: Callable[[Column], Column], max_repeats: int) -> tuple[DataFrame, float, float]:
    """sizes (key, source, source_size) with weight and target, by water-filling.

    A target is the source's weight times a level, at most max_repeats times its size; the level rises
    until the targets share all words. Each turn needs two sums over the table of sources.
    """
    ranked = materialize(
        sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).select(
            "key", "source", "source_size", weights(F.col("rank")).alias("weight")
        ),
        "mix-sources",
    )
    total, weight, n = ranked.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    level, capped = ((total or 0) / weight if weight else 0.0), 0
    full = lambda x: F.col("weight") * F.lit(x) >= F.col("source_size") * F.lit(max_repeats)
    for _ in range(n):
        rest, held, count = ranked.agg(
            F.sum(F.when(~full(level), F.col("weight"))), F.sum(F.when(full(level), F.col("source_size"))), F.count_if(full(level))
        ).first()
        if count == capped or not rest:
            break
        level, capped = ((total - max_repeats * held) / rest), count
    target = F.when(full(level), (F.col("source_size") * max_repeats).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.withColumn("target", target), level, total or 0


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Callable[[Column], Column] = cyclic_weights,
    tilt: Callable[[Column], Column] = default_tilt,
    max_repeats: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: size, source_size, target, taken and positions (one for each copy that the mix takes).

    keep: the columns of docs to carry, by default the identifier alone. A source's documents stand in
    the order of a hash of their identifiers; the mix takes as many whole passes over them as the target
    holds, and in one more pass those whose middle word is within the rest. So a source misses its target
    by half a document at most.
    """
    keep = [id_col] if keep is None else keep
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    doc_id, text, source = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    sized = materialize(
        docs.select(
            *carried,
            F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n")).alias("key"),
            source.cast("string").alias("source"),
            word_count(text).alias("size"),
            F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.xxhash64(text).cast("string"))).cast("binary")).alias("order"),
            F.xxhash64(text).alias("tie"),
        ).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS)),
        "mix-sizes",
    )
    buckets = sized.groupBy("key", "source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals, _, _ = shares(buckets.groupBy("key", "source").agg(F.sum("bucket_size").alias("source_size")), weights, max_repeats)
    starts = buckets.select(
        "key", "bucket", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start")
    ).join(totals.drop("source"), "key")
    here = Window.partitionBy("key", "bucket").orderBy("order", "size", "tie")
    before = F.coalesce(F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.withColumn("before", before).join(starts, ["key", "bucket"])
    middle = F.col("start") + F.col("before") + F.col("size") / 2
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    placed = placed.select("*", middle.alias("middle"), passes.alias("passes"))
    more = (F.col("middle") < F.col("target") - F.col("passes") * F.col("source_size")) & (F.col("size") > 0)
    copies = F.when(F.col("size") > 0, F.col("passes") + more.cast("int")).otherwise(F.lit(0))
    placed = placed.select("*", copies.alias("copies"), tilt(F.col("weight")).alias("tilt"))

    def position(j: Column) -> Column:
        y = (j * F.col("source_size") + F.col("middle")) / F.col("target")
        a = F.col("tilt")
        return 2 * y / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * y))

    each = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    own = fresh(keep, "size", "source_size", "target", "taken", "positions")
    made = [F.col("size"), F.col("source_size"), F.col("target"), (F.col("size") * F.col("copies")).cast("long"), each]
    return placed.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[x.alias(n) for x, n in zip(made, own, strict=True)])


def in_order(plan: DataFrame, id_col: str = "doc_id", positions: str = "positions", partitions: int | None = None) -> DataFrame:
    """plan range-sorted by first position (documents that the mix leaves out last), which is told with the last one: first_position, last_position."""
    first, last = F.get(F.col(f"`{positions}`"), F.lit(0)), F.try_element_at(F.col(f"`{positions}`"), F.lit(-1))
    placed = plan.select("*", first.alias("first_position"), last.alias("last_position"))
    order = [F.col("first_position").asc_nulls_last(), F.col(f"`{id_col}`")]
    n = partitions or int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, *order).sortWithinPartitions(*order)


def curriculum_mix(docs: DataFrame, partitions: int | None = None, **options) -> DataFrame:
    """The documents in training order, each as often as the mix takes it, with the columns of docs."""
    columns = docs.columns
    plan = plan_mix(docs, keep=columns, **options)
    positions, position = plan.columns[-1], fresh(plan.columns, "position")[0]
    out = plan.select(*[F.col(f"`{c}`") for c in columns], F.explode(F.col(f"`{positions}`")).alias(position))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [position, f"`{options.get('id_col', 'doc_id')}`"]
    return out.repartitionByRange(n, *order).sortWithinPartitions(*order).drop(position)
