"""Feedback as it arrives, and the versions of the model that it retrains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.learning import null_safe, running_sums

#: Answers between two versions, and the least of each kind that a first one needs.
INTERVAL, LEAST = 10, 5
SUMS = ["n", "n_pos", "n_neg", "s_pos", "s_neg", "squares"]


def versions(feedback: DataFrame, by: list[str], before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Versions that rows (by, seq, score, is_interesting) bring, and the state after them, given the state before.

    The first version comes as soon as there are ten answers with five of each kind, the next ones every ten answers. A
    version holds what its key's answers so far say: numbers of both kinds, contamination (share of the
    uninteresting, 0.01 to 0.5), threshold (midpoint of both kinds' mean scores), mean and deviation of scores. Rows
    without a score or an answer don't count.
    """
    good, score = F.col("is_interesting"), F.col("score")
    rows = feedback.where(good.isNotNull() & score.isNotNull() & ~F.isnan("score")).select(*by, "seq", score.cast("double").alias("score"), "is_interesting")
    kinds = {"n": F.lit(1), "n_pos": good.cast("int"), "n_neg": (~good).cast("int"), "s_pos": F.when(good, score).otherwise(0.0), "s_neg": F.when(~good, score).otherwise(0.0), "squares": score * score}
    so_far = running_sums(rows, by, "seq", kinds)
    if before is not None:
        past = before.select(*by, *[F.col(c).alias(f"p_{c}") for c in SUMS], F.col("first").alias("p_first"))
        so_far = null_safe(so_far, past, by, "left").select(*rows.columns, *[(F.col(c) + F.coalesce(f"p_{c}", F.lit(0))).alias(c) for c in SUMS], "p_first")
    else:
        so_far = so_far.withColumn("p_first", F.lit(None).cast("long"))
    ready = (F.col("n") >= INTERVAL) & (F.col("n_pos") >= LEAST) & (F.col("n_neg") >= LEAST)
    firsts = so_far.groupBy(*by).agg(F.coalesce(F.max("p_first"), F.min(F.when(ready, F.col("n")))).alias("first"), F.max_by(F.struct(*SUMS), "n").alias("last"))
    due = null_safe(so_far, firsts.select(*by, "first"), by, "inner").where((F.col("n") >= F.col("first")) & ((F.col("n") - F.col("first")) % INTERVAL == 0))
    mean = (F.col("s_pos") + F.col("s_neg")) / F.col("n")
    found = due.select(
        *by, ((F.col("n") - F.col("first")) / INTERVAL + 1).cast("long").alias("version"), "seq", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"),
        F.greatest(F.lit(0.01), F.least(F.col("n_neg") / F.col("n"), F.lit(0.5))).alias("contamination"), ((F.col("s_pos") / F.col("n_pos") + F.col("s_neg") / F.col("n_neg")) / 2).alias("threshold"),
        mean.alias("mean_score"), F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0))).alias("std_score"),
    )
    after = firsts.select(*by, "last.*", "first")
    if before is not None:
        after = after.unionByName(null_safe(before, firsts.select(*by), by, "left_anti").select(*after.columns))
    return found, after


def retrain(stream: DataFrame, by: list[str], folder: str) -> None:
    """Works off a stream of feedback into folder/models, a table of versions by batch.

    Each batch starts from the sums that the one before it left in folder/state, and replaces what it wrote itself
    if it is repeated, so a run that was stopped anywhere goes on with the same versions. Answers count in
    order of batches, and of seq within one.
    """
    spark = stream.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{folder}/state/batch={number - 1}") if number else None
        found, after = versions(batch, by, before)
        found.write.mode("overwrite").parquet(f"{folder}/models/batch={number}")
        after.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()


def models(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/models").drop("batch")


def latest(found: DataFrame, by: list[str]) -> DataFrame:
    """The newest version of each key."""
    rest = [c for c in found.columns if c not in by]
    return found.groupBy(*by).agg(F.max_by(F.struct(*rest), "version").alias("m")).select(*by, "m.*")
