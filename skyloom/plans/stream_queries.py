"""Streams over the events table, worked off to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.plans.registry import query, shown
from skyloom.plans.relations import RELATIONS
from skyloom.plans.survey_queries import FEED
from skyloom.sources.storage import shared_folder
from skyloom.streaming import feedback, survey


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of points; the glob lets a single file be a source."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return events.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("band"), F.col("ts").cast("timestamp").alias("ts"), (15 + F.col("value") / 100).alias("mag"), F.lit(0.1).alias("magerr"))


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives until its input ends; offsets, state and result lie in the shared folder.

    In update mode, which drops state by the watermark, a row of keys is as the last batch that changed it left it.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/skyloom-streams/{uuid.uuid4().hex}"
    put = (lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out")) if mode == "complete" else (lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}"))
    writer = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/out")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("now")).select(*keys, "now.*")


@query("stream_daily_brightness", """SELECT user_id AS source_id, event_type AS band, epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS n, round(avg(15 + value / 100), 6) AS mean_mag, round(max(15 + value / 100) - min(15 + value / 100), 6) AS amplitude FROM events GROUP BY ALL""")
def stream_daily_brightness(spark, sf_dir):
    found = drained(survey.windowed_brightness(points(spark, sf_dir)), "update", ["source_id", "band", "start"])
    return shown(found.withColumn("day", F.unix_seconds("start")), "source_id", "band", "day", "n", "mean_mag", "amplitude")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id AS source_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    found = drained(survey.observing_sessions(points(spark, sf_dir)), "complete")
    return found.select("source_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_outbursts")
def stream_outbursts(spark, sf_dir):
    found = drained(survey.running_outbursts(points(spark, sf_dir)), "append")
    return shown(found, "source_id", "band", "mag", "deviation_sigma", "type")


@query("stream_model_versions", f"""{FEED}, so AS (SELECT detector, seq, count(*) OVER w AS n, count(*) FILTER (good) OVER w AS n_pos, count(*) FILTER (NOT good) OVER w AS n_neg, sum(score) FILTER (good) OVER w AS s_pos, sum(score) FILTER (NOT good) OVER w AS s_neg, sum(score * score) OVER w AS sq
 FROM f WHERE score IS NOT NULL AND good IS NOT NULL WINDOW w AS (PARTITION BY detector ORDER BY seq ROWS UNBOUNDED PRECEDING)),
fi AS (SELECT detector, min(n) AS first FROM so WHERE n >= 10 AND n_pos >= 5 AND n_neg >= 5 GROUP BY 1)
SELECT so.detector, (n - first) // 10 + 1 AS version, seq, n_pos, n_neg, round(greatest(0.01, least(n_neg / n, 0.5)), 11) AS contamination, round((s_pos / n_pos + s_neg / n_neg) / 2, 11) AS threshold, round((s_pos + s_neg) / n, 11) AS mean_score,
round(sqrt(greatest(0, sq / n - ((s_pos + s_neg) / n) ** 2)), 11) AS std_score FROM so JOIN fi ON so.detector IS NOT DISTINCT FROM fi.detector WHERE n >= first AND (n - first) % 10 = 0""")
def stream_model_versions(spark, sf_dir):
    """Scores are multiples of 1/4000, so means of few rows tie at six digits; at eleven they don't."""
    documents = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/documents.parquet").schema).parquet(f"{sf_dir}/documents.parquet*")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("is_interesting"))
    answers = documents.selectExpr(*[f"{x} AS {c}" for c, x in RELATIONS["feedback"][1].items()]).join(labels, "seq")
    folder = f"{shared_folder(spark)}/skyloom-streams/{uuid.uuid4().hex}"
    feedback.retrain(answers, ["detector"], folder)
    return shown(feedback.models(spark, folder), digits=11)
