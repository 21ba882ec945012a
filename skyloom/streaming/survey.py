"""Streams: the survey queue as a resumable stream, and light curves that grow as points arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REGION = "region_id long, ra double, dec double, radius_arcmin double, priority int"
POINT = "source_id long, band string, ts timestamp, mag double, magerr double"


def run_queue(spark: SparkSession, queue: str, checkpoint: str, results: str, detect: Callable[[DataFrame], DataFrame], per_batch: int = 1) -> None:
    """Works off the Parquet files of a queue of regions, per_batch files at a time, and stops when none is left.

    Offsets live in the checkpoint, so a run that was stopped goes on where it was; each batch writes to a
    folder named by its number, so a batch that is repeated replaces what it wrote. Regions go by priority.
    """

    def work(batch: DataFrame, number: int) -> None:
        found = detect(batch.orderBy("priority", "region_id"))
        found.write.mode("overwrite").parquet(f"{results}/batch={number}")

    stream = spark.readStream.schema(REGION).option("maxFilesPerTrigger", per_batch).parquet(queue)
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_brightness(points: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, mean and range of each light curve by tumbling window; points later than the watermark are left out."""
    w = F.window("ts", width)
    out = points.withWatermark("ts", late).groupBy("source_id", "band", w).agg(F.count("*").alias("n"), F.avg("mag").alias("mean_mag"), (F.max("mag") - F.min("mag")).alias("amplitude"))
    return out.select("source_id", "band", F.col("window.start").alias("start"), "n", "mean_mag", "amplitude")


def observing_sessions(points: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Runs of points of a source with no gap longer than gap."""
    out = points.withWatermark("ts", late).groupBy("source_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("source_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def median_of(ordered: list[float]) -> float:
    k = len(ordered) // 2
    return ordered[k] if len(ordered) % 2 else (ordered[k - 1] + ordered[k]) / 2


def running_outbursts(points: DataFrame, threshold: float = 3.0, memory: int = 31) -> DataFrame:
    """Points that differ from the median of their light curve's last memory points by more than threshold robust deviations.

    The state of a light curve is its last memory magnitudes, however long it grows.
    """
    columns = ["source_id", "band", "ts", "mag", "deviation_sigma", "type"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        own = [(ts, mag) for batch in batches for ts, mag in zip(batch["ts"].to_numpy(), batch["mag"].tolist(), strict=True)]
        own.sort(key=lambda point: (point[0] != point[0], point[0]))  # points without a time come last
        rows = []
        for ts, mag in own:
            if len(last) >= 5:
                middle = median_of(sorted(last))
                sigma = 1.4826 * median_of(sorted([abs(x - middle) for x in last]))
                if sigma > 1e-6 and abs(dev := (middle - mag) / sigma) > threshold:
                    rows.append((*key, pd.Timestamp(ts), mag, dev, "brightening" if dev > 0 else "fading"))
            last.append(mag)
            if len(last) > memory:
                del last[0]
        state.update((last,))
        if rows:  # most light curves have none, and a frame costs more than their points
            yield pd.DataFrame(rows, columns=columns)

    kind = dict(points.dtypes)["source_id"]
    schema = f"source_id {kind}, band string, ts timestamp, mag double, deviation_sigma double, type string"
    return points.select("source_id", "band", "ts", "mag").groupBy("source_id", "band").applyInPandasWithState(step, schema, "last array<double>", "append", GroupStateTimeout.NoTimeout)
