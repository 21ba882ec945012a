"""Named sources of tables, what they offer, and their union over regions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.catalog import cones

Reader = Callable[[SparkSession], DataFrame]


@dataclass
class Source:
    """A source: its bands, and readers of catalog, images and epochs, absent where it has none."""

    name: str
    bands: tuple[str, ...] = ()
    catalog: Reader | None = None
    images: Reader | None = None
    epochs: Reader | None = None
    is_available: Callable[[SparkSession], bool] = field(default=lambda spark: True)


SOURCES: dict[str, Source] = {}


def register(source: Source) -> Source:
    SOURCES[source.name] = source
    return source


def available(spark: SparkSession, names: list[str] | None = None) -> list[Source]:
    return [s for n, s in SOURCES.items() if (names is None or n in names) and s.is_available(spark)]


def parquet_source(name: str, folder: str, bands: tuple[str, ...] = ()) -> Source:
    """A source over folder/catalog, folder/images and folder/epochs in Parquet; filters and columns reach the scans."""
    reader = lambda part: lambda spark: spark.read.parquet(f"{folder}/{part}")
    return register(Source(name, bands, reader("catalog"), reader("images"), reader("epochs")))


def fetch_catalogs(spark: SparkSession, regions: DataFrame, names: list[str] | None = None, most: int = 10_000) -> DataFrame:
    """The brightest sources of every region from every source, in one job: (region_id, source, ...); columns that a source lacks are null."""
    out = None
    for s in available(spark, names):
        if s.catalog:
            own = cones(s.catalog(spark), regions, most).withColumn("source", F.lit(s.name))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source with a catalog is available")
    return out


def fetch_images(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Images of all sources; key is the band, prefixed by the source where several have that band for a region."""
    from pyspark.sql import Window

    out = None
    for s in available(spark, names):
        if s.images:
            own = s.images(spark).withColumn("source", F.lit(s.name))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source with images is available")
    several = F.size(F.collect_set("source").over(Window.partitionBy("region_id", "band"))) > 1
    return out.withColumn("key", F.when(several, F.concat_ws("_", "source", "band")).otherwise(F.col("band")))


def fetch_epochs(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Epochs of all sources, in time order within each region and band of a partition."""
    parts = [s.epochs(spark).withColumn("source", F.lit(s.name)) for s in available(spark, names) if s.epochs]
    if not parts:
        raise ValueError("no source with epochs is available")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.repartition("region_id", "band").sortWithinPartitions("region_id", "band", "mjd")


def epochs_of_band(images: DataFrame, epochs: DataFrame) -> DataFrame:
    """For each image (region_id, band) the band whose epochs serve it: its own with two or more, else the region's first such."""
    counts = epochs.groupBy("region_id", F.col("band").alias("epoch_band")).agg(F.count("*").alias("n")).where("n >= 2")
    first = counts.groupBy("region_id").agg(F.min("epoch_band").alias("first_band"))
    own = images.select("region_id", "band").distinct().join(counts.drop("n").withColumn("band", F.col("epoch_band")), ["region_id", "band"], "left")
    return own.join(first, "region_id", "left").select("region_id", "band", F.coalesce("epoch_band", "first_band").alias("epoch_band"))
