"""Catalogs: filters, cone scans, merges, light-curve assembly, epoch choice and cache keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.sphere import galactic_lat, in_box, separation
from skyloom.sources.storage import saved


def by_type(catalog: DataFrame, obj_type: str) -> DataFrame:
    return catalog.where(F.col("obj_type") == obj_type)


def by_magnitude(catalog: DataFrame, low: float = -30.0, high: float = 30.0) -> DataFrame:
    """Within the bounds, both included; null and NaN fall out."""
    return catalog.where(F.col("mag").between(low, high) & ~F.isnan("mag"))


def to_table(catalog: DataFrame) -> DataFrame:
    return catalog.select("ra", "dec", F.coalesce("mag", F.lit(float("nan"))).alias("mag"), "obj_type", "source_id")


def high_latitude(catalog: DataFrame, least: float = 20.0) -> DataFrame:
    return catalog.where(F.abs(galactic_lat(F.col("ra"), F.col("dec"))) >= least)


def null_if_zero(*columns: str) -> list[Column]:
    """What the loader does to photometry and astrometry that is exactly 0."""
    return [F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in columns]


def cone(catalog: DataFrame, ra: float, dec: float, radius_arcmin: float, most: int = 10_000) -> DataFrame:
    """The brightest sources of one cone; its box reaches the scan, and top-k needs no full sort."""
    near = catalog.where(in_box(F.col("ra"), F.col("dec"), ra, dec, radius_arcmin / 60)).where(separation(F.lit(ra), F.lit(dec), F.col("ra"), F.col("dec")) * 60 <= radius_arcmin)
    return near.orderBy(F.col("mag").asc_nulls_last(), "source_id").limit(most)


def cones(catalog: DataFrame, regions: DataFrame, most: int = 10_000, cell_deg: float = 5.0) -> DataFrame:
    """The brightest sources of many cones at once.

    regions (region_id, ra, dec, radius_arcmin) and sources meet on cells of declination and, within
    a band, of right ascension; a region is asked in the cells that its box touches. The sources of a cell lie in tiers by
    brightness, the first of most sources and each next one twice as large. All regions meet the first tiers of their cells; a
    further tier is met only by regions that have too few sources yet or whose last one is fainter than the tier's brightest.
    So a region reads as many sources as it returns, times the cells it touches, however dense they are.
    """
    order = [F.col("mag").asc_nulls_last(), F.col("source_id").asc()]
    place = F.struct(F.col("mag").isNull().alias("none"), F.col("mag").alias("mag"), F.col("source_id").alias("id"))
    keyed = catalog.drop("region_id").withColumn("d", F.floor(F.col("dec") / cell_deg)).withColumn("a", F.floor(F.col("ra") / cell_deg))
    nth = F.row_number().over(Window.partitionBy("d", "a").orderBy(*order)) - 1
    keyed = saved(keyed.withColumn("tier", F.floor(F.log2(nth / most + 1)).cast("int")))
    heads = saved(keyed.groupBy("d", "a", "tier").agg(F.min(place).alias("head")))
    r = F.col("radius_arcmin") / 60
    low, high = F.floor((F.col("r_dec") - r) / cell_deg), F.floor((F.col("r_dec") + r) / cell_deg)
    own = regions.select("region_id", F.col("ra").alias("r_ra"), F.col("dec").alias("r_dec"), "radius_arcmin").withColumn("d", F.explode(F.sequence(low, high)))
    top = F.least(F.lit(89.999), F.abs(F.col("r_dec")) + r)
    wide = F.when(F.abs(F.col("r_dec")) + r >= 89.9, F.lit(180.0)).otherwise(F.least(F.lit(180.0), r / F.cos(F.radians(top))))
    last = int(-(-360 // cell_deg)) - 1
    cells = F.array_distinct(F.transform(F.sequence(F.floor((F.col("r_ra") - wide) / cell_deg), F.floor((F.col("r_ra") + wide) / cell_deg)), lambda c: F.pmod(c, F.lit(last + 1))))
    parts = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, found = saved(own.withColumn("a", F.explode(cells)).withColumn("tier", F.lit(0))), None
    best = Window.partitionBy("region_id").orderBy(*order)
    while True:
        # dealt by region too: a cell's sources are few in a tier, its regions may be many
        near = asked.repartition(parts, "region_id", "d", "a").join(keyed, ["d", "a", "tier"]).withColumn("sep_arcmin", separation(F.col("r_ra"), F.col("r_dec"), F.col("ra"), F.col("dec")) * 60)
        near = near.where(F.col("sep_arcmin") <= F.col("radius_arcmin")).drop("d", "a", "tier", "r_ra", "r_dec", "radius_arcmin")
        near = near if found is None else found.drop("rank").unionByName(near)
        found = saved(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most))
        full = found.where(F.col("rank") == most).select("region_id", place.alias("worst"))
        asked = asked.withColumn("tier", F.col("tier") + 1).join(heads, ["d", "a", "tier"]).join(full, "region_id", "left")
        asked = saved(asked.where(F.col("worst").isNull() | (F.col("head") < F.col("worst"))).drop("head", "worst"))
        if not asked.limit(1).count():
            return found


def merge(left: DataFrame, right: DataFrame, id_col: str = "source_id", order: str = "seq") -> DataFrame:
    """All of left, and of right the first row of each id that left lacks; empty ids are always kept."""
    known = F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
    first = right.where(known).withColumn("nth", F.row_number().over(Window.partitionBy(id_col).orderBy(order))).where("nth = 1").drop("nth")
    new = first.join(left.where(known).select(id_col).distinct(), id_col, "left_anti")
    return left.unionByName(new, allowMissingColumns=True).unionByName(right.where(~known), allowMissingColumns=True)


def best_stats(stats: DataFrame, id_col: str = "source_id", count: str = "ngoodobs", order: str = "seq") -> DataFrame:
    """The row with most observations of each source, the first of equals; none where that is 0."""
    n = F.coalesce(F.col(count), F.lit(0))
    return stats.withColumn("nth", F.row_number().over(Window.partitionBy(id_col).orderBy(n.desc(), order))).where((F.col("nth") == 1) & (n > 0)).drop("nth")


def light_curves(points: DataFrame) -> DataFrame:
    """(source_id, band) with the points in time order; a missing error counts as 0.1."""
    point = F.struct("mjd", "mag", F.coalesce("magerr", F.lit(0.1)).alias("magerr"))
    return points.groupBy("source_id", "band").agg(F.sort_array(F.collect_list(point)).alias("points"))


def baselines(points: DataFrame) -> DataFrame:
    """Longest baseline of a band and number of epochs of all bands, by source; plain two-level sums."""
    bands = points.groupBy("source_id", "band").agg((F.max("mjd") - F.min("mjd")).alias("span"), F.count("*").alias("n"))
    return bands.groupBy("source_id").agg(F.max("span").alias("baseline_days"), F.sum("n").alias("n_epochs"))


def choose_epochs(epochs: DataFrame, by: list[str], most: int = 10, least_days: float = 1.0, most_days: float = 2000.0, order: str = "seq") -> DataFrame:
    """Epochs from the first one on, as far as most_days, thinned evenly to most; groups of shorter baseline fall out."""
    w = Window.partitionBy(*by)
    kept = epochs.withColumn("first", F.min("mjd").over(w)).withColumn("span", F.max("mjd").over(w) - F.col("first")).where(F.col("span") >= least_days).where(F.col("mjd") <= F.col("first") + most_days)
    kept = kept.withColumn("rank", F.row_number().over(w.orderBy("mjd", order)) - 1).withColumn("n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * (F.col("n") - 1) / (most - 1)).cast("int"))
    return kept.where((F.col("n") <= most) | F.array_contains(picks, F.col("rank"))).drop("first", "span", "n")


def mjd_of_header(tai: Column, mjd: Column, date_obs: Column) -> Column:
    """Seconds of TAI where they give a plausible day, else the header's own day, else its date."""
    days = tai / 86400
    return F.coalesce(F.when(days > 40000, days), mjd, F.unix_micros(date_obs.cast("timestamp")) / 86400e6 + 40587)


def cache_key(source: Column, ra: Column, dec: Column, radius: Column, band: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256 over source and position to six decimals."""
    return F.substring(F.sha2(F.concat_ws(":", source, *[F.format_string("%.6f", x) for x in (ra, dec, radius)], band), 256), 1, 16)
