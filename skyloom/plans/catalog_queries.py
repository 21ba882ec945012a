"""Queries over catalogs, light curves and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import sphere
from skyloom.operators import catalog, outliers, variability
from skyloom.plans.registry import query, shown
from skyloom.plans.relations import duck, relation
from skyloom.sources import survey

PI = "3.141592653589793e0"


def sep_sql(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """The haversine form, independent of the operator's."""
    return f"2 * degrees(asin(least(1, sqrt(power(sin(radians({dec2} - {dec1}) / 2), 2) + cos(radians({dec1})) * cos(radians({dec2})) * power(sin(radians({ra2} - {ra1}) / 2), 2)))))"


def robust_sql(table: str, by: str, value: str) -> str:
    """CTEs m and s: med and sigma by group."""
    return f"""m AS (SELECT {by}, median({value}) AS med, mad({value}) AS mad, stddev_pop({value}) AS std FROM {table} GROUP BY {by}),
    s AS (SELECT {by}, med, CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE std END AS sigma FROM m)"""


RUNAWAY_SQL = f"""{duck("sources")}, t AS (SELECT *, sqrt(pmra * pmra + pmdec * pmdec) AS pm FROM sources), {robust_sql("t", "region_id", "pm")}
SELECT region_id, source_id, round(pm, 6) AS pm, round((pm - med) / sigma, 6) AS deviation FROM t JOIN s USING (region_id)
WHERE sigma >= 1e-10 AND (pm - med) / sigma > 3 AND pm > 5"""


@query("runaway_outliers", RUNAWAY_SQL)
def runaway_outliers(spark, sf_dir):
    return shown(outliers.runaways(relation(spark, sf_dir, "sources")), "region_id", "source_id", "pm", "deviation")


@query("type_magnitude_filter", f"""{duck("sources")} SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag, obj_type FROM sources WHERE obj_type = 'star' AND mag BETWEEN 16 AND 20""")
def type_magnitude_filter(spark, sf_dir):
    return shown(catalog.to_table(catalog.by_magnitude(catalog.by_type(relation(spark, sf_dir, "sources"), "star"), 16, 20)), "source_id", "ra", "dec", "mag", "obj_type")


GALACTIC_SQL = f"""{duck("sources")}, v AS (
  SELECT source_id, cos(radians(dec)) * cos(radians(ra)) AS x, cos(radians(dec)) * sin(radians(ra)) AS y, sin(radians(dec)) AS z FROM sources),
p AS (SELECT radians(192.85948e0) AS a, radians(27.12825e0) AS d),
g AS (SELECT source_id, degrees(asin(x * cos(d) * cos(a) + y * cos(d) * sin(a) + z * sin(d))) AS b,
  122.93192e0 - degrees(atan2(-x * sin(a) + y * cos(a), z * cos(d) - sin(d) * (x * cos(a) + y * sin(a)))) AS l FROM v, p)
SELECT source_id, round(CASE WHEN l < 0 THEN l + 360 WHEN l >= 360 THEN l - 360 ELSE l END, 6) AS l, round(b, 6) AS b FROM g WHERE abs(b) >= 20"""


@query("galactic_high_latitude", GALACTIC_SQL)
def galactic_high_latitude(spark, sf_dir):
    found = catalog.high_latitude(relation(spark, sf_dir, "sources"))
    return shown(found.withColumn("l", sphere.galactic_lon(F.col("ra"), F.col("dec"))).withColumn("b", sphere.galactic_lat(F.col("ra"), F.col("dec"))), "source_id", "l", "b")


@query("cone_search_topn", f"""{duck("sources")} SELECT source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(mag, 6) AS mag FROM sources
WHERE {sep_sql("180", "20", "ra", "dec")} <= 15 ORDER BY mag, source_id LIMIT 50""")
def cone_search_topn(spark, sf_dir):
    return shown(catalog.cone(relation(spark, sf_dir, "sources"), 180, 20, 15 * 60, 50), "source_id", "ra", "dec", "mag")


@query("cones_per_region", f"""{duck("sources", "companions")}, r AS (SELECT source_id AS region_id, ra AS r_ra, dec AS r_dec FROM companions),
n AS (SELECT r.region_id, source_id, mag, {sep_sql("r_ra", "r_dec", "ra", "dec")} AS sep FROM sources, r),
k AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY mag, source_id) AS rank FROM n WHERE sep <= 6)
SELECT region_id, rank, source_id, round(mag, 6) AS mag, round(sep * 60, 5) AS sep_arcmin FROM k WHERE rank <= 5""")
def cones_per_region(spark, sf_dir):
    regions = relation(spark, sf_dir, "companions").select(F.col("source_id").alias("region_id"), "ra", "dec", F.lit(360.0).alias("radius_arcmin"))
    found = catalog.cones(relation(spark, sf_dir, "sources"), regions, 5)
    return shown(found.withColumn("sep_arcmin", F.round("sep_arcmin", 5)), "region_id", "rank", "source_id", "mag", "sep_arcmin")


MERGE_SQL = f"""{duck("sources", "companions")}, r AS (SELECT source_id, mag, 'right' AS origin, row_number() OVER (PARTITION BY source_id ORDER BY mag) AS nth FROM companions)
SELECT source_id, round(mag, 6) AS mag, 'left' AS origin FROM sources WHERE source_id % 5 <> 0
UNION ALL SELECT source_id, round(mag, 6), origin FROM r WHERE nth = 1 AND source_id NOT IN (SELECT source_id FROM sources WHERE source_id % 5 <> 0)"""


@query("catalog_merge_dedup", MERGE_SQL)
def catalog_merge_dedup(spark, sf_dir):
    left = relation(spark, sf_dir, "sources").where("source_id % 5 <> 0").select("source_id", "mag", F.lit("left").alias("origin"))
    right = relation(spark, sf_dir, "companions").select("source_id", "mag", F.lit("right").alias("origin"))
    return shown(catalog.merge(left, right, order="mag"))


@query("best_stats_row", f"""{duck("points")}, s AS (SELECT source_id, band, count(*) AS ngoodobs, max(mag) - min(mag) AS magrms, min(seq) AS seq FROM points GROUP BY 1, 2)
SELECT source_id, band, ngoodobs, round(magrms, 6) AS magrms FROM s QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ngoodobs DESC, seq) = 1""")
def best_stats_row(spark, sf_dir):
    stats = relation(spark, sf_dir, "points").groupBy("source_id", "band").agg(F.count("*").alias("ngoodobs"), (F.max("mag") - F.min("mag")).alias("magrms"), F.min("seq").alias("seq"))
    return shown(catalog.best_stats(stats), "source_id", "band", "ngoodobs", "magrms")


@query("light_curve_arrays", f"""{duck("points")} SELECT source_id, band, count(*) AS n, round(arg_min(mag, (mjd, mag)), 6) AS first_mag, round(arg_max(mag, (mjd, mag)), 6) AS last_mag FROM points GROUP BY 1, 2""")
def light_curve_arrays(spark, sf_dir):
    curves = catalog.light_curves(relation(spark, sf_dir, "points"))
    return shown(curves.select("source_id", "band", F.size("points").alias("n"), F.col("points")[0]["mag"].alias("first_mag"), F.element_at("points", -1)["mag"].alias("last_mag")))


@query("light_curve_summary", f"""{duck("points")}, b AS (SELECT source_id, max(mjd) - min(mjd) AS span, count(*) AS n FROM points GROUP BY source_id, band)
SELECT source_id, round(max(span), 5) AS baseline_days, sum(n)::BIGINT AS n_epochs FROM b GROUP BY source_id""")
def light_curve_summary(spark, sf_dir):
    return shown(catalog.baselines(relation(spark, sf_dir, "points")), digits=5)


EPOCH_SQL = f"""{duck("points")}, a AS (SELECT *, min(mjd) OVER w AS f, max(mjd) OVER w - min(mjd) OVER w AS span FROM points WINDOW w AS (PARTITION BY source_id, band)),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id, band ORDER BY mjd, seq) - 1 AS rank, count(*) OVER (PARTITION BY source_id, band) AS n FROM a WHERE span >= 1 AND mjd <= f + 20)
SELECT source_id, band, seq, rank FROM k WHERE n <= 5 OR rank IN (SELECT floor(i * (n - 1) / 4) FROM range(5) t(i))"""


@query("epoch_subsample", EPOCH_SQL)
def epoch_subsample(spark, sf_dir):
    return shown(catalog.choose_epochs(relation(spark, sf_dir, "points"), ["source_id", "band"], 5, 1, 20), "source_id", "band", "seq", "rank")


@query("stripe_footprint_runs", f"""{duck("sources")} SELECT DISTINCT floor(ra / 2)::BIGINT AS run, obj_type FROM sources WHERE abs(dec) <= 1.5 AND (ra >= 310 OR ra <= 60)""")
def stripe_footprint_runs(spark, sf_dir):
    found = relation(spark, sf_dir, "sources").where(sphere.in_stripe(F.col("ra"), F.col("dec")))
    return found.select(F.floor(F.col("ra") / 2).alias("run"), "obj_type").dropDuplicates()


@query("header_mjd", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey * 60e0 + 3456000000) / 86400 > 40000 THEN round((o_orderkey * 60e0 + 3456000000) / 86400, 6)
WHEN o_orderkey % 3 = 1 THEN o_orderkey * 1e0 ELSE epoch_us(o_orderdate) / 86400e6 + 40587 END AS mjd FROM orders""")
def header_mjd(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    tai = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 60.0 + 3456000000)
    own = F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderkey").cast("double"))
    return shown(orders.select("o_orderkey", catalog.mjd_of_header(tai, own, F.col("o_orderdate")).alias("mjd")))


@query("content_cache_keys", f"""{duck("companions")} SELECT source_id, substr(sha256(concat_ws(':', 'survey', printf('%.6f', ra), printf('%.6f', dec), printf('%.6f', 3e0), 'r')), 1, 16) AS key FROM companions""")
def content_cache_keys(spark, sf_dir):
    found = relation(spark, sf_dir, "companions")
    return found.select("source_id", catalog.cache_key(F.lit("survey"), F.col("ra"), F.col("dec"), F.lit(3.0), F.lit("r")).alias("key"))


HEX_SQL = f"""{duck("companions")}, f AS (SELECT source_id AS field_id, ra, dec, 2 * 30 * 0.8e0 / 60 AS step FROM companions),
g AS (SELECT field_id, j, i, dec + j * step AS td, ra, dec, step FROM f, range(-3, 4) a(j), range(-3, 4) b(i)),
t AS (SELECT *, ra + (i + CASE WHEN j % 2 = 0 THEN 0 ELSE 0.5e0 END) * step / greatest(cos(radians(td)), 0.1e0) AS tr FROM g WHERE td BETWEEN -90 AND 90),
w AS (SELECT *, tr - 360 * floor(tr / 360) AS tra FROM t), k AS (SELECT *, {sep_sql("ra", "dec", "tra", "td")} AS s FROM w)
SELECT field_id, row_number() OVER (PARTITION BY field_id ORDER BY j, i) AS tile, round(tra, 6) AS tile_ra, round(td, 6) AS tile_dec FROM k WHERE s * 60 <= 120"""


@query("hex_tiling", HEX_SQL)
def hex_tiling(spark, sf_dir):
    fields = relation(spark, sf_dir, "companions").select(F.col("source_id").alias("field_id"), "ra", "dec", F.lit(120.0).alias("radius_arcmin"))
    return shown(survey.hex_tiles(fields, 30.0))


@query("healpix_survey")
def healpix_survey(spark, sf_dir):
    return shown(survey.survey_pixels(spark, 16), "pixel", "ra", "dec", "b", "ord")


COVER_SQL = f"""{duck("sources")}, v AS (SELECT source_id % 3072 AS pixel, max(CASE WHEN mag > 20 THEN 1 ELSE 0 END) AS f FROM sources GROUP BY 1)
SELECT 3072::BIGINT AS total, count(*) AS visited, count_if(f > 0)::BIGINT AS with_findings, 3072 - count(*) AS remaining, round(count(*) / 3072e0 * 100, 2) AS percent FROM v"""


@query("survey_coverage", COVER_SQL)
def survey_coverage(spark, sf_dir):
    visited = relation(spark, sf_dir, "sources").select((F.col("source_id") % 3072).alias("pixel"), (F.col("mag") > 20).cast("int").alias("n_findings"))
    return shown(survey.coverage(survey.survey_pixels(spark, 16, 0.0, "ring"), visited))


@query("survey_next_pixels", f"""{duck("sources")} SELECT pixel FROM range(3072) t(pixel) WHERE pixel NOT IN (SELECT source_id % 3072 FROM sources WHERE source_id % 2 = 0) ORDER BY pixel LIMIT 25""")
def survey_next_pixels(spark, sf_dir):
    visited = relation(spark, sf_dir, "sources").where("source_id % 2 = 0").select((F.col("source_id") % 3072).alias("pixel"))
    return survey.next_pixels(survey.survey_pixels(spark, 16, 0.0, "ring"), visited, 25).select("pixel")


MIXED = "((xor((xor(({x} * 1103515245 + 12345) & 2147483647, (({x} * 1103515245 + 12345) & 2147483647) >> 15) * 1664525 + 1013904223) & 2147483647, ((xor(({x} * 1103515245 + 12345) & 2147483647, (({x} * 1103515245 + 12345) & 2147483647) >> 15) * 1664525 + 1013904223) & 2147483647) >> 13) * 69069 + 1) & 2147483647) / 2147483648e0"


@query("random_regions", f"""{duck("sources")}, d AS (SELECT i AS id, {MIXED.format(x="(i * 2 + 42)")} * 360 AS ra, degrees(asin(2 * ({MIXED.format(x="(i * 2 + 43)")}) - 1)) AS dec FROM range(300) t(i)),
r AS (SELECT id AS region_id, ra, dec FROM d WHERE abs(degrees(asin(sin(radians(dec)) * sin(radians(27.12825)) + cos(radians(dec)) * cos(radians(27.12825)) * cos(radians(ra - 192.85948))))) >= 20 ORDER BY id LIMIT 100),
n AS (SELECT r.region_id, count(*) AS n_sources, min(mag) AS brightest FROM r JOIN sources s ON {sep_sql("r.ra", "r.dec", "s.ra", "s.dec")} <= 10 GROUP BY 1)
SELECT region_id, round(ra, 6) AS ra, round(dec, 6) AS dec, coalesce(n_sources, 0) AS n_sources, round(brightest, 6) AS brightest FROM r LEFT JOIN n USING (region_id)""")
def random_regions(spark, sf_dir):
    """A hundred regions of ten degrees, and what each holds of the sources."""
    regions = survey.random_regions(spark, 100, radius_arcmin=600.0)
    return shown(survey.sources_in_regions(regions, relation(spark, sf_dir, "sources"), 600.0), "region_id", "ra", "dec", "n_sources", "brightest")


@query("robust_noise_outliers", f"""{duck("sources")}, {robust_sql("sources", "region_id", "noise")}
SELECT region_id, source_id, round((noise - med) / sigma, 6) AS deviation FROM sources JOIN s USING (region_id) WHERE (noise - med) / sigma > 5""")
def robust_noise_outliers(spark, sf_dir):
    return shown(outliers.astrometric(relation(spark, sf_dir, "sources")), "region_id", "source_id", "deviation")


PLX_SQL = "CASE WHEN parallax < 0 THEN 'negative_parallax' WHEN abs(parallax) / parallax_error < 0.2e0 THEN 'low_parallax_snr' END"


@query("parallax_anomalies", f"""{duck("sources")}, k AS (SELECT region_id, source_id, {PLX_SQL} AS anomaly_type FROM sources) SELECT * FROM k WHERE anomaly_type IS NOT NULL""")
def parallax_anomalies(spark, sf_dir):
    return outliers.parallax(relation(spark, sf_dir, "sources")).select("region_id", "source_id", "anomaly_type")


def binned_sql(table: str, value: str, per: int, by: str = "region_id", least: int = 3, rows: int = 10) -> str:
    return f"""e AS (SELECT {by}, min({value}) AS low, max({value}) AS high, greatest({least}, count({value}) // {per}) AS nb, count({value}) AS ng FROM {table} GROUP BY {by}),
    b AS (SELECT t.*, nb, low, high, floor(({value} - low) / (high - low) * nb)::INTEGER AS bin FROM {table} t JOIN e USING ({by}) WHERE ng >= {rows} AND high > low)"""


PHOT_SQL = f"""{duck("sources")}, {binned_sql("sources", "mag", 15)}, m AS (SELECT region_id, bin, median(bp_rp) AS med, mad(bp_rp) AS mad, stddev_pop(bp_rp) AS std FROM b WHERE bin < nb GROUP BY 1, 2 HAVING count(*) >= 3),
s AS (SELECT *, CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE std END AS sigma FROM m)"""


@query("photometric_bin_outliers", f"""{PHOT_SQL} SELECT region_id, source_id, bin::BIGINT AS bin, round((bp_rp - med) / sigma, 6) AS deviation FROM b JOIN s USING (region_id, bin) WHERE sigma >= 1e-6 AND abs((bp_rp - med) / sigma) > 4""")
def photometric_bin_outliers(spark, sf_dir):
    return shown(outliers.photometric(relation(spark, sf_dir, "sources")), "region_id", "source_id", "bin", "deviation")


@query("colour_bin_outliers", f"""{duck("sources")}, {binned_sql("sources", "mag", 20)}, m AS (SELECT region_id, bin, median(bp_rp) AS med, stddev_pop(bp_rp) AS std FROM b WHERE bin < nb GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT region_id, source_id, bin::BIGINT AS bin, round((bp_rp - med) / std, 6) AS deviation FROM b JOIN m USING (region_id, bin) WHERE std >= 1e-6 AND abs((bp_rp - med) / std) > 2.5""")
def colour_bin_outliers(spark, sf_dir):
    return shown(outliers.colours(relation(spark, sf_dir, "sources")), "region_id", "source_id", "bin", "deviation")


TRANSIENT_SQL = f"""{PHOT_SQL.replace(", s AS", ", sp AS").replace("s AS (SELECT *", "sp AS (SELECT *")}, {robust_sql("sources", "region_id", "noise").replace("m AS", "m2 AS").replace("FROM m)", "FROM m2)").replace("s AS (SELECT region_id, med", "sn AS (SELECT region_id, med")},
a AS (SELECT region_id, count(*) AS n FROM sources JOIN sn USING (region_id) WHERE (noise - med) / sigma > 5 GROUP BY 1),
p AS (SELECT region_id, count(*) AS n FROM b JOIN sp USING (region_id, bin) WHERE sigma >= 1e-6 AND abs((bp_rp - med) / sigma) > 4 GROUP BY 1),
x AS (SELECT region_id, count(*) AS n FROM sources WHERE {PLX_SQL} IS NOT NULL GROUP BY 1),
r AS (SELECT region_id, coalesce(a.n, 0) AS na, coalesce(p.n, 0) AS np, coalesce(x.n, 0) AS nx FROM (SELECT DISTINCT region_id FROM sources) LEFT JOIN a USING (region_id) LEFT JOIN p USING (region_id) LEFT JOIN x USING (region_id))
SELECT region_id, na AS n_astrometric, np AS n_photometric, nx AS n_parallax, round(0.4e0 * least(na, 5) / 5 + 0.3e0 * least(np, 5) / 5 + 0.3e0 * least(nx, 5) / 5, 6) AS transient_score FROM r"""


@query("transient_scores", TRANSIENT_SQL)
def transient_scores(spark, sf_dir):
    return shown(outliers.transient_scores(relation(spark, sf_dir, "sources")))


INDEX_CTE = f"""w AS (SELECT *, 1 / (magerr * magerr + 1e-10) AS wt, mag - lag(mag) OVER (PARTITION BY source_id, band ORDER BY mjd, seq) AS step FROM points),
u AS (SELECT source_id, band, sum(wt * mag) / sum(wt) AS wmean FROM w GROUP BY 1, 2),
i AS (SELECT source_id, band, count(*) AS n, sqrt(sum(wt * (mag - wmean) ** 2) / sum(wt)) AS weighted_stdev, sum(((mag - wmean) / (magerr + 1e-10)) ** 2) / (count(*) - 1) AS chi2_reduced,
  quantile_cont(mag, 0.75) - quantile_cont(mag, 0.25) AS iqr, CASE WHEN var_samp(mag) > 1e-10 THEN sum(step ** 2) / ((count(*) - 1) * var_samp(mag)) ELSE 2 END AS eta, max(mag) - min(mag) AS amplitude, mad(mag) AS median_abs_dev
  FROM w JOIN u USING (source_id, band) GROUP BY 1, 2 HAVING count(*) >= 5)"""
INDEX_COLUMNS = "source_id, band, n, round(weighted_stdev, 6) AS weighted_stdev, round(chi2_reduced, 6) AS chi2_reduced, round(iqr, 6) AS iqr, round(eta, 6) AS eta, round(amplitude, 6) AS amplitude, round(median_abs_dev, 6) AS median_abs_dev, chi2_reduced > 3 AS is_variable"


@query("variability_index", f"""{duck("points")}, {INDEX_CTE} SELECT {INDEX_COLUMNS} FROM i""")
def variability_index(spark, sf_dir):
    return shown(variability.indices(relation(spark, sf_dir, "points")))


@query("best_band_stats", f"""{duck("points")}, {INDEX_CTE} SELECT {INDEX_COLUMNS} FROM i QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY chi2_reduced DESC, band) = 1""")
def best_band_stats(spark, sf_dir):
    return shown(variability.best_band(variability.indices(relation(spark, sf_dir, "points"))))


BURST_CTE = """g AS (SELECT source_id, band, count(*) AS n, 1.4826e0 * mad(mag) AS gs FROM points GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT p.*, g.n, g.gs, list(mag) OVER (PARTITION BY source_id, band ORDER BY mjd, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a,
  row_number() OVER (PARTITION BY source_id, band ORDER BY mjd, seq) AS k, greatest(2, least(15, g.n // 4)) AS h FROM points p JOIN g USING (source_id, band) WHERE gs >= 1e-6),
l AS (SELECT *, a[greatest(1, k - h) : least(n, k + h)] AS win FROM f),
d AS (SELECT *, list_aggregate(win, 'median') AS base, 1.4826e0 * list_aggregate(win, 'mad') AS ls FROM l),
o AS (SELECT source_id, band, seq, mjd, mag, (base - mag) / CASE WHEN ls < 1e-6 THEN gs ELSE ls END AS dev FROM d)"""


@query("outbursts_rolling_median", f"""{duck("points")}, {BURST_CTE} SELECT source_id, band, seq, round(dev, 6) AS deviation_sigma, CASE WHEN dev > 0 THEN 'brightening' ELSE 'fading' END AS type FROM o WHERE abs(dev) > 3""")
def outbursts_rolling_median(spark, sf_dir):
    return shown(variability.outbursts(relation(spark, sf_dir, "points")), "source_id", "band", "seq", "deviation_sigma", "type")


CLASS_SQL = f"""{duck("points")}, {INDEX_CTE}, {BURST_CTE}, bb AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY chi2_reduced DESC, band) = 1),
c AS (SELECT source_id, band, count_if(dev > 3) AS up, count_if(dev < -3) AS down FROM o GROUP BY 1, 2),
z AS (SELECT bb.*, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM bb LEFT JOIN c USING (source_id, band)),
y AS (SELECT *, CASE WHEN NOT chi2_reduced > 3 THEN 'non_variable' WHEN down > 0 AND up = 0 THEN 'transient' WHEN up + down > 0 AND up <= 3 THEN 'eruptive' WHEN amplitude > 0.5 AND eta < 1.5 THEN 'agn_like' ELSE 'unclassified_variable' END AS class,
  least(1, 0.5 * least(1, log10(greatest(chi2_reduced, 1)) / 2) + 0.2 * least(1, (up + down) / 5)) AS score FROM z)"""


@query("variable_classes", f"""{CLASS_SQL} SELECT source_id, band, up::BIGINT AS brightenings, down::BIGINT AS fadings, class, round(score, 6) AS score FROM y""")
def variable_classes(spark, sf_dir):
    return shown(variability.classify(relation(spark, sf_dir, "points")), "source_id", "band", "brightenings", "fadings", "class", "score")


@query("variability_overall", f"""{CLASS_SQL}, t AS (SELECT band, avg(score) AS m FROM (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY band ORDER BY score DESC) <= 10) GROUP BY band)
SELECT band, count(*) AS n_sources, count_if(chi2_reduced > 3)::BIGINT AS n_variable, round(least(1, 0.4 * count_if(chi2_reduced > 3) / count(*) + 0.6 * any_value(m)), 6) AS variability_score FROM y JOIN t USING (band) GROUP BY band""")
def variability_overall(spark, sf_dir):
    found = variability.classify(relation(spark, sf_dir, "points"))
    return shown(variability.overall(found, ["band"]), "band", "n_sources", "n_variable", "variability_score")


@query("variability_from_stats", f"""{duck("points")}, s AS (SELECT source_id, stddev_pop(mag) AS rms, median(magerr) AS err, max(mag) AS hi, min(mag) AS lo FROM points GROUP BY 1)
SELECT source_id, round((rms / err) ** 2, 6) AS chi2_reduced, 2e0 AS eta, round(hi - lo, 6) AS amplitude, (rms / err) ** 2 > 3 AS is_variable, CASE WHEN hi - lo > 1 THEN 1 ELSE 0 END::BIGINT AS n_outbursts FROM s WHERE rms > 0 AND err > 0""")
def variability_from_stats(spark, sf_dir):
    stats = relation(spark, sf_dir, "points").groupBy("source_id").agg(F.stddev_pop("mag").alias("magrms"), F.median("magerr").alias("medmagerr"), F.max("mag").alias("maxmag"), F.min("mag").alias("minmag"))
    stats = stats.withColumn("vonneumannratio", F.lit(None).cast("double")).withColumn("maxslope", F.col("maxmag") - F.col("minmag"))
    return shown(variability.from_stats(stats), "source_id", "chi2_reduced", "eta", "amplitude", "is_variable", "n_outbursts")


PERIODS = """pt AS (SELECT source_id, band, mjd - min(mjd) OVER c AS t, mag, 1 / (magerr ** 2 + 1e-10) / sum(1 / (magerr ** 2 + 1e-10)) OVER c AS w, count(*) OVER c AS m FROM points WINDOW c AS (PARTITION BY source_id, band)),
pw AS (SELECT *, mag - sum(w * mag) OVER (PARTITION BY source_id, band) AS q FROM pt WHERE m >= 10),
pc AS (SELECT source_id, band, any_value(m) AS m, 1 / least(500, max(t) / 2) AS low, sum(w * q * q) AS yy, sum(w * t * t) - sum(w * t) ** 2 AS tt, least(10000, greatest(100, floor((10e0 - 1 / least(500, max(t) / 2)) * max(t) * 5)))::BIGINT AS n FROM pw GROUP BY 1, 2 HAVING max(t) >= 0.2 AND 1 / least(500, max(t) / 2) < 10 AND sum(w * q * q) > 0),
pf AS (SELECT source_id, band, yy, low + k * (10e0 - low) / (n - 1) AS f FROM pc, LATERAL (SELECT unnest(range(n)) AS k)),
ps AS (SELECT source_id, band, f, any_value(yy) AS yy, sum(w * cos(2 * pi() * f * t)) AS c, sum(w * sin(2 * pi() * f * t)) AS s, sum(w * q * cos(2 * pi() * f * t)) AS yc, sum(w * q * sin(2 * pi() * f * t)) AS ys,
  sum(w * cos(2 * pi() * f * t) ** 2) AS cc, sum(w * sin(2 * pi() * f * t) ** 2) AS ss, sum(w * cos(2 * pi() * f * t) * sin(2 * pi() * f * t)) AS cs FROM pf JOIN pw USING (source_id, band) GROUP BY 1, 2, 3),
pd AS (SELECT source_id, band, f, yy, yc, ys, cc - c * c AS cc, ss - s * s AS ss, cs - c * s AS cs FROM ps),
pb AS (SELECT source_id, band, arg_max(f, p) AS f, greatest(0, least(1, max(p))) AS z FROM (SELECT *, CASE WHEN cc * ss - cs * cs > 1e-12 THEN (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (yy * (cc * ss - cs * cs)) ELSE 0 END AS p FROM pd) GROUP BY 1, 2),
pg AS (SELECT source_id, band, 1 / f AS best_period, z AS best_power, 1 - (1 - (1 - z) ** ((m - 3) / 2e0)) * exp(-sqrt(2e0 / (m - 1)) * exp(lgamma((m - 1) / 2e0 + 0.5) - lgamma((m - 1) / 2e0)) * 10 * sqrt(4 * pi() * greatest(tt, 0)) * (1 - z) ** ((m - 4) / 2e0) * sqrt(greatest(0.5 * (m - 1) * z, 0))) AS fap FROM pb JOIN pc USING (source_id, band)),
pr AS (SELECT source_id, band, best_period, best_power, least(1, fap) AS fap, fap < 0.01 AS is_periodic FROM pg)"""


@query("lomb_scargle", f"""{duck("points")}, {PERIODS} SELECT source_id, band, round(best_period, 5) AS best_period, round(best_power, 5) AS best_power, round(fap, 5) AS fap, is_periodic FROM pr""")
def lomb_scargle(spark, sf_dir):
    return shown(variability.periodograms(relation(spark, sf_dir, "points")), "source_id", "band", "best_period", "best_power", "fap", "is_periodic", digits=5)


@query("periodic_classes", f"""{CLASS_SQL}, {PERIODS}, x AS (SELECT z.*, best_period, coalesce(is_periodic, false) AS is_periodic, coalesce(best_power, 0) AS best_power, coalesce(fap, 1) AS fap FROM z LEFT JOIN pr USING (source_id, band))
SELECT source_id, band, round(best_period, 5) AS best_period, is_periodic, CASE WHEN NOT chi2_reduced > 3 THEN 'non_variable' WHEN is_periodic AND best_period < 1 AND amplitude > 0.3 THEN 'eclipsing_binary' WHEN is_periodic AND best_period > 100 THEN 'long_period_variable' WHEN is_periodic THEN 'periodic_pulsator'
 WHEN down > 0 AND up = 0 THEN 'transient' WHEN up + down > 0 AND up <= 3 THEN 'eruptive' WHEN amplitude > 0.5 AND eta < 1.5 THEN 'agn_like' ELSE 'unclassified_variable' END AS class,
 round(least(1, 0.5 * least(1, log10(greatest(chi2_reduced, 1)) / 2) + 0.3 * best_power * CASE WHEN fap < 0.01 THEN 1 ELSE 0.3 END + 0.2 * least(1, (up + down) / 5)), 5) AS score FROM x""")
def periodic_classes(spark, sf_dir):
    """Classes and scores of variable sources with the periods of their best band."""
    points = relation(spark, sf_dir, "points")
    found = variability.classify(points, periods=variability.periodograms(points))
    return shown(found, "source_id", "band", "best_period", "is_periodic", "class", "score", digits=5)
