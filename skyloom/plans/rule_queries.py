"""Queries over confidences, rules of single surveys, colours and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import confidence, surveys
from skyloom.plans.registry import query, shown
from skyloom.plans.relations import duck, relation

ANOM, SRC, PTS, PIX, VEC = (duck(x) for x in ("anomalies", "sources", "points", "pixels", "vectors"))
DETECTORS = ("lens", "morphology", "distribution", "galaxy", "kinematic", "transient", "sersic", "wavelet", "population", "anomaly", "classical", "variability", "temporal")
#: Properties of the synthetic anomalies by detector, as expressions that both engines read.
PROPERTIES = {
    "lens": {"snr": "score * 6 - 1", "completeness": "score"},
    "morphology": {"C_zscore": "score * 3 - 1", "A_zscore": "CAST(seq % 5 AS DOUBLE) - 2"},
    "distribution": {"sigma": "score * 7"},
    "galaxy": {"tidal_snr": "score * 5 - 1", "asymmetry_sigma": "score * 4"},
    "kinematic": {"n_members": "CAST(seq % 9 AS DOUBLE)", "expected_field": "1.5e0"},
    "transient": {"deviation_sigma": "score * 5"},
    "sersic": {"residual_snr": "score * 3 - 1", "chi2_reduced": "0.8e0 + score"},
    "wavelet": {"peak_snr": "score * 6", "n_scales": "CAST(seq % 7 AS DOUBLE)"},
    "population": {"n_sources_with_color": "CAST(seq % 60 AS DOUBLE)", "bs_fraction": "score / 10", "n_red_giants": "CAST(seq % 6 AS DOUBLE)", "rgb_fraction": "score / 5"},
    "anomaly": {},
    "classical": {"hough_votes": "CAST(seq % 23 AS DOUBLE) - 3", "gabor_energy": "score * 2"},
    "variability": {"chi2_reduced": "0.5e0 + score * 2", "n_epochs": "11e0", "fap": "score / 97"},
    "temporal": {"peak_snr": "score * 6 - 1"},
}
KINDS = "CASE seq % 4 WHEN 0 THEN 'lens_ring' WHEN 1 THEN 'merger' WHEN 2 THEN 'red_giant' ELSE 'periodic_variable' END"
NAMES = sorted({k for x in PROPERTIES.values() for k in x})


def detector_sql() -> str:
    return "CASE seq % 13 " + " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DETECTORS)) + " END"


def _normal(z: str) -> str:
    """The upper tail of the normal distribution by its series."""
    return f"CASE WHEN {z} <= 0 THEN 0.5 ELSE greatest(0, 0.5 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(150), lambda k: exp((2 * k + 1) * ln({z}) + 0.5 * ln(pi()) - (k + 1) * ln(2) - lgamma(k + 1.5))))) END"


def _poisson(n: str, m: str) -> str:
    return f"greatest(0, 1 - list_sum(list_transform(range({n}), lambda i: exp(-{m} + i * ln({m}) - lgamma(i + 1)))))"


def _binomial(n: str, trials: str, rate: float) -> str:
    return f"greatest(0, 1 - list_sum(list_transform(range({n}), lambda i: exp(lgamma({trials} + 1) - lgamma(i + 1) - lgamma({trials} - i + 1) + i * ln({rate}) + ({trials} - i) * ln({1 - rate})))))"


def _chi2(x: str, half: int) -> str:
    return f"list_sum(list_transform(range({half}), lambda i: exp(-({x}) / 2 + i * ln(({x}) / 2) - lgamma(i + 1))))"


def confidence_sql() -> str:
    """One branch for each detector, written from the rules themselves."""
    props = ", ".join(f"CASE detector {' '.join(f'WHEN {d!r} THEN {x[n]}' for d, x in PROPERTIES.items() if n in x)} END AS {n}" for n in NAMES)
    two = lambda z: f"(2 * ({_normal(f'abs({z})')}))"
    proxy, fallback = "greatest(1 - score, 1e-15)", "CASE WHEN score > 0 THEN greatest(1 - score, 1e-15) ELSE 1 END"
    fisher = "-2 * (" + " + ".join(f"CASE WHEN {z} <> 0 THEN ln(greatest({two(z)}, 1e-300)) ELSE 0 END" for z in ("c_zscore", "a_zscore")) + ")"
    return f"""{ANOM}, d AS (SELECT seq, score / 1.0283e0 AS score, {detector_sql()} AS detector, {KINDS} AS kind FROM anomalies), q AS (SELECT *, {props} FROM d),
z AS (SELECT *, CASE detector WHEN 'lens' THEN CASE WHEN kind = 'lens_ring' AND completeness > 0 AND snr <= 0 THEN completeness * 5 WHEN snr <= 0 THEN score ELSE snr END
 WHEN 'distribution' THEN CASE WHEN sigma <= 0 THEN score ELSE sigma END WHEN 'galaxy' THEN CASE WHEN kind = 'merger' THEN CASE WHEN asymmetry_sigma <= 0 THEN score ELSE asymmetry_sigma END WHEN tidal_snr <= 0 THEN score ELSE tidal_snr END
 WHEN 'wavelet' THEN CASE WHEN peak_snr <= 0 THEN score ELSE peak_snr END WHEN 'temporal' THEN CASE WHEN peak_snr <= 0 THEN score ELSE peak_snr END
 WHEN 'classical' THEN gabor_energy WHEN 'sersic' THEN residual_snr WHEN 'transient' THEN CASE WHEN deviation_sigma <= 0 THEN score ELSE deviation_sigma END END AS zz,
 {fisher} AS fs, (c_zscore <> 0)::INT + (a_zscore <> 0)::INT AS nz FROM q),
p AS (SELECT *, CASE detector WHEN 'morphology' THEN CASE nz WHEN 0 THEN {proxy} WHEN 1 THEN {_chi2('fs', 1)} ELSE {_chi2('fs', 2)} END
 WHEN 'transient' THEN {two('zz')}
 WHEN 'kinematic' THEN CASE WHEN n_members > 0 THEN {_poisson('n_members::BIGINT', '1.5')} ELSE {proxy} END
 WHEN 'classical' THEN CASE WHEN hough_votes > gabor_energy THEN {_poisson('greatest(hough_votes::BIGINT, 1)', 'greatest(hough_votes * 0.1, 1)')} ELSE {_normal('zz')} END
 WHEN 'sersic' THEN CASE WHEN residual_snr <= 0 AND chi2_reduced <= 1 THEN {fallback} ELSE least(CASE WHEN residual_snr > 0 THEN {_normal('zz')} ELSE 1 END, CASE WHEN chi2_reduced > 1 THEN {_chi2('chi2_reduced * 100', 50)} ELSE 1 END) END
 WHEN 'population' THEN CASE WHEN kind = 'red_giant' THEN CASE WHEN n_red_giants > 0 AND n_sources_with_color >= 5 THEN {_binomial('n_red_giants::BIGINT', 'n_sources_with_color', 0.05)} ELSE {fallback} END
  WHEN bs_fraction > 0 AND n_sources_with_color >= 5 THEN {_binomial('greatest(1, floor(bs_fraction * n_sources_with_color))::BIGINT', 'n_sources_with_color', 0.01)} ELSE {fallback} END
 WHEN 'variability' THEN CASE WHEN kind = 'periodic_variable' THEN fap WHEN chi2_reduced > 1 THEN {_chi2('chi2_reduced * 10', 5)} ELSE {fallback} END
 WHEN 'anomaly' THEN {proxy} ELSE {_normal('zz')} END AS p_value FROM z),
c AS (SELECT *, least(1, p_value * CASE detector WHEN 'distribution' THEN 100 WHEN 'wavelet' THEN greatest(n_scales, 4) ELSE 1 END) AS p_corrected FROM p)
SELECT seq, detector, round(p_value, 7) AS p_value, round(p_corrected, 7) AS p_corrected, round(CASE WHEN detector = 'anomaly' OR (detector = 'morphology' AND nz = 0) THEN score ELSE 1 - p_corrected END, 7) AS confidence FROM c"""


def measured(spark, sf_dir):
    own = relation(spark, sf_dir, "anomalies").selectExpr("seq", "score / 1.0283e0 AS score", f"{detector_sql()} AS detector", f"{KINDS} AS anomaly_type")
    pairs = [x for n in NAMES for x in (F.lit(n), F.expr("CASE detector " + " ".join(f"WHEN '{d}' THEN {p[n]}" for d, p in PROPERTIES.items() if n in p) + " END"))]
    return own.withColumn("properties", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))


@query("detector_confidences", confidence_sql())
def detector_confidences(spark, sf_dir):
    return shown(confidence.confidences(measured(spark, sf_dir)), "seq", "detector", "p_value", "p_corrected", "confidence", digits=7)


@query("top_by_confidence", f"""{ANOM} SELECT seq, round(CASE WHEN seq % 3 = 0 THEN 1 - p_value ELSE score END, 9) AS sure FROM anomalies ORDER BY CASE WHEN seq % 3 = 0 THEN 1 - p_value ELSE score END DESC, seq LIMIT 20""")
def top_by_confidence(spark, sf_dir):
    found = relation(spark, sf_dir, "anomalies").withColumn("confidence", F.when(F.col("seq") % 3 == 0, 1 - F.col("p_value")))
    return shown(confidence.by_confidence(found).select("seq", F.coalesce("confidence", "score").alias("sure")), digits=9)


@query("decoded_types", f"""{SRC} SELECT source_id, CASE source_id % 7 WHEN 3 THEN 'galaxy' WHEN 6 THEN 'star' ELSE 'unknown' END AS obj_type FROM sources""")
def decoded_types(spark, sf_dir):
    return surveys.with_types(relation(spark, sf_dir, "sources").withColumn("type", F.col("source_id") % 7)).select("source_id", "obj_type")


@query("matched_scan", f"""{SRC} SELECT CAST(source_id AS VARCHAR) AS source_id, round(ra, 6) AS ra, round(dec, 6) AS dec, round(CASE WHEN source_id % 5 <> 0 THEN mag END, 6) AS mag FROM sources""")
def matched_scan(spark, sf_dir):
    table = relation(spark, sf_dir, "sources").select(F.col("source_id").alias("MatchID"), F.col("ra").alias("MatchRA"), F.col("dec").alias("MatchDec"), F.when(F.col("source_id") % 5 == 0, float("nan")).otherwise(F.col("mag")).alias("W3_F606W"))
    return shown(surveys.matched_catalog(table))


@query("clean_light_curves", f"""{PTS}, k AS (SELECT source_id, CASE seq % 5 WHEN 1 THEN 'g' WHEN 2 THEN 'r' WHEN 3 THEN 'i' END AS band, mjd, mag, CASE WHEN seq % 4 = 0 THEN 0.1 ELSE magerr END AS magerr FROM points WHERE seq % 3 <> 0)
SELECT source_id, band, count(*) AS n, round(arg_min(mag, (mjd, mag, magerr)), 6) AS first_mag, round(sum(magerr), 6) AS total_error FROM k WHERE band IS NOT NULL GROUP BY 1, 2""")
def clean_light_curves(spark, sf_dir):
    raw = relation(spark, sf_dir, "points").drop("band").withColumn("catflags", (F.col("seq") % 3 == 0).cast("int")).withColumn("filtercode", F.col("seq") % 5).withColumn("magerr", F.when(F.col("seq") % 4 != 0, F.col("magerr")))
    curves = surveys.nested_light_curves(surveys.clean_points(raw)).select("source_id", F.explode("curves").alias("band", "points"))
    total = F.aggregate("points", F.lit(0.0), lambda s, p: s + p["magerr"])
    return shown(curves.select("source_id", "band", F.size("points").alias("n"), F.col("points")[0]["mag"].alias("first_mag"), total.alias("total_error")))


@query("light_curves_at_positions", f"""{duck("sources", "points", "companions")}, c AS (SELECT source_id AS region_id, ra AS r_ra, dec AS r_dec FROM companions),
m AS (SELECT c.region_id, source_id FROM c JOIN sources ON abs(dec - r_dec) <= 2 AND 2 * degrees(asin(least(1, sqrt(power(sin(radians(dec - r_dec) / 2), 2) + cos(radians(dec)) * cos(radians(r_dec)) * power(sin(radians(ra - r_ra) / 2), 2))))) * 60 <= 120)
SELECT m.region_id, source_id, points.band, count(*) AS n FROM m JOIN points USING (source_id) GROUP BY ALL""")
def light_curves_at_positions(spark, sf_dir):
    where = relation(spark, sf_dir, "companions").select(F.col("source_id").alias("region_id"), "ra", "dec", F.lit(120.0).alias("radius_arcmin"))
    near = surveys.points_near(relation(spark, sf_dir, "points"), relation(spark, sf_dir, "sources"), where)
    return near.groupBy("region_id", "source_id", "band").agg(F.count("*").alias("n"))


@query("archive_epochs", f"""{PTS}, o AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'HST' WHEN 1 THEN 'JWST' ELSE 'OTHER' END AS mission, seq % 4 AS calib_level FROM points), k AS (SELECT source_id, band, mjd, seq FROM o WHERE mission <> 'OTHER' AND calib_level >= 2 AND seq % 10 <> 0),
g AS (SELECT *, min(mjd) OVER w AS a, max(mjd) OVER w AS z, count(*) OVER w AS c FROM k WINDOW w AS (PARTITION BY source_id, band)), t AS (SELECT *, row_number() OVER (PARTITION BY source_id, band ORDER BY mjd, seq) - 1 AS rank, count(*) OVER (PARTITION BY source_id, band) AS n FROM g WHERE c >= 2 AND z - a >= 1 AND mjd <= a + 20)
SELECT source_id, band, seq, rank FROM t WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: floor(k * (n - 1) / 4)::BIGINT), rank)""")
def archive_epochs(spark, sf_dir):
    c = F.col
    seen = relation(spark, sf_dir, "points").withColumn("mission", F.when(c("seq") % 3 == 0, "HST").when(c("seq") % 3 == 1, "JWST").otherwise("OTHER")).withColumn("calib_level", c("seq") % 4).withColumn("product", F.when(c("seq") % 10 == 0, "spectrum").otherwise("image"))
    return shown(surveys.archive_epochs(seen, ["HST", "JWST"], ["source_id", "band"], most=5, least_days=1, most_days=20), "source_id", "band", "seq", "rank")


@query("cmd_colours", f"""{SRC} SELECT source_id, round(CASE WHEN source_id % 3 <> 0 THEN bp_rp WHEN source_id % 2 = 0 THEN bp_rp / 2 ELSE mag - 15 END, 6) AS colour FROM sources""")
def cmd_colours(spark, sf_dir):
    c, has = F.col, F.col("source_id") % 3 != 0
    colour = surveys.cmd_colour(F.when(has, c("bp_rp")), F.when(~has & (c("source_id") % 2 == 0), c("bp_rp") / 2), c("mag"), F.lit(15.0), c("mag"))
    return shown(relation(spark, sf_dir, "sources").select("source_id", colour.alias("colour")))


@query("photometric_colours", f"""{SRC} SELECT source_id, round(CASE WHEN source_id % 3 = 1 THEN bp_rp WHEN source_id % 3 = 2 THEN mag - 16 END, 6) AS colour FROM sources""")
def photometric_colours(spark, sf_dir):
    c, k = F.col, F.col("source_id") % 3
    bp = F.when(k == 1, c("mag") + c("bp_rp")).when(k == 2, float("nan"))
    colour = surveys.photometric_colour(bp, c("mag"), F.when(k == 2, c("mag")), F.lit(16.0), c("mag"))
    return shown(relation(spark, sf_dir, "sources").select("source_id", colour.alias("colour")))


@query("inverted_scores", f"""{VEC}, s AS (SELECT label, vec_id, vec[1]::DOUBLE AS s FROM vectors) SELECT label::BIGINT AS label, vec_id, round(coalesce((max(s) OVER (PARTITION BY label) - s) / nullif(max(s) OVER (PARTITION BY label) - min(s) OVER (PARTITION BY label), 0), 0), 6) AS anomaly_score FROM s""")
def inverted_scores(spark, sf_dir):
    own = relation(spark, sf_dir, "vectors").select("label", "vec_id", F.col("vec")[0].cast("double").alias("score"))
    return shown(surveys.inverted(own, ["label"]), "label", "vec_id", "anomaly_score")


@query("masked_top", f"""{ANOM} SELECT seq, round(score, 6) AS score FROM anomalies WHERE p_value < 0.1 ORDER BY anomalies.score DESC, seq LIMIT 25""")
def masked_top(spark, sf_dir):
    return shown(surveys.masked_top(relation(spark, sf_dir, "anomalies"), F.col("p_value") < 0.1, 25, "score"), "seq", "score")


@query("consensus_ranking", f"""{ANOM}, m AS (SELECT region_id, sum(score * (1 + seq % 3)) / sum(1 + seq % 3) AS c FROM anomalies GROUP BY 1) SELECT region_id, round(c, 6) AS consensus, row_number() OVER (ORDER BY round(c, 9) DESC NULLS LAST, region_id) AS place FROM m""")
def consensus_ranking(spark, sf_dir):
    ratings = relation(spark, sf_dir, "anomalies").select(F.col("region_id"), F.col("score").alias("rating"), (1 + F.col("seq") % 3).cast("double").alias("weight"))
    return shown(surveys.consensus_ranking(ratings, "region_id"))


@query("signal_to_noise", f"""{PIX} SELECT image_id, round(CASE WHEN stddev_pop(v) > 0 THEN max(v) / stddev_pop(v) ELSE 0 END, 6) AS snr FROM pixels GROUP BY 1""")
def signal_to_noise(spark, sf_dir):
    pixels = relation(spark, sf_dir, "pixels")
    return shown(surveys.signal_to_noise(pixels, pixels.groupBy("image_id").agg(F.stddev_pop("v").alias("rms"))))


@query("visible_sources", f"""{PIX}, g AS (SELECT image_id, x, y, avg(v) AS v FROM pixels GROUP BY 1, 2, 3), s AS (SELECT image_id, x AS cx, y AS cy FROM g),
t AS (SELECT s.image_id, cx, cy, median(v) AS med, stddev_pop(v) AS std, count(*) AS n, avg(v) FILTER (abs(x - cx) <= 1 AND abs(y - cy) <= 1) AS mid FROM s JOIN g ON s.image_id = g.image_id AND x >= cx - 4 AND x < cx + 4 AND y >= cy - 4 AND y < cy + 4 GROUP BY 1, 2, 3)
SELECT image_id, cx AS x, cy AS y, n >= 10 AND std >= 1e-10 AND abs(mid - med) / std >= 0.5 AS visible FROM t""")
def visible_sources(spark, sf_dir):
    image = relation(spark, sf_dir, "pixels").groupBy("image_id", "x", "y").agg(F.avg("v").alias("v"))
    places = image.select(F.concat_ws(":", "image_id", "x", "y").alias("place_id"), "image_id", F.col("x").alias("px"), F.col("y").alias("py"))
    return surveys.visible_sources(image, places, 32, 31, 0.5, 1, 4).select("image_id", F.col("px").alias("x"), F.col("py").alias("y"), "visible")


@query("variable_candidates", f"""{SRC} SELECT source_id, kind FROM (SELECT source_id, 'astrometric' AS kind FROM sources WHERE noise > 3 UNION ALL SELECT source_id, 'photometric' FROM sources WHERE bp_rp > 3)""")
def variable_candidates(spark, sf_dir):
    own = relation(spark, sf_dir, "sources")
    return surveys.variable_candidates(own.where("noise > 3").select("source_id"), own.where("bp_rp > 3").select("source_id"))


@query("fitness_components", f"""{ANOM}, r AS (SELECT region_id AS genome_id, score, row_number() OVER (PARTITION BY region_id ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY region_id) AS n, p_value FROM anomalies),
s AS (SELECT genome_id, avg(score) FILTER (k <= greatest(1, n // 5)) AS anomaly, CASE WHEN count(*) > 1 THEN least(1, avg(score) / greatest(stddev_pop(score), 0.01) / 5) END AS sig, avg(p_value) AS nov FROM r GROUP BY 1)
SELECT genome_id, round(anomaly, 6) AS anomaly, round(coalesce(sig, anomaly), 6) AS significance, round(0.35 * anomaly + 0.25 * coalesce(sig, anomaly) + 0.15 * nov + 0.1 * 0.5 + 0.15 * 0.25, 6) AS fitness FROM s""")
def fitness_components(spark, sf_dir):
    results = relation(spark, sf_dir, "anomalies").select(F.col("region_id").alias("genome_id"), "score", F.col("p_value").alias("novelty"), F.lit(0.5).alias("diversity"), F.lit(0.25).alias("recovery"))
    return shown(surveys.fitness_components(results), "genome_id", "anomaly", "significance", "fitness")


@query("outcome_deltas", f"""{ANOM}, b AS (SELECT region_id, count(*) AS n, max(score) AS s FROM anomalies WHERE seq % 2 = 0 AND region_id <> 3 GROUP BY 1), a AS (SELECT region_id, count(*) AS n, max(score) AS s FROM anomalies WHERE seq % 2 = 1 AND region_id <> 5 GROUP BY 1)
SELECT coalesce(a.region_id, b.region_id) AS region_id, coalesce(a.n, 0) - coalesce(b.n, 0) AS n_delta, round(coalesce(a.s, 0) - coalesce(b.s, 0), 6) AS best_delta FROM a FULL JOIN b ON a.region_id = b.region_id""")
def outcome_deltas(spark, sf_dir):
    own = relation(spark, sf_dir, "anomalies")
    sums = lambda rows: rows.groupBy("region_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return shown(surveys.outcome_deltas(sums(own.where("seq % 2 = 0 AND region_id <> 3")), sums(own.where("seq % 2 = 1 AND region_id <> 5")), "region_id", ["n", "best"]))


@query("forest_scores", f"""{VEC} SELECT vec_id, round(least(1, greatest(0, -vec[1]::DOUBLE / 2 + 0.5)), 6) AS score FROM vectors""")
def forest_scores(spark, sf_dir):
    return shown(relation(spark, sf_dir, "vectors").select("vec_id", surveys.forest_score(F.col("vec")[0].cast("double")).alias("score")))


@query("anomaly_places", f"""{SRC} SELECT source_id, round(CASE WHEN source_id % 2 = 0 THEN source_id ELSE 50 - (ra - 180) * cos(radians(10)) / 0.5 END, 6) AS px, round(CASE WHEN source_id % 2 = 0 THEN 7 ELSE 60 + (dec - 10) / 0.5 END, 6) AS py, 1800.0::DOUBLE AS scale FROM sources""")
def anomaly_places(spark, sf_dir):
    own = F.col("source_id") % 2 == 0
    x, y = surveys.place_of(F.when(own, F.col("source_id").cast("double")), F.when(own, F.lit(7.0)), F.col("ra"), F.col("dec"), (180.0, 10.0, 50.0, 60.0), 0.5)
    return shown(relation(spark, sf_dir, "sources").select("source_id", x.alias("px"), y.alias("py"), surveys.pixel_scale(F.lit(-0.5)).alias("scale")))


@query("anomaly_lines", f"""{ANOM} SELECT seq, printf('%s; pixel (%d, 4); score %.3f; a=%.2f, b=1.50', anomaly_type, (seq % 100)::INT, CAST(round(score, 2) AS DOUBLE), (seq % 8) / 4e0) AS line FROM anomalies""")
def anomaly_lines(spark, sf_dir):
    c, none = F.col, F.lit(None).cast("double")
    own = relation(spark, sf_dir, "anomalies").select("seq", "anomaly_type", F.round("score", 2).cast("double").alias("score"), none.alias("ra"), none.alias("dec"), (c("seq") % 100).cast("double").alias("px"), F.lit(4.0).alias("py"), F.create_map(F.lit("b"), F.lit(1.5), F.lit("a"), c("seq") % 8 / 4).alias("properties"))
    return surveys.told(own).select("seq", "line")
