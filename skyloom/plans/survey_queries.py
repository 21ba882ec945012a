"""Queries over colour-magnitude samples, anomalies, feedback and calls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyloom.operators import evaluation, evolution, learning, outliers, population, resampling
from skyloom.plans import detect, image_queries, report  # noqa: F401  image_queries registers SQL used here
from skyloom.plans.catalog_queries import MIXED, binned_sql
from skyloom.plans.registry import ORACLE_SQL, query, shown
from skyloom.plans.relations import duck, relation
from skyloom.sources.cache import CATALOG, Cache, keyed
from skyloom.sources.storage import shared_folder

CMD = duck("cmd")


@query("cmd_density", f"""{CMD}, e AS (SELECT region_id, min(colour) - 0.2 AS lc, max(colour) + 0.2 AS hc, min(mag) - 0.5 AS lm, max(mag) + 0.5 AS hm FROM cmd GROUP BY 1)
SELECT region_id, least(floor((colour - lc) / (hc - lc) * 50), 49)::BIGINT AS colour_bin, least(floor((mag - lm) / (hm - lm) * 50), 49)::BIGINT AS mag_bin, count(*) AS n FROM cmd JOIN e USING (region_id) GROUP BY ALL""")
def cmd_density(spark, sf_dir):
    return shown(population.density(relation(spark, sf_dir, "cmd")))


MS_CTE = f"""{CMD}, {binned_sql("cmd", "mag", 20, least=5, rows=1)},
f AS (SELECT region_id, nb, low, (high - low) / nb AS width, unnest(range(nb))::INTEGER AS bin FROM e),
g AS (SELECT region_id, bin, count(*) AS n, median(colour) AS med FROM b WHERE bin < nb GROUP BY 1, 2),
h AS (SELECT f.*, coalesce(g.n, 0) AS n, CASE WHEN g.n >= 3 THEN med END AS med FROM f LEFT JOIN g USING (region_id, bin)),
q AS (SELECT *, low + (bin + 0.5) * width AS centre, coalesce(last_value(med IGNORE NULLS) OVER (PARTITION BY region_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS locus FROM h),
o AS (SELECT region_id, arg_min(centre, bin) AS tm, arg_min(locus, bin) AS tc FROM (SELECT *, max(n) OVER (PARTITION BY region_id) AS peak FROM q) WHERE n >= 0.3 * peak GROUP BY 1),
k AS (SELECT c.*, q.nb, q.low, q.width, greatest(0, least(q.nb - 2, floor((mag - (q.low + 0.5 * q.width)) / q.width)))::INTEGER AS bin FROM cmd c JOIN q ON c.region_id = q.region_id AND q.bin = 0),
z AS (SELECT k.region_id, seq, mag, colour, tm, tc, colour - (a.locus + greatest(0, least(1, (mag - a.centre) / a.width)) * (d.locus - a.locus)) AS off
  FROM k JOIN q a ON a.region_id = k.region_id AND a.bin = k.bin JOIN q d ON d.region_id = k.region_id AND d.bin = k.bin + 1 JOIN o ON o.region_id = k.region_id)"""
GIANT = "mag < tm + 0.5 AND colour > tc + 0.3 AND NOT abs(off) < 0.3"
BLUE = "mag < tm AND colour < tc - 0.3"


@query("main_sequence", f"""{MS_CTE} SELECT region_id, count(*) AS n_stars, count_if(abs(off) < 0.3)::BIGINT AS n_ms, round(max(tm), 6) AS turnoff_mag, round(max(tc), 6) AS turnoff_colour,
count_if({GIANT})::BIGINT AS n_red_giants, round(min(mag) FILTER ({GIANT}), 6) AS rgb_tip_mag, round(avg(colour) FILTER ({GIANT}), 6) AS mean_rgb_colour, count_if({BLUE})::BIGINT AS n_blue_stragglers,
round(CASE WHEN count_if(abs(off) < 0.3) > 3 THEN stddev_pop(off) FILTER (abs(off) < 0.3) ELSE 0.3 END, 6) AS ms_width_measured, round(count_if({GIANT}) / count(*), 6) AS rgb_fraction, round(count_if({BLUE}) / count(*), 6) AS bs_fraction FROM z GROUP BY 1""")
def main_sequence(spark, sf_dir):
    return shown(population.evolved(population.main_sequence(relation(spark, sf_dir, "cmd"))))


@query("blue_stragglers", f"""{MS_CTE} SELECT region_id, seq, round(tc - colour, 6) AS colour_offset FROM z WHERE {BLUE} QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY seq) <= 20""")
def blue_stragglers(spark, sf_dir):
    return shown(population.blue_stragglers(population.main_sequence(relation(spark, sf_dir, "cmd"))), "region_id", "seq", "colour_offset")


POP_CTE = f"""{binned_sql("cmd", "mag", 30, rows=1).replace("e AS", "e3 AS").replace("JOIN e ", "JOIN e3 ").replace("b AS (SELECT t", "b3 AS (SELECT t")},
g3 AS (SELECT region_id, bin, lead(colour) OVER w - colour AS gap, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY region_id, bin) AS n FROM b3 WHERE bin < nb WINDOW w AS (PARTITION BY region_id, bin ORDER BY colour)),
t3 AS (SELECT region_id, bin, max(gap) FILTER (i >= n // 4 AND i < 3 * n // 4) AS widest, median(gap) AS typical FROM g3 WHERE n >= 10 GROUP BY 1, 2),
p3 AS (SELECT region_id, count(*) AS tested, count_if(typical > 0 AND widest > 3 * typical)::BIGINT AS split FROM t3 GROUP BY 1)"""


@query("multiple_populations", f"""{CMD}, {POP_CTE} SELECT region_id, coalesce(tested, 0) AS total_tested, coalesce(split, 0) AS bimodal_bins, round(coalesce(split, 0) / greatest(coalesce(tested, 0), 1), 6) AS bimodality_fraction,
coalesce(split, 0) / greatest(coalesce(tested, 0), 1) > 0.3 AS is_multiple_population FROM (SELECT DISTINCT region_id FROM cmd) LEFT JOIN p3 USING (region_id)""")
def multiple_populations(spark, sf_dir):
    return shown(population.multiple_populations(relation(spark, sf_dir, "cmd")))


COL_CTE = """m9 AS (SELECT region_id, median(colour) AS med, stddev_pop(colour) AS std FROM cmd GROUP BY 1),
c9 AS (SELECT region_id, any_value(med) AS med, any_value(std) AS std, avg(((colour - med) / std) ** 3) AS m3, avg(((colour - med) / std) ** 4) AS m4, count_if(abs(colour - med) > 3 * std)::BIGINT AS n_out, count(*) AS n FROM cmd JOIN m9 USING (region_id) GROUP BY 1)"""


@query("colour_distribution", f"""{CMD}, {COL_CTE} SELECT region_id, round(med, 6) AS median_colour, round(std, 6) AS colour_spread, round(m3, 6) AS skewness, round(m4 - 3, 6) AS kurtosis, n_out AS n_outliers, round(n_out / n, 6) AS outlier_fraction FROM c9""")
def colour_distribution(spark, sf_dir):
    return shown(population.colour_distribution(relation(spark, sf_dir, "cmd")))


@query("population_scores", f"""{MS_CTE}, {POP_CTE}, {COL_CTE}, v AS (SELECT region_id, count_if({BLUE}) AS nb, count_if({GIANT}) / count(*) AS rf, CASE WHEN count_if(abs(off) < 0.3) > 3 THEN stddev_pop(off) FILTER (abs(off) < 0.3) ELSE 0.3 END AS wd FROM z GROUP BY 1)
SELECT region_id, round(least(1, least(nb / 5, 0.25) + CASE WHEN coalesce(split, 0) / greatest(coalesce(tested, 0), 1) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN rf > 0.1 THEN 0.15 ELSE 0 END + CASE WHEN wd < 0.15 THEN 0.15 ELSE 0 END
  + CASE WHEN std > 1 THEN 0.1 ELSE 0 END + least(n_out / 10, 0.15)), 6)::DOUBLE AS population_score FROM v JOIN c9 USING (region_id) LEFT JOIN p3 USING (region_id)""")
def population_scores(spark, sf_dir):
    return shown(population.population_scores(relation(spark, sf_dir, "cmd")), "region_id", "population_score")


ANOM = duck("anomalies")
RANKED = "q AS (SELECT *, p_value * count(*) OVER (PARTITION BY region_id) / row_number() OVER (PARTITION BY region_id ORDER BY p_value, seq) AS q FROM anomalies)"


@query("fdr_by_row", f"""{ANOM}, {RANKED} SELECT region_id, seq, round(least(1, min(q) OVER (PARTITION BY region_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_corrected FROM q""")
def fdr_by_row(spark, sf_dir):
    return shown(evaluation.fdr(relation(spark, sf_dir, "anomalies"), ["region_id"]), "region_id", "seq", "p_corrected", digits=9)


@query("fdr_textbook", f"""{ANOM}, {RANKED} SELECT region_id, seq, round(least(1, min(q) OVER (PARTITION BY region_id ORDER BY p_value, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS p_corrected FROM q""")
def fdr_textbook(spark, sf_dir):
    return shown(evaluation.fdr(relation(spark, sf_dir, "anomalies"), ["region_id"], mode="by_rank"), "region_id", "seq", "p_corrected", digits=9)


@query("bonferroni", f"""{ANOM} SELECT seq, round(least(1, p_value * 100), 9) AS p_corrected FROM anomalies""")
def bonferroni(spark, sf_dir):
    return shown(relation(spark, sf_dir, "anomalies").select("seq", evaluation.bonferroni(F.col("p_value"), 100).alias("p_corrected")), digits=9)


@query("fisher_groups", f"""{ANOM}, s AS (SELECT region_id, detector, sum(-2 * ln(greatest(p_value, 1e-300))) AS x, count(*) AS k FROM anomalies GROUP BY 1, 2),
t AS (SELECT s.*, unnest(range(k)) AS i FROM s)
SELECT region_id, detector, k, round(any_value(x), 6) AS statistic, round(sum(exp(-x / 2 + i * ln(x / 2) - lgamma(i + 1))), 6) AS p_combined FROM t GROUP BY region_id, detector, k""")
def fisher_groups(spark, sf_dir):
    return shown(evaluation.fisher(relation(spark, sf_dir, "anomalies"), ["region_id", "detector"]), "region_id", "detector", "k", "statistic", "p_combined")


@query("quality_floor", f"""{ANOM} SELECT seq, detector FROM anomalies WHERE p_value <= CASE detector WHEN 'lens' THEN 0.0013 WHEN 'kinematic' THEN 0.01 WHEN 'wavelet' THEN 0.05 WHEN 'transient' THEN 0.0013 WHEN 'variability' THEN 0.01 END""")
def quality_floor(spark, sf_dir):
    found = relation(spark, sf_dir, "anomalies")
    return found.where(evaluation.passes_floor(F.col("detector"), F.col("p_value"))).select("seq", "detector")


@query("ranked_anomalies", f"""{ANOM}, k AS (SELECT *, score / max(score) OVER (PARTITION BY region_id, detector) AS norm FROM anomalies WHERE p_value <= CASE detector WHEN 'lens' THEN 0.0013 WHEN 'kinematic' THEN 0.01 WHEN 'wavelet' THEN 0.05 WHEN 'transient' THEN 0.0013 WHEN 'variability' THEN 0.01 END),
t AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY region_id, detector ORDER BY score DESC, seq) <= 8)
SELECT region_id, seq, round(norm, 6) AS normalised, row_number() OVER (PARTITION BY region_id ORDER BY norm DESC, seq) AS rank FROM t QUALIFY rank <= 8""")
def ranked_anomalies(spark, sf_dir):
    return shown(evaluation.ranked_anomalies(relation(spark, sf_dir, "anomalies"), 8), "region_id", "seq", "normalised", "rank")


SCORES = f"{ANOM}, w AS (SELECT region_id, {', '.join(f'coalesce(max(score) FILTER (detector = {d!r}), 0) AS {d}' for d in ('lens', 'kinematic', 'wavelet', 'transient', 'variability'))} FROM anomalies GROUP BY 1)"
ENSEMBLE = "least(1, 0.09 * lens + 0.09 * kinematic + 0.09 * wavelet + 0.04 * transient + 0.09 * variability)"
AGREE = "((lens > 0.3)::INT + (kinematic > 0.3)::INT + (wavelet > 0.3)::INT + (transient > 0.3)::INT + (variability > 0.3)::INT)"


def matrix(spark, sf_dir):
    return evaluation.score_matrix(relation(spark, sf_dir, "anomalies"))


@query("ensemble_score", f"""{SCORES} SELECT region_id, round({ENSEMBLE}, 6) AS ensemble_score, {AGREE}::BIGINT AS n_agreeing FROM w""")
def ensemble_score(spark, sf_dir):
    return shown(evaluation.ensemble(matrix(spark, sf_dir)), "region_id", "ensemble_score", "n_agreeing")


@query("region_classes", f"""{SCORES}, u AS (SELECT region_id, unnest([(lens, -1, 'lens', 'gravitational_lens'), (kinematic, -5, 'kinematic', 'kinematic_group'), (transient, -6, 'transient', 'transient_candidate'), (wavelet, -8, 'wavelet', 'multiscale_source'), (variability, -12, 'variability', 'variable_star')]) AS s FROM w),
r AS (SELECT region_id, s[1] AS score, s[3] AS dominant, s[4] AS classification, row_number() OVER (PARTITION BY region_id ORDER BY s DESC) AS k FROM u WHERE s[1] > 0)
SELECT a.region_id, a.dominant, a.classification, round(a.score, 6) AS confidence, coalesce(a.score - b.score < 0.15, false) AS ambiguous, a.region_id % 2 = 0 AND a.score > 0.6 AS novel, CASE WHEN a.score > 0.7 THEN 'strong' WHEN a.score > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
FROM r a LEFT JOIN r b ON a.region_id = b.region_id AND b.k = 2 WHERE a.k = 1""")
def region_classes(spark, sf_dir):
    return shown(evaluation.region_classes(matrix(spark, sf_dir), F.col("region_id") % 2), "region_id", "dominant", "classification", "confidence", "ambiguous", "novel", "strength")


@query("verdicts", f"""{SCORES}, e AS (SELECT region_id, {ENSEMBLE} AS es, {AGREE} AS n, 12 * wavelet AS snr FROM w), p AS (SELECT *, least(1, 13 * (1 - list_sum(list_transform(range(greatest(1, floor(greatest(1, es * 10)))::BIGINT), lambda i: exp(-1) / gamma(i + 1))))) AS pl FROM e),
v AS (SELECT *, CASE WHEN snr > 5 AND n >= 3 THEN 'real' WHEN snr < 2 OR n <= 1 THEN 'artifact' ELSE 'inconclusive' END AS verdict FROM p)
SELECT region_id, verdict, round(CASE verdict WHEN 'real' THEN least(0.95, snr / 10) WHEN 'artifact' THEN 0.8 ELSE 0.5 END, 6) AS verdict_confidence, round(pl, 6) AS p_look_elsewhere,
greatest(1, least(10, (snr > 2)::INT + (snr > 3)::INT + (snr > 5)::INT + (snr > 10)::INT + (n >= 2)::INT + (n >= 3)::INT + (n >= 5)::INT + (pl < 0.05)::INT + (pl < 0.01)::INT + (pl < 0.001)::INT))::BIGINT AS significance_rating, verdict = 'inconclusive' AND es > 0.2 AS needs_review FROM v""")
def verdicts(spark, sf_dir):
    return shown(evaluation.verdicts(evaluation.ensemble(matrix(spark, sf_dir)), 12 * F.col("wavelet"), 0.2), "region_id", "verdict", "verdict_confidence", "p_look_elsewhere", "significance_rating", "needs_review")


@query("poisson_significance", f"""{ANOM}, s AS (SELECT region_id, count_if(score > 0.7) AS seen, count(*) / 12e0 AS expected FROM anomalies GROUP BY 1)
SELECT region_id, seen::BIGINT AS seen, round(greatest(0, 1 - coalesce(list_sum(list_transform(range(seen::BIGINT), lambda i: exp(-expected + i * ln(expected) - lgamma(i + 1)))), 0)), 6) AS p FROM s""")
def poisson_significance(spark, sf_dir):
    counted = relation(spark, sf_dir, "anomalies").groupBy("region_id").agg(F.count_if(F.col("score") > 0.7).alias("seen"), (F.count("*") / 12).alias("expected"))
    from skyloom.functions.pvalues import poisson_sf

    return shown(counted.withColumn("p", poisson_sf(F.col("seen").cast("double"), F.col("expected"))), "region_id", "seen", "p")


@query("binomial_rates", f"""{ANOM}, s AS (SELECT region_id, count_if(score > 0.7) AS seen, count(*) AS n FROM anomalies GROUP BY 1)
SELECT region_id, round(greatest(0, 1 - coalesce(list_sum(list_transform(range(seen::BIGINT), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))), 0)), 6) AS p FROM s""")
def binomial_rates(spark, sf_dir):
    from skyloom.functions.pvalues import binomial_sf

    counted = relation(spark, sf_dir, "anomalies").groupBy("region_id").agg(F.count_if(F.col("score") > 0.7).alias("seen"), F.count("*").alias("n"))
    return shown(counted.withColumn("p", binomial_sf(F.col("seen"), F.col("n"), 0.05)), "region_id", "p")


@query("gaussian_p_values")
def gaussian_p_values(spark, sf_dir):
    from skyloom.functions import pvalues as p

    z = F.col("score") * 6
    return shown(relation(spark, sf_dir, "anomalies").select("seq", p.normal_sf(z).alias("one_sided"), p.normal_sf_two_sided(z).alias("two_sided"), p.chi2_sf(z * 3, F.lit(5.0)).alias("chi2"), p.normal_isf("p_value").alias("sigma")), digits=9)


@query("finding_scores", f"""{ANOM} SELECT seq, round(0.4 * score + 0.3 * (1 - p_value) + 0.2 * (score * score) + 0.1 * CASE WHEN seq % 3 > 0 THEN 0.5 ELSE 1 END, 6) AS finding_score FROM anomalies""")
def finding_scores(spark, sf_dir):
    found = relation(spark, sf_dir, "anomalies")
    return shown(found.select("seq", evaluation.finding_score(F.col("score"), 1 - F.col("p_value"), F.col("score") * F.col("score"), F.col("seq") % 3).alias("finding_score")))


@query("combined_scores", f"""{ANOM} SELECT region_id, round(least(1, sum((1 + seq % 4) * score) / sum(1 + seq % 4)), 6) AS combined FROM anomalies GROUP BY 1""")
def combined_scores(spark, sf_dir):
    return shown(evaluation.combined_score(relation(spark, sf_dir, "anomalies").withColumn("weight", 1 + F.col("seq") % 4), ["region_id"]))


def findings(spark, sf_dir):
    c = F.col
    found = relation(spark, sf_dir, "anomalies").withColumn("verdict", F.when(c("score") > 0.6, "real").when(c("score") < 0.2, "artifact").otherwise("inconclusive"))
    return found.withColumn("category", evaluation.category(c("seq") % 4 == 0, c("score")))


@query("findings_by_type", f"""{ANOM} SELECT anomaly_type, count(*) AS n, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score, count_if(score > 0.6)::BIGINT AS n_real, count_if(score < 0.2)::BIGINT AS n_artifact FROM anomalies GROUP BY 1""")
def findings_by_type(spark, sf_dir):
    return shown(evaluation.by_type(findings(spark, sf_dir)))


@query("findings_by_detector", f"""{ANOM} SELECT detector, count_if(score > 0.1)::BIGINT AS n_active, round(avg(score) FILTER (score > 0.1), 6) AS mean_score, round(max(score), 6) AS max_score FROM anomalies GROUP BY 1""")
def findings_by_detector(spark, sf_dir):
    return shown(evaluation.by_detector(findings(spark, sf_dir)))


@query("finding_numbers", f"""{ANOM}, k AS (SELECT seq, score, CASE WHEN score < 0.5 THEN 'LOW' WHEN seq % 4 = 0 THEN 'KNOWN' ELSE 'NEW' END AS category FROM anomalies)
SELECT seq, category, row_number() OVER (ORDER BY CASE category WHEN 'NEW' THEN 0 WHEN 'KNOWN' THEN 1 ELSE 2 END, score DESC, seq) AS number FROM k""")
def finding_numbers(spark, sf_dir):
    return shown(evaluation.numbered(findings(spark, sf_dir)), "seq", "category", "number")


@query("score_histogram", f"""{ANOM} SELECT least(floor(score * 30), 29)::BIGINT AS bin, count(*) AS n FROM anomalies WHERE score BETWEEN 0 AND 1 GROUP BY 1""")
def score_histogram(spark, sf_dir):
    return shown(evaluation.histogram(findings(spark, sf_dir)))


@query("recent_findings", f"""{ANOM}, l AS (SELECT * FROM anomalies ORDER BY seq DESC LIMIT 25) SELECT anomaly_type, count(*) AS n, count_if(score > 0.5)::BIGINT AS n_high FROM l GROUP BY 1""")
def recent_findings(spark, sf_dir):
    return shown(evaluation.recent_summary(findings(spark, sf_dir)))


@query("never_found_types", f"""{ANOM} SELECT t AS anomaly_type FROM (VALUES ('type_F'), ('type_X'), ('type_O'), ('type_Y')) v(t) WHERE t NOT IN (SELECT anomaly_type FROM anomalies)""")
def never_found_types(spark, sf_dir):
    return evaluation.never_found(findings(spark, sf_dir), ["type_F", "type_X", "type_O", "type_Y"])


@query("top_findings", f"""{ANOM} SELECT seq, region_id, round(score, 6) AS score FROM anomalies ORDER BY anomalies.score DESC, seq LIMIT 10""")
def top_findings(spark, sf_dir):
    return shown(findings(spark, sf_dir).orderBy(F.col("score").desc(), "seq").limit(10), "seq", "region_id", "score")


@query("ks_uniformity", f"""{ANOM}, u AS (SELECT region_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS u, count(*) OVER w AS n FROM anomalies WINDOW w AS (PARTITION BY region_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY u) AS i FROM u WHERE n >= 5) SELECT region_id, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) AS d, max(n) AS n FROM r GROUP BY 1""")
def ks_uniformity(spark, sf_dir):
    return shown(evaluation.ks_uniform(relation(spark, sf_dir, "anomalies"), ["region_id"], "score"))


@query("kinematic_scores", f"""{ANOM}, c AS (SELECT region_id, count(*) AS n_pm, count_if(seq % 50 = 0) AS g, count_if(seq % 90 = 0) AS s, count_if(seq % 40 = 0) AS r FROM anomalies GROUP BY 1)
SELECT region_id, round(CASE WHEN n_pm < 5 THEN 0 ELSE least(1, 0.4 * least(g, 3) / 3 + 0.35 * least(s, 2) / 2 + 0.25 * least(r, 5) / 5) END, 6)::DOUBLE AS kinematic_score FROM c""")
def kinematic_scores(spark, sf_dir):
    n = lambda k: F.count_if(F.col("seq") % k == 0)
    counts = relation(spark, sf_dir, "anomalies").groupBy("region_id").agg(F.count("*").alias("n_pm"), n(50).alias("n_groups"), n(90).alias("n_streams"), n(40).alias("n_runaways"))
    return shown(outliers.kinematic_scores(counts), "region_id", "kinematic_score")


def feedback(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("is_interesting"))
    return relation(spark, sf_dir, "feedback").join(labels, "seq")


FEED = f"""{duck("feedback")}, f AS (SELECT feedback.*, quality = 1 AS good FROM feedback JOIN labels ON seq = doc_id)"""


@query("refined_threshold", f"""{FEED} SELECT round(coalesce((avg(score) FILTER (good) + avg(score) FILTER (NOT good)) / 2, 0.5), 6) AS threshold FROM f""")
def refined_threshold(spark, sf_dir):
    return shown(learning.refined_threshold(feedback(spark, sf_dir)))


@query("query_band", f"""{FEED} SELECT seq, round(score, 6) AS score FROM f WHERE score > 0.3 + 0.105 AND score < 0.7 - 0.105""")
def query_band(spark, sf_dir):
    return shown(learning.query_band(feedback(spark, sf_dir), 20 + 1), "seq", "score")


WEIGHTS = """r AS (SELECT DISTINCT seq, good::INT AS y FROM f), d AS (SELECT DISTINCT detector FROM f), m AS (SELECT d.detector, r.seq, r.y, coalesce(f.score, 0) AS s FROM r CROSS JOIN d LEFT JOIN f ON f.seq = r.seq AND f.detector = d.detector),
p AS (SELECT detector, greatest(0.01, 0.5 + 0.5 * (avg(s * y) - avg(s) * avg(y)) / (greatest(stddev_pop(s), 1e-6) * greatest(stddev_pop(y), 1e-6))) AS raw FROM m GROUP BY 1 HAVING count(*) >= 10), lw AS (SELECT detector, raw / sum(raw) OVER () AS weight FROM p)"""


@query("learned_weights", f"""{FEED}, {WEIGHTS} SELECT detector, round(weight, 6) AS weight FROM lw""")
def learned_weights(spark, sf_dir):
    return shown(learning.learned_weights(feedback(spark, sf_dir)))


@query("blended_weights", f"""{FEED}, {WEIGHTS}, o AS (SELECT detector, 1e0 / count(*) OVER () AS w FROM (SELECT DISTINCT detector FROM f WHERE detector <> 'src3') UNION ALL SELECT 'other', 0.25e0),
b AS (SELECT detector, 0.7 * coalesce(lw.weight, 0) + 0.3 * coalesce(o.w, 0) AS raw FROM lw FULL JOIN o USING (detector)) SELECT detector, round(raw / sum(raw) OVER (), 6) AS weight FROM b""")
def blended_weights(spark, sf_dir):
    own = feedback(spark, sf_dir)
    known = own.where("detector <> 'src3'").select("detector").distinct()
    old = known.crossJoin(known.agg((F.lit(1.0) / F.count("*")).alias("weight"))).unionByName(spark.createDataFrame([("other", 0.25)], "detector string, weight double"))
    return shown(learning.blend_weights(old, learning.learned_weights(own)))


@query("detector_accuracy", f"""{FEED} SELECT detector, count(*) AS n, round(avg(good::INT), 6) AS accuracy FROM f WHERE score > 0.3 GROUP BY 1 HAVING count(*) >= 5""")
def detector_accuracy(spark, sf_dir):
    return shown(learning.detector_accuracy(feedback(spark, sf_dir)))


@query("false_positive_types", f"""{FEED} SELECT type, count(*) AS n, min(seq) AS first_seen FROM f WHERE NOT good GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 5""")
def false_positive_types(spark, sf_dir):
    return shown(learning.false_positives(feedback(spark, sf_dir)))


@query("feedback_stats", f"""{FEED} SELECT count(*) AS n, count_if(good)::BIGINT AS n_interesting, round(avg(score), 6) AS mean_score, count(DISTINCT type) AS n_types FROM f""")
def feedback_stats(spark, sf_dir):
    return shown(learning.feedback_stats(feedback(spark, sf_dir)))


CUTS = " + ".join(f"(u > {c!r})::INT" for c in resampling.poisson_cuts())
#: Every row in every round with its unit number, by the operator's integers.
ROUNDS = f"""{FEED}, r0 AS (SELECT type, score, seq, good, r, ((seq % 2147483648 + r * 7919) & 2147483647) AS x FROM f, range(1, 101) t(r)), r1 AS (SELECT * REPLACE ((x * 1103515245 + 12345) & 2147483647 AS x) FROM r0), r2 AS (SELECT * REPLACE (xor(x, x >> 15) AS x) FROM r1),
r3 AS (SELECT * REPLACE ((x * 1664525 + 1013904223) & 2147483647 AS x) FROM r2), r4 AS (SELECT * REPLACE (xor(x, x >> 13) AS x) FROM r3), r5 AS (SELECT * REPLACE ((x * 69069 + 1) & 2147483647 AS x) FROM r4), ru AS (SELECT *, xor(x, x >> 16) / 2147483648e0 AS u FROM r5), rw AS (SELECT *, {CUTS} AS w FROM ru)"""


def interval_sql(value: str, views: str, plain: str) -> str:
    """From views ev (type, m of each round) and the estimate, the operator's columns."""
    return f"""{ROUNDS}, {views}, es AS ({plain}) SELECT type, round(any_value(es.m), 6) AS estimate, round(quantile_cont(ev.m, 0.025), 6) AS low, round(quantile_cont(ev.m, 0.975), 6) AS high, round(stddev_pop(ev.m), 6) AS spread FROM ev JOIN es USING (type) GROUP BY 1"""


@query("bootstrap_intervals", interval_sql("mean", "ev AS (SELECT type, r, sum(w * score) / nullif(sum(w), 0) AS m FROM rw GROUP BY 1, 2)", "SELECT type, avg(score) AS m FROM f GROUP BY 1"))
def bootstrap_intervals(spark, sf_dir):
    return shown(resampling.bootstrap(feedback(spark, sf_dir), ["type"], resampling.mean(F.col("score")), 100))


@query("bootstrap_ratios", interval_sql("ratio", "ev AS (SELECT type, r, sum(w * CASE WHEN good THEN score ELSE 0 END) / nullif(sum(w * score), 0) AS m FROM rw GROUP BY 1, 2)", "SELECT type, sum(CASE WHEN good THEN score ELSE 0 END) / sum(score) AS m FROM f GROUP BY 1"))
def bootstrap_ratios(spark, sf_dir):
    """How much of all score interesting findings hold."""
    good = F.when(F.col("is_interesting"), F.col("score")).otherwise(0.0)
    return shown(resampling.bootstrap(feedback(spark, sf_dir), ["type"], resampling.ratio(good, F.col("score")), 100))


BINS = "greatest(0, least(31, floor(score * 32)))"
MIDDLE = "SELECT type, r, (min(k) FILTER (c >= h) + 0.5) / 32 AS m FROM (SELECT type, r, k, sum(n) OVER (PARTITION BY type, r ORDER BY k) AS c, sum(n) OVER (PARTITION BY type, r) / 2 AS h FROM ({0})) GROUP BY 1, 2"


@query("bootstrap_medians", interval_sql("median", f"ev AS ({MIDDLE.format(f'SELECT type, r, {BINS} AS k, sum(w) AS n FROM rw GROUP BY 1, 2, 3')})", f"SELECT type, m FROM ({MIDDLE.format(f'SELECT type, 0 AS r, {BINS} AS k, count(*) AS n FROM f GROUP BY 1, 2, 3')})"))
def bootstrap_medians(spark, sf_dir):
    """Of scores, to a bin of 1/32."""
    return shown(resampling.bootstrap(feedback(spark, sf_dir), ["type"], resampling.median(F.col("score"), 0.0, 1.0, 32), 100))


@query("permutation_tests", f"""{ROUNDS}, sh AS (SELECT type, avg(good::INT::DOUBLE) AS p, abs(avg(score) FILTER (good) - avg(score) FILTER (NOT good)) AS observed FROM f GROUP BY 1 HAVING avg(good::INT::DOUBLE) > 0 AND avg(good::INT::DOUBLE) < 1),
dr AS (SELECT type, r, abs(avg(score) FILTER (u < p) - avg(score) FILTER (u >= p)) AS d FROM ru JOIN sh USING (type) GROUP BY 1, 2)
SELECT type, round(any_value(observed), 6) AS observed, round((count(*) FILTER (coalesce(d >= observed, true)) + 1) / 101, 6) AS p_value FROM dr JOIN sh USING (type) GROUP BY 1""")
def permutation_tests(spark, sf_dir):
    return shown(resampling.randomisation_test(feedback(spark, sf_dir), ["type"], resampling.mean(F.col("score")), "is_interesting", 100))


CALLS = duck("calls")


@query("token_usage", f"""{CALLS}, t AS (SELECT *, greatest(1, length(text) // 4) AS k FROM calls)
SELECT purpose, provider, CASE WHEN grouping(purpose, provider) = 3 THEN count_if(NOT cached)::BIGINT ELSE count(*) END AS n_calls, CASE WHEN grouping(purpose, provider) = 3 THEN sum(k) FILTER (NOT cached) ELSE sum(k) END::BIGINT AS tokens FROM t GROUP BY GROUPING SETS ((purpose), (provider), ())""")
def token_usage(spark, sf_dir):
    return shown(learning.token_usage(relation(spark, sf_dir, "calls")))


@query("consensus_votes", f"""{CALLS}, v AS (SELECT conv_id, turn, length(text) % 10 + 1 AS rating, purpose FROM calls), c AS (SELECT conv_id, purpose, count(*) AS n, min(turn) AS f FROM v GROUP BY 1, 2)
SELECT v.conv_id, count(*) AS n_votes, round(avg(rating), 6) AS mean_rating, round(stddev_pop(rating), 6) AS spread, round(greatest(0, 1 - stddev_pop(rating) / 5), 6) AS agreement, any_value(k.purpose) AS category
FROM v JOIN (SELECT conv_id, arg_max(purpose, (n, -f)) AS purpose FROM c GROUP BY 1) k ON k.conv_id = v.conv_id GROUP BY 1""")
def consensus_votes(spark, sf_dir):
    votes = relation(spark, sf_dir, "calls").select("conv_id", F.col("turn").alias("seq"), (F.length("text") % 10 + 1).alias("rating"), F.col("purpose").alias("category"))
    return shown(learning.consensus(votes, "conv_id"), "conv_id", "n_votes", "mean_rating", "spread", "agreement", "category")


@query("prompt_cache_keys", f"""{CALLS} SELECT conv_id, turn, sha256(concat(purpose, chr(10), '---', chr(10), text)) AS key FROM calls""")
def prompt_cache_keys(spark, sf_dir):
    return relation(spark, sf_dir, "calls").select("conv_id", "turn", learning.prompt_key(F.col("purpose"), F.col("text")).alias("key"))


@query("sanitised_text", f"""{CALLS} SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x1F\\x7F]', ' ', 'g'), ' +', ' ', 'g'), ' '), 1, 200) AS clean FROM calls""")
def sanitised_text(spark, sf_dir):
    return relation(spark, sf_dir, "calls").select("conv_id", "turn", learning.sanitised(F.col("text")).alias("clean"))


@query("json_in_text", """SELECT event_id, nullif(regexp_extract(concat('see ', props, ' end'), '(?s)(\\{.*\\})', 1), '') AS found FROM events""")
def json_in_text(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", learning.json_in_text(F.concat(F.lit("see "), "props", F.lit(" end"))).alias("found"))


VEC = duck("vectors")


@query("novelty_euclidean", f"""{VEC}, d AS (SELECT a.vec_id, min(sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)))) AS m FROM vectors a JOIN vectors b ON b.vec_id % 25 = 0 AND a.vec_id <> b.vec_id GROUP BY 1)
SELECT vec_id, round(m, 6) AS distance, round(1 / (1 + exp(-(m - 3))), 6) AS novelty FROM d""")
def novelty_euclidean(spark, sf_dir):
    items = relation(spark, sf_dir, "vectors")
    return shown(learning.novelty(items, items.where("vec_id % 25 = 0")))


@query("diversity", f"""{VEC}, d AS (SELECT a.label, sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS d FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label::BIGINT AS label, round(avg(d) / max(d), 6) AS diversity FROM d GROUP BY 1""")
def diversity(spark, sf_dir):
    return shown(learning.diversity(relation(spark, sf_dir, "vectors"), ["label"]))


@query("genome_distance", f"""{VEC} SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.vec[1:8], b.vec[1:8]), lambda p: ((p[1]::DOUBLE - p[2]::DOUBLE) / 2) ** 2))), 6) AS d FROM vectors a JOIN vectors b ON b.vec_id = 0""")
def genome_distance(spark, sf_dir):
    genes = relation(spark, sf_dir, "vectors").select("vec_id", F.slice("vec", 1, 8).cast("array<double>").alias("g"))
    one = genes.where("vec_id = 0").select(F.col("g").alias("o"))
    return shown(genes.crossJoin(F.broadcast(one.limit(1))).select("vec_id", learning.genome_distance(F.col("g"), F.col("o"), [2.0] * 8).alias("d")))


@query("follow_ups", f"""{SCORES}, d AS (SELECT region_id, CASE WHEN lens >= greatest(kinematic, transient) THEN 'lens' WHEN kinematic >= transient THEN 'kinematic' ELSE 'transient' END AS dominant FROM w)
SELECT region_id, dominant, CASE dominant
WHEN 'lens' THEN 'High-resolution imaging to resolve arc morphology|Spectroscopy to confirm source/lens redshifts|Multi-band photometry for photometric redshift'
WHEN 'kinematic' THEN 'Radial velocity measurements to confirm 3D co-motion|Chemical abundance analysis for common origin|Age dating via isochrone fitting'
ELSE 'Time-series photometry to characterize light curve|Spectroscopic classification of transient type|Multi-wavelength follow-up (radio, X-ray)' END AS steps FROM d""")
def follow_ups(spark, sf_dir):
    own = matrix(spark, sf_dir)
    top = evaluation.dominant({d: F.col(d) for d in ("lens", "kinematic", "transient")})
    classes = F.create_map(*[F.lit(x) for kv in evaluation.CLASSES.items() for x in kv])
    return own.withColumn("dominant", top).select("region_id", "dominant", F.array_join(evaluation.follow_ups(classes[F.col("dominant")]), "|").alias("steps"))


@query("rationales", f"""{SCORES}, d AS (SELECT region_id, greatest(lens, kinematic, wavelet, transient, variability) AS top, * FROM w),
c AS (SELECT region_id, top, CASE WHEN top > 0.7 THEN 'strong' WHEN top > 0.4 THEN 'moderate' ELSE 'weak' END AS st, CASE top WHEN lens THEN 1 WHEN kinematic THEN 2 WHEN transient THEN 3 WHEN wavelet THEN 4 ELSE 5 END AS k FROM d WHERE top > 0)
SELECT region_id, CASE k WHEN 1 THEN printf('Detection dominated by gravitational lens signatures. Lens score %.2f indicates %s arc/ring features.', top, st)
WHEN 2 THEN printf('Detection dominated by kinematic grouping. Kinematic score %.2f suggests %s co-moving structure.', top, st)
WHEN 3 THEN printf('Detection dominated by transient/variability signal. Transient score %.2f indicates %s astrometric noise.', top, st)
WHEN 4 THEN printf('Detection dominated by multi-scale wavelet features. Wavelet score %.2f suggests %s scale-dependent structure.', top, st)
ELSE printf('Detection dominated by time-domain variability signal. Variability score %.2f indicates %s photometric variability.', top, st) END AS rationale FROM c""")
def rationales(spark, sf_dir):
    return evaluation.region_classes(matrix(spark, sf_dir), F.lit(0)).where("dominant is not null").select("region_id", "rationale")


@query("sub_detection_counts", f"""{ANOM}, g AS (SELECT region_id, count_if(detector = 'lens') AS l, count_if(detector = 'wavelet' AND score > 0.8) AS w FROM anomalies GROUP BY 1)
SELECT region_id, (l + w)::BIGINT AS total, ((l > 0)::INT + (w > 0)::INT)::BIGINT AS n_kinds FROM g""")
def sub_detection_counts(spark, sf_dir):
    c = F.col
    nested = relation(spark, sf_dir, "anomalies").groupBy("region_id", "mjd").agg(F.collect_list(F.when(c("detector") == "lens", c("seq"))).alias("arcs"), F.collect_list(F.when((c("detector") == "wavelet") & (c("score") > 0.8), c("seq"))).alias("objects"))
    found = evaluation.sub_detections(nested, ["arcs", "objects"]).select("region_id", "total", F.explode_outer("counts").alias("kind", "n"))
    kinds = found.groupBy("region_id", "kind").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return shown(kinds.groupBy("region_id").agg(F.sum("n").alias("total"), F.count("kind").alias("n_kinds")), "region_id", "total", "n_kinds")


@query("finding_anomalies_unnested", f"""{ANOM} SELECT region_id, seq, detector FROM anomalies""")
def finding_anomalies_unnested(spark, sf_dir):
    nested = relation(spark, sf_dir, "anomalies").groupBy("region_id", "mjd").agg(F.collect_list(F.struct("seq", "detector")).alias("anomalies"))
    kept = nested.select("region_id", F.to_json("anomalies").alias("body")).select("region_id", F.from_json("body", "array<struct<seq: bigint, detector: string>>").alias("anomalies"))
    return kept.select("region_id", F.explode("anomalies").alias("a")).select("region_id", "a.seq", "a.detector")


@query("bounded_history", f"""{ANOM} SELECT detector, seq FROM anomalies QUALIFY row_number() OVER (PARTITION BY detector ORDER BY seq DESC) <= 50""")
def bounded_history(spark, sf_dir):
    return evaluation.last_rows(relation(spark, sf_dir, "anomalies"), ["detector"], 50).select("detector", "seq")


@query("genome_replay", f"""{VEC} SELECT vec_id AS genome_id, round(vec[1]::DOUBLE, 6) AS fitness FROM vectors ORDER BY vec[1] DESC, vec_id LIMIT 50""")
def genome_replay(spark, sf_dir):
    genomes = relation(spark, sf_dir, "vectors").select(F.col("vec_id").alias("genome_id"), F.col("vec")[0].cast("double").alias("fitness"))
    return shown(learning.replay([genomes.where("genome_id % 2 = 0"), genomes.where("genome_id % 2 = 1")]))


@query("gated_weights", f"""{VEC}, r AS (SELECT vec_id, CASE WHEN vec[3] >= 0 THEN greatest(vec[1]::DOUBLE, 0) ELSE 0 END AS a, CASE WHEN vec[4] >= 0 THEN greatest(vec[2]::DOUBLE, 0) ELSE 0 END AS b FROM vectors)
SELECT vec_id, round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 6) AS share_lens, round(CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0 END, 6) AS share_wavelet FROM r""")
def gated_weights(spark, sf_dir):
    v = lambda i: F.col("vec")[i].cast("double")
    genomes = relation(spark, sf_dir, "vectors").select("vec_id", v(0).alias("weight_lens"), v(1).alias("weight_wavelet"), (v(2) + 0.5).alias("enable_lens"), (v(3) + 0.5).alias("enable_wavelet"))
    return shown(learning.gated_weights(genomes, ["lens", "wavelet"]), "vec_id", "share_lens", "share_wavelet")


@query("novelty_mahalanobis")
def novelty_mahalanobis(spark, sf_dir):
    items = relation(spark, sf_dir, "vectors")
    return shown(learning.mahalanobis_novelty(items, items.orderBy(F.desc("vec_id")).limit(500)))


@query("normality_tests")
def normality_tests(spark, sf_dir):
    return shown(evaluation.anderson_darling(relation(spark, sf_dir, "anomalies"), ["region_id"], "score"))


@query("rating_labels", f"""{ANOM}, r AS (SELECT seq, 1 + seq % 10 AS rating FROM anomalies) SELECT seq, CASE WHEN rating >= 8 THEN 'High' WHEN rating >= 5 THEN 'Moderate' WHEN rating >= 3 THEN 'Low' ELSE 'Very Low' END AS label FROM r""")
def rating_labels(spark, sf_dir):
    return relation(spark, sf_dir, "anomalies").select("seq", report.confidence_label(1 + F.col("seq") % 10).alias("label"))


#: The five detectors' own SQL, one subquery each.
PARTS = {"lens": ("lens_scores", "image_id"), "morphology": ("morphology", "image_id"), "wavelet": ("wavelet_scores", "image_id"), "population": ("population_scores", "region_id")}
FIELD = "substr('ANR', CAST(region_id AS INT) + 1, 1)"


@query("ensemble_all", "WITH " + ", ".join(f"{d} AS (SELECT {key} AS region_id, {d}_score AS score FROM ({ORACLE_SQL[q]}))" for d, (q, key) in PARTS.items()) + f""", distribution AS (SELECT {FIELD} AS region_id, distribution_score AS score FROM ({ORACLE_SQL["distribution_scores"]})),
s AS (SELECT region_id, {", ".join(f"coalesce({d}.score, 0) AS {d}" for d in (*PARTS, "distribution"))} FROM morphology {" ".join(f"FULL JOIN {d} USING (region_id)" for d in (*PARTS, "distribution") if d != "morphology")})
SELECT region_id, {", ".join(f"round({d}, 4) AS {d}" for d in (*PARTS, "distribution"))}, round(greatest(0, least(1, {" + ".join(f"{evaluation.WEIGHTS[d]} * {d}" for d in (*PARTS, "distribution"))})), 4) AS ensemble_score, {" + ".join(f"({d} > 0.3)::BIGINT" for d in (*PARTS, "distribution"))} AS n_agreeing FROM s""")
def ensemble_all(spark, sf_dir):
    """Lens, morphology, wavelet, population and distribution detectors over three fields, as one matrix."""
    tables = {
        "image": relation(spark, sf_dir, "pixels").groupBy(F.col("image_id").alias("region_id"), "x", "y").agg(F.avg("v").alias("v")),
        "positions": relation(spark, sf_dir, "companions").withColumn("region_id", F.col("region_id") % 3).withColumn("region_id", F.expr(FIELD)),
        "cmd": relation(spark, sf_dir, "cmd"),
    }
    size = (32, 31)  # whole grids, whatever pixels the table has
    own = detect.DETECTORS | {"lens": ("image", lambda t: detect.lens_scores(t, 1.0, 0.02, size)), "morphology": ("image", lambda t: detect.morphology_scores(t, size)), "wavelet": ("image", lambda t: detect.wavelet_scores(t, 1.5, size))}
    found = evaluation.ensemble(evaluation.score_matrix(detect.scores(tables, detectors=own)))
    return shown(found, "region_id", *PARTS, "distribution", "ensemble_score", "n_agreeing", digits=4)


NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in evolution.NAMES) + "]"
METHODS_SQL = "[" + ", ".join(f"'{n}'" for n in evolution.SCORE_METHODS) + "]"


def unit_sql(turn: int | str, place: str, k: int | str) -> str:
    return "(" + MIXED.format(x=f"((({turn} * 4096 + {place}) * {evolution.DRAWS} + {k}))") + ")"


def operation_sql(turn: int, place: str, k: int) -> str:
    return f"{{'name': {NAMES_SQL}[floor({unit_sql(turn, place, k)} * {len(evolution.NAMES)})::BIGINT + 1], 'a': {unit_sql(turn, place, k + 1)}, 'b': {unit_sql(turn, place, k + 2)}}}"


def generation_sql(turn: int) -> str:
    u = lambda k: unit_sql(turn, "place", k)
    at = lambda k: f"floor({u(k)} * len(ops))::BIGINT"
    move = lambda v, k: f"greatest(0e0, least(1e0, {v} + CASE WHEN {unit_sql(turn, 'place', '24 + 6 * (i - 1)')} < 0.2 THEN ({unit_sql(turn, 'place', f'{k} + 6 * (i - 1)')} + {unit_sql(turn, 'place', f'{k + 1} + 6 * (i - 1)')} - 1) * 0.25 ELSE 0 END))"
    return f"""{ANOM}, ge AS (SELECT p AS genome_id, list_slice([{", ".join(operation_sql(42, "p", 1 + 3 * i) for i in range(5))}], 1, 2 + floor({unit_sql(42, "p", 0)} * 4)::BIGINT) AS ops, {METHODS_SQL}[floor({unit_sql(42, "p", 40)} * 3)::BIGINT + 1] AS method, fitness FROM range(30) t(p) JOIN (SELECT seq % 30 AS p, round(avg(score), 9) AS fitness FROM anomalies GROUP BY 1) USING (p)),
el AS (SELECT row_number() OVER (ORDER BY fitness DESC, genome_id) - 1 AS genome_id, ops, method FROM ge QUALIFY row_number() OVER (ORDER BY fitness DESC, genome_id) <= 2),
wi AS (SELECT place, e < 3 AS first, arg_max({{'ops': ops, 'method': method}}, (fitness, -genome_id)) AS g FROM (SELECT place, e, floor({unit_sql(turn, "place", "e")} * 30)::BIGINT AS genome_id FROM range(2, 30) a(place), range(6) b(e)) JOIN ge USING (genome_id) GROUP BY 1, 2),
pa AS (SELECT a.place, a.g.ops AS x, b.g.ops AS y, a.g.method AS method, least(len(a.g.ops), len(b.g.ops)) AS short FROM wi a JOIN wi b ON a.place = b.place AND a.first AND NOT b.first),
c1 AS (SELECT place, method, CASE WHEN short > 1 THEN list_slice(list_concat(list_slice(x, 1, 1 + floor({u(10)} * (short - 1))::BIGINT), list_slice(y, 2 + floor({u(10)} * (short - 1))::BIGINT, 99)), 1, 5) ELSE x END AS ops FROM pa),
c2 AS (SELECT place, method, CASE WHEN {u(11)} < 0.2 THEN list_concat(list_slice(ops, 1, {at(12)}), [{operation_sql(turn, "place", 13)}], list_slice(ops, {at(12)} + 2, 99)) ELSE ops END AS ops FROM c1),
c3 AS (SELECT place, method, CASE WHEN {u(16)} < 0.1 AND len(ops) < 5 THEN list_concat(list_slice(ops, 1, floor({u(17)} * (len(ops) + 1))::BIGINT), [{operation_sql(turn, "place", 18)}], list_slice(ops, floor({u(17)} * (len(ops) + 1))::BIGINT + 1, 99)) ELSE ops END AS ops FROM c2),
c4 AS (SELECT place, method, CASE WHEN {u(21)} < 0.06 AND len(ops) > 2 THEN list_concat(list_slice(ops, 1, {at(22)}), list_slice(ops, {at(22)} + 2, 99)) ELSE ops END AS ops FROM c3),
c5 AS (SELECT place, CASE WHEN {u(60)} < 0.06 THEN {METHODS_SQL}[floor({u(61)} * 3)::BIGINT + 1] ELSE method END AS method, i, ops[i].name AS name, {move("ops[i].a", 25)} AS a, {move("ops[i].b", 27)} AS b FROM c4, LATERAL (SELECT unnest(range(1, len(ops) + 1)) AS i))
SELECT genome_id, method, i AS nth, ops[i].name AS name, round(ops[i].a, 6) AS a, round(ops[i].b, 6) AS b FROM el, LATERAL (SELECT unnest(range(1, len(ops) + 1)) AS i) UNION ALL SELECT place, method, i, name, round(a, 6), round(b, 6) FROM c5"""


@query("pipeline_generation", generation_sql(7))
def pipeline_generation(spark, sf_dir):
    """The generation that follows thirty pipelines, of which the anomalies' mean scores are the fitness."""
    fitness = relation(spark, sf_dir, "anomalies").groupBy((F.col("seq") % 30).cast("long").alias("genome_id")).agg(F.round(F.avg("score"), 9).alias("fitness"))
    found = evolution.next_generation(evolution.first_generation(spark, 30).join(fitness, "genome_id"), 30, 7)
    each = found.select("genome_id", "method", F.posexplode("ops").alias("nth", "o"))
    return shown(each.select("genome_id", "method", (F.col("nth") + 1).alias("nth"), "o.name", "o.a", "o.b"))


REGIONS = "rg AS (SELECT n_nationkey AS region_id, n_nationkey * 14.5e0 AS ra, n_nationkey * 3.25e0 - 40 AS dec FROM nation)"


@query("catalog_cache", f"""{duck("sources")}, {REGIONS}, ky AS (SELECT region_id, substr(sha256('survey:' || printf('%.6f', ra) || ':' || printf('%.6f', dec) || ':3.0000:__catalog__'), 1, 16) AS key FROM rg),
ro AS (SELECT region_id, source_id, mag FROM sources WHERE region_id % 2 = 0 AND (region_id % 4 <> 0 OR mag < 18)), ct AS (SELECT region_id, count(*) AS n_rows, max(mag) AS faintest FROM ro GROUP BY 1)
SELECT region_id::BIGINT AS region_id, key, region_id % 2 = 0 AS is_hit, CASE WHEN region_id % 2 = 0 THEN coalesce(n_rows, 0) END AS n_rows, round(faintest, 6) AS faintest FROM ky LEFT JOIN ct USING (region_id)""")
def catalog_cache(spark, sf_dir):
    """Catalogs of every other region are cached, those of every fourth then replaced by their bright sources; all regions are asked for."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    regions = nation.selectExpr("CAST(n_nationkey AS BIGINT) AS region_id", "'survey' AS source", "n_nationkey * 14.5D AS ra", "n_nationkey * 3.25D - 40 AS dec", "3D AS radius", f"'{CATALOG}' AS band")
    asked = keyed(regions)
    own = relation(spark, sf_dir, "sources").select("region_id", "source_id", "mag").join(asked.select("region_id", "key"), "region_id").drop("region_id")
    cache = Cache(spark, f"{shared_folder(spark)}/skyloom-cache/{uuid.uuid4().hex}")
    cache.put("all", asked.where("region_id % 2 = 0"), own)
    cache.put("bright", asked.where("region_id % 4 = 0"), own.where("mag < 18"))
    found = cache.get(asked).groupBy("key").agg(F.max("mag").alias("faintest"))
    return shown(cache.lookup(asked).join(found, "key", "left"), "region_id", "key", "is_hit", "n_rows", "faintest")
