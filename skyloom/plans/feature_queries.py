"""Queries over feature vectors of images and over injected patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.operators import features, injection, lens, surveys
from skyloom.operators.spatial import kept
from skyloom.plans.image_queries import LENSES, MORPH, PIX, image
from skyloom.plans.registry import query, shown

NAMES = features.FEATURES
TEXTURE = """fu AS (SELECT image_id, gx.x, gy.y FROM (SELECT DISTINCT image_id FROM im), range(32) gx(x), range(31) gy(y)), fi AS (SELECT fu.*, coalesce(v, 0) AS v FROM fu LEFT JOIN im USING (image_id, x, y)),
lp AS (SELECT o.image_id, o.x, o.y, sum(f.v * o.j * (2 - abs(o.i))) AS gy, sum(f.v * o.i * (2 - abs(o.j))) AS gx, sum(f.v * CASE abs(o.i) + abs(o.j) WHEN 0 THEN -4 WHEN 1 THEN 1 ELSE 0 END) AS lap
 FROM (SELECT image_id, x, y, i, j, greatest(0, least(31, x + i)) AS tx, greatest(0, least(30, y + j)) AS ty FROM fu, range(-1, 2) a(i), range(-1, 2) b(j)) o JOIN fi f ON f.image_id = o.image_id AND f.x = o.tx AND f.y = o.ty GROUP BY 1, 2, 3),
tx AS (SELECT image_id, avg(sqrt(gx ** 2 + gy ** 2)) AS gradient_mean, stddev_pop(sqrt(gx ** 2 + gy ** 2)) AS gradient_std, avg(abs(lap)) AS laplacian_mean, stddev_pop(lap) AS laplacian_std FROM lp GROUP BY 1)"""
STATISTICS = """sm AS (SELECT image_id, avg(v) AS mean, stddev_pop(v) AS std FROM im GROUP BY 1), st AS (SELECT image_id, any_value(mean) AS mean, any_value(std) AS std, avg((v - mean) ** 3) / any_value(std) ** 3 AS skew, avg((v - mean) ** 4) / any_value(std) ** 4 - 3 AS kurtosis,
quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25, median(v) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, ln(1 + max(v) - min(v)) AS log_range FROM im JOIN sm USING (image_id) GROUP BY 1)"""
SMOOTH = """sg AS (SELECT a.image_id, a.x, a.y, any_value(a.v) AS v, sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 18e0) * b.v) / sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 18e0)) AS s FROM im a JOIN im b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12 GROUP BY 1, 2, 3),
s2 AS (SELECT image_id, sum(abs(v - s)) / sum(abs(v)) AS smoothness FROM sg GROUP BY 1)"""


@query("hand_features", f"""{PIX}, {MORPH}, {SMOOTH}, {STATISTICS}, {TEXTURE} SELECT image_id, {", ".join(f"round({c}, 6) AS {c}" for c in NAMES)} FROM st JOIN tx USING (image_id) JOIN e2 USING (image_id) JOIN gi USING (image_id) JOIN m2 USING (image_id) JOIN co USING (image_id) JOIN asy USING (image_id) JOIN s2 USING (image_id)""")
def hand_features(spark, sf_dir):
    return shown(features.hand_features(image(spark, sf_dir), 32, 31))


def unit_sql(name: str, kind: str = "kind") -> str:
    return f"(('0x' || substr(md5(image_id || ':' || {kind} || ':{name}'), 1, 8))::BIGINT / 4294967296e0)"


SCALE = 0.3
#: Images of 32 x 31 pixels before and after each pattern, in place of the plain ones.
INJECTED = PIX.replace("im AS (", "i0 AS (") + f""", pl AS (SELECT image_id, i AS injection, kind, CASE i WHEN 3 THEN 8 + floor({unit_sql("x")} * 16) ELSE 16 END AS x0, CASE i WHEN 3 THEN 7 + floor({unit_sql("y")} * 17) ELSE 15 END AS y0, {unit_sql("angle")} AS u FROM (SELECT DISTINCT image_id FROM i0), (VALUES (1, 'arc'), (2, 'ring'), (3, 'overdensity')) t(i, kind)),
po0 AS (SELECT image_id, injection, a.x, b.y, sqrt((a.x - x0) ** 2 + (b.y - y0) ** 2) AS r, atan2(b.y - y0, a.x - x0) - (u * 2 * pi() - pi()) AS t FROM pl, range(32) a(x), range(31) b(y) WHERE injection < 3),
so AS (SELECT image_id, injection, floor(x0 + d * cos(w)) AS sx, floor(y0 + d * sin(w)) AS sy, 1 + 1.5e0 * (p - floor(p)) AS sigma, 300 * (0.3e0 + 0.7e0 * (q - floor(q))) AS flux FROM (SELECT *, 4.5e0 * sqrt(-2 * ln(1 - (j + 0.5e0) / 20)) AS d, u * 2 * pi() + j * 2.399963229728653e0 AS w, (j + 1) * 0.7548776662466927e0 AS p, (j + 1) * 0.5698402909980532e0 AS q FROM pl, range(20) r(j) WHERE injection = 3)),
li AS (SELECT image_id, injection, x, y, 200 * exp(-0.5e0 * ((r - 9) / 1.5e0) ** 2) AS v FROM po0 WHERE injection = 1 AND abs(r - 9) < 3 AND t - 2 * pi() * floor(t / (2 * pi())) < pi() / 2
UNION ALL SELECT image_id, injection, x, y, 150 * exp(-0.5e0 * ((r - 7.5e0) / 1.5e0) ** 2) FROM po0 WHERE injection = 2
UNION ALL SELECT image_id, injection, (sx + i)::BIGINT, (sy + k)::BIGINT, flux * exp(-(i * i + k * k) / (2 * sigma * sigma)) FROM so, range(-3, 4) a(i), range(-3, 4) b(k) WHERE sx BETWEEN 3 AND 28 AND sy BETWEEN 3 AND 27),
im AS (SELECT image_id || '#' || injection AS image_id, x::BIGINT AS x, y::BIGINT AS y, sum(v) AS v FROM (SELECT image_id, 0 AS injection, x, y, v FROM i0 UNION ALL SELECT image_id, injection, x, y, v FROM i0 JOIN pl USING (image_id) UNION ALL SELECT * FROM li) GROUP BY ALL)"""
INJECTED_LENSES = LENSES.replace(PIX, INJECTED).replace("> 0.02", "> 0.25") + """, ba AS (SELECT image_id, max(snr) AS arc_snr FROM ar GROUP BY 1), bi AS (SELECT image_id, snr AS ring_snr, completeness FROM ri QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY snr DESC, ring) = 1),
be AS (SELECT split_part(ce.image_id, '#', 1) AS image_id, split_part(ce.image_id, '#', 2)::BIGINT AS injection, peak, arc_snr, ring_snr, completeness FROM ce LEFT JOIN ba USING (image_id) LEFT JOIN bi USING (image_id))"""


def injected_scores(spark, sf_dir):
    own = image(spark, sf_dir)
    every = kept(injection.injected(own, injection.injections(own, 32, 31), 32, 31, injection.scaled(SCALE)))
    return lens.detect(every, 32, 31, pixel_scale=1.0, threshold=0.25)["scores"]


@query("injection_recovery", f"""{INJECTED_LENSES}, sc AS (SELECT *, least(1, least(coalesce(arc_snr, 0) / 10, 0.4) + least(coalesce(ring_snr, 0) / 10, 0.3) + CASE WHEN completeness > 0.6 THEN 0.2 ELSE 0 END + CASE WHEN peak > 0 THEN 0.1 ELSE 0 END) AS s FROM be)
SELECT a.image_id, a.injection, round(b.s, 6) AS before, round(a.s, 6) AS after, CASE WHEN a.s - b.s > 0.05 THEN 1e0 WHEN a.s - b.s > 0.01 THEN 0.5e0 ELSE 0e0 END AS credit FROM sc a JOIN sc b USING (image_id) WHERE a.injection > 0 AND b.injection = 0""")
def injection_recovery(spark, sf_dir):
    found = injection.parted(injected_scores(spark, sf_dir)).withColumnRenamed("lens_score", "score")
    return shown(injection.gains(found), "image_id", "injection", "before", "after", "credit")


#: A population of thresholds.
GENOMES = [(g, 0.25 + g * 0.25) for g in range(12)]


@query("fitness_with_recovery", f"""{INJECTED_LENSES}, ge AS (SELECT g AS genome_id, 0.25 + g * 0.25e0 AS t FROM range(12) r(g)),
pa AS (SELECT genome_id, image_id, injection, CASE WHEN arc_snr > t THEN arc_snr ELSE 0 END AS arc, CASE WHEN ring_snr > t THEN ring_snr ELSE 0 END AS ring, CASE WHEN ring_snr > t THEN completeness ELSE 0 END AS complete, CASE WHEN peak > 0 THEN 0.1e0 ELSE 0 END AS bright FROM be, ge),
sc AS (SELECT *, least(1, least(arc / 10, 0.4e0) + least(ring / 10, 0.3e0) + CASE WHEN complete > 0.6 THEN 0.2e0 ELSE 0 END + bright) AS s FROM pa),
ow AS (SELECT genome_id, image_id, s, [arc / 10, ring / 10, complete::DOUBLE, bright::DOUBLE, s] AS f FROM sc WHERE injection = 0),
mn AS (SELECT genome_id, [avg(f[1]), avg(f[2]), avg(f[3]), avg(f[4]), avg(f[5])] AS m FROM ow GROUP BY 1),
nv AS (SELECT a.genome_id, 0.7e0 * coalesce(1 / (1 + exp(-(min(list_distance(a.m, b.m)) - 3))), 0.5e0) + 0.3e0 * len(list_filter(any_value(a.m), lambda e: e > 0.05)) / 5 AS novelty FROM mn a LEFT JOIN mn b ON b.genome_id < a.genome_id GROUP BY 1),
fw AS (SELECT image_id FROM (SELECT DISTINCT image_id FROM ow) ORDER BY md5(image_id), image_id LIMIT 8),
dv AS (SELECT genome_id, coalesce(avg(d) / nullif(max(d), 0), 0) AS diversity FROM (SELECT a.genome_id, list_distance(a.f, b.f) AS d FROM ow a JOIN ow b ON a.genome_id = b.genome_id AND a.image_id < b.image_id WHERE a.image_id IN (FROM fw) AND b.image_id IN (FROM fw)) GROUP BY 1),
rc AS (SELECT genome_id, avg(CASE WHEN a.s - b.s > 0.05 THEN 1 WHEN a.s - b.s > 0.01 THEN 0.5e0 ELSE 0 END) AS recovery FROM sc a JOIN sc b USING (genome_id, image_id) WHERE a.injection > 0 AND b.injection = 0 GROUP BY 1),
an AS (SELECT genome_id, avg(s) FILTER (k <= greatest(1, n // 5)) AS anomaly, any_value(n) AS n, avg(s) AS mean, stddev_pop(s) AS std FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY s DESC) AS k, count(*) OVER (PARTITION BY genome_id) AS n FROM ow) GROUP BY 1),
al AS (SELECT genome_id, anomaly, CASE WHEN n > 1 THEN least(mean / greatest(std, 0.01) / 5, 1) ELSE anomaly END AS significance, novelty, coalesce(diversity, 0) AS diversity, recovery FROM an JOIN nv USING (genome_id) LEFT JOIN dv USING (genome_id) JOIN rc USING (genome_id))
SELECT genome_id, round(anomaly, 6) AS anomaly, round(significance, 6) AS significance, round(novelty, 6) AS novelty, round(diversity, 6) AS diversity, round(recovery, 6) AS recovery, round(0.35 * anomaly + 0.25 * significance + 0.15 * novelty + 0.1 * diversity + 0.15 * recovery, 6) AS fitness FROM al""")
def fitness_with_recovery(spark, sf_dir):
    scores = kept(injection.parted(injection.lens_thresholds(injected_scores(spark, sf_dir), GENOMES)))
    return shown(surveys.fitness_components(injection.fitness_inputs(scores)), "genome_id", "anomaly", "significance", "novelty", "diversity", "recovery", "fitness")
