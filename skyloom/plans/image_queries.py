"""Queries over positions, pixels and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.operators import evaluation, images, kernels, lens, models, pipelines, spatial, stencils, tessellation
from skyloom.plans.catalog_queries import sep_sql
from skyloom.plans.registry import query, shown
from skyloom.plans.relations import duck, relation

COMP = duck("companions")
#: Positions of companions on a plane, and pairs of them.
PAIRS = "p AS (SELECT a.region_id, a.source_id AS a, b.source_id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM companions a JOIN companions b ON a.region_id = b.region_id AND a.source_id <> b.source_id)"


@query("spatial_groups", f"""{COMP}, {PAIRS.replace("WITH", "WITH")}, w AS (WITH RECURSIVE r(n, m) AS (SELECT a, a FROM p WHERE d <= 20 UNION SELECT p.b, r.m FROM r JOIN p ON p.a = r.n AND p.d <= 20) SELECT n, min(m) AS g FROM r GROUP BY n)
SELECT region_id, source_id, g AS group_id FROM companions LEFT JOIN w ON n = source_id""")
def spatial_groups(spark, sf_dir):
    return shown(spatial.groups(relation(spark, sf_dir, "companions"), 20, ["region_id"]), "region_id", "source_id", "group_id")


@query("nearest_neighbour", f"""{COMP}, {PAIRS} SELECT region_id, a AS source_id, arg_min(b, (d, b)) AS nearest_id, round(min(d), 6) AS distance FROM p GROUP BY 1, 2""")
def nearest_neighbour(spark, sf_dir):
    return shown(spatial.nearest(relation(spark, sf_dir, "companions"), ["region_id"], 16), "region_id", "source_id", "nearest_id", "distance")


@query("clark_evans", f"""{COMP}, {PAIRS}, n AS (SELECT region_id, avg(d) AS seen FROM (SELECT region_id, a, min(d) AS d FROM p GROUP BY 1, 2) GROUP BY 1), g AS (SELECT region_id, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM companions GROUP BY 1)
SELECT region_id, round(seen / (0.5 / sqrt(n / area)), 6) AS clark_evans_r FROM n JOIN g USING (region_id)""")
def clark_evans(spark, sf_dir):
    points = relation(spark, sf_dir, "companions")
    return shown(spatial.clark_evans(points, spatial.nearest(points, ["region_id"], 16)), "region_id", "clark_evans_r")


@query("pair_counts", f"""{COMP}, {PAIRS} SELECT region_id, (CASE WHEN d >= 40 THEN 2 WHEN d >= 20 THEN 1 ELSE 0 END)::BIGINT AS bin, count(*) AS n_pairs FROM p WHERE a < b AND d < 80 GROUP BY 1, 2""")
def pair_counts(spark, sf_dir):
    return shown(spatial.pair_counts(relation(spark, sf_dir, "companions"), [0.0, 20.0, 40.0, 80.0], ["region_id"]))


BIN = "(CASE WHEN d >= 40 THEN 2 WHEN d >= 20 THEN 1 ELSE 0 END)"
CORRELATION = f"""bx AS (SELECT region_id, count(*) AS n, min(x) AS x0, max(x) - min(x) AS w, min(y) AS y0, max(y) - min(y) AS h FROM companions GROUP BY 1),
rn AS (SELECT region_id, k, x0 + (k * 0.7548776662466927e0 - floor(k * 0.7548776662466927e0)) * w AS x, y0 + (k * 0.5698402909980532e0 - floor(k * 0.5698402909980532e0)) * h AS y FROM bx, LATERAL (SELECT unnest(range(1, 2 * n + 1)) AS k)),
dd AS (SELECT region_id, {BIN} AS bin, count(*) AS dd FROM p WHERE a < b AND d < 80 GROUP BY 1, 2),
rr AS (SELECT region_id, {BIN} AS bin, count(*) AS rr FROM (SELECT a.region_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM rn a JOIN rn b ON a.region_id = b.region_id AND a.k < b.k) WHERE d < 80 GROUP BY 1, 2),
dr AS (SELECT region_id, {BIN} AS bin, count(*) AS dr FROM (SELECT a.region_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM companions a JOIN rn b ON a.region_id = b.region_id) WHERE d < 80 GROUP BY 1, 2),
ls AS (SELECT region_id, bin, coalesce(dd, 0) AS dd, rr, coalesce(dr, 0) AS dr, (coalesce(dd, 0) / nullif(n * (n - 1) / 2, 0) - 2 * coalesce(dr, 0) / (2 * n * n) + rr / (n * (2 * n - 1))) / (rr / (n * (2 * n - 1))) AS xi FROM rr LEFT JOIN dd USING (region_id, bin) LEFT JOIN dr USING (region_id, bin) JOIN bx USING (region_id))"""


@query("landy_szalay", f"""{COMP}, {PAIRS}, {CORRELATION} SELECT region_id, bin::BIGINT AS bin, dd, rr, dr, round(xi, 6) AS xi FROM ls""")
def landy_szalay(spark, sf_dir):
    return shown(spatial.landy_szalay(relation(spark, sf_dir, "companions"), [0.0, 20.0, 40.0, 80.0], ["region_id"]))


#: Every corner of a cell is where two lines meet that no third one cuts off: the lines halfway to other points, and the rectangle's sides.
VORONOI = """fv AS (SELECT * REPLACE (region_id % 3 AS region_id) FROM companions), lv AS (
  SELECT a.region_id, a.source_id, b.source_id AS k, b.x - a.x AS u, b.y - a.y AS v, ((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / 2 AS w FROM fv a JOIN fv b ON a.region_id = b.region_id AND a.source_id <> b.source_id
  UNION ALL SELECT c.region_id, source_id, -s, CASE s WHEN 1 THEN -1 WHEN 2 THEN 1 ELSE 0 END, CASE s WHEN 3 THEN -1 WHEN 4 THEN 1 ELSE 0 END, CASE s WHEN 1 THEN x - x0 WHEN 2 THEN x1 - x WHEN 3 THEN y - y0 ELSE y1 - y END
  FROM fv c JOIN (SELECT region_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fv GROUP BY 1) USING (region_id), range(1, 5) t(s)),
cv AS (SELECT l.region_id, l.source_id, least(l.k, m.k) AS k, (l.w * m.v - m.w * l.v) / (l.u * m.v - m.u * l.v) AS x, (l.u * m.w - m.u * l.w) / (l.u * m.v - m.u * l.v) AS y FROM lv l JOIN lv m ON l.source_id = m.source_id AND l.k < m.k AND abs(l.u * m.v - m.u * l.v) > 1e-9),
kc AS (SELECT * FROM cv WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.source_id = cv.source_id AND lv.u * cv.x + lv.v * cv.y > lv.w + 1e-7)),
kv AS (SELECT *, atan2(y - avg(y) OVER (PARTITION BY source_id), x - avg(x) OVER (PARTITION BY source_id)) AS t FROM kc),
nv AS (SELECT *, x * lead(y, 1, fy) OVER o - y * lead(x, 1, fx) OVER o AS twice FROM (SELECT *, first_value(x) OVER o AS fx, first_value(y) OVER o AS fy FROM kv WINDOW o AS (PARTITION BY source_id ORDER BY t, x, y)) WINDOW o AS (PARTITION BY source_id ORDER BY t, x, y)),
va AS (SELECT region_id, source_id, abs(sum(twice)) / 2 AS area, bool_or(k < 0) AS edge FROM nv GROUP BY 1, 2),
vs AS (SELECT region_id, count(*) AS n_cells, median(area) AS median_area, avg(area) AS mean_area, coalesce(stddev_pop(area) / nullif(avg(area), 0), 0) AS cv FROM va WHERE NOT edge GROUP BY 1)"""


def fields(spark, sf_dir):
    """Companions in three fields, so that cells have neighbours on all sides."""
    return relation(spark, sf_dir, "companions").withColumn("region_id", F.col("region_id") % 3)


@query("voronoi_areas", f"""{COMP}, {VORONOI} SELECT region_id, source_id, round(coalesce(area, 0), 5) AS area, coalesce(edge, true) AS edge FROM fv LEFT JOIN va USING (region_id, source_id)""")
def voronoi_areas(spark, sf_dir):
    return shown(tessellation.voronoi_cells(fields(spark, sf_dir), ["region_id"]), "region_id", "source_id", "area", "edge", digits=5)


@query("voronoi_statistics", f"""{COMP}, {VORONOI} SELECT region_id, n_cells, round(median_area, 5) AS median_area, round(mean_area, 5) AS mean_area, round(cv, 5) AS cv, round(greatest(cv - 0.53, 0), 5) AS clustering_excess FROM vs""")
def voronoi_statistics(spark, sf_dir):
    return shown(tessellation.voronoi_statistics(tessellation.voronoi_cells(fields(spark, sf_dir), ["region_id"]), ["region_id"]), digits=5)


DENSITY = f"""{COMP}, g AS (SELECT i, j FROM range(21) a(i), range(21) b(j)), k AS (SELECT region_id, i, j, (x - i * 5) ** 2 + (y - j * 5) ** 2 AS d2 FROM companions, g),
q AS (SELECT region_id, i, j, sum(exp(-d2 / 128e0)) / (128e0 * pi()) AS density FROM k WHERE d2 <= 1600 GROUP BY 1, 2, 3)"""


@query("kernel_density", f"""{DENSITY} SELECT region_id, i, j, round(density, 9) AS density FROM q""")
def kernel_density(spark, sf_dir):
    return shown(spatial.kernel_density(relation(spark, sf_dir, "companions"), 8.0, 21, 0.0, 100.0, ["region_id"]), "region_id", "i", "j", "density", digits=9)


@query("overdensities", f"""{DENSITY}, s AS (SELECT region_id, sum(density) / 441 AS mean, sqrt(greatest(0, sum(density ** 2) / 441 - (sum(density) / 441) ** 2)) AS std FROM q GROUP BY 1)
SELECT region_id, i, j, round((density - mean) / std, 6) AS significance FROM q JOIN s USING (region_id) WHERE (density - mean) / std > 3 QUALIFY row_number() OVER (PARTITION BY region_id ORDER BY (density - mean) / std DESC, i, j) <= 10""")
def overdensities(spark, sf_dir):
    found = spatial.kernel_density(relation(spark, sf_dir, "companions"), 8.0, 21, 0.0, 100.0, ["region_id"])
    return shown(spatial.overdensities(found, ["region_id"], 21), "region_id", "i", "j", "significance")


#: The same views over the three fields.
THIRDS = f"{DENSITY}, {PAIRS}, {CORRELATION}, {VORONOI}".replace(f"{COMP},", f"{COMP.replace('companions AS', 'cp AS')}, companions AS (SELECT * REPLACE (region_id % 3 AS region_id) FROM cp),", 1)


@query("distribution_scores", f"""{THIRDS}, s AS (SELECT region_id, sum(density) / 441 AS mean, sqrt(greatest(0, sum(density ** 2) / 441 - (sum(density) / 441) ** 2)) AS std FROM q GROUP BY 1),
o AS (SELECT region_id, max((density - mean) / std) AS peak FROM q JOIN s USING (region_id) WHERE (density - mean) / std > 3 GROUP BY 1), am AS (SELECT region_id, avg(xi) AS amplitude FROM ls WHERE bin < 1 GROUP BY 1),
ce AS (SELECT region_id, avg(d) / (0.5 / sqrt(any_value(n) / any_value(w * h))) AS r FROM (SELECT region_id, a, min(d) AS d FROM p GROUP BY 1, 2) JOIN bx USING (region_id) GROUP BY 1)
SELECT region_id, round(least(1, least(coalesce(greatest(cv - 0.53, 0), 0) / 0.5, 0.3) + least(abs(coalesce(amplitude, 0)) / 2, 0.3) + least(abs(coalesce(r, 1) - 1) / 0.5, 0.2) + least(coalesce(peak, 0) / 10, 0.2)), 5) AS distribution_score
FROM ce LEFT JOIN vs USING (region_id) LEFT JOIN am USING (region_id) LEFT JOIN o USING (region_id)""")
def distribution_scores(spark, sf_dir):
    points = fields(spark, sf_dir)
    by = ["region_id"]
    found = tessellation.distribution_scores(
        tessellation.voronoi_statistics(tessellation.voronoi_cells(points, by), by), spatial.landy_szalay(points, [0.0, 20.0, 40.0, 80.0], by),
        spatial.clark_evans(points, spatial.nearest(points, by, 16)), spatial.overdensities(spatial.kernel_density(points, 8.0, 21, 0.0, 100.0, by), by, 21), by,
    )
    return shown(found, "region_id", "distribution_score", digits=5)


def motions(spark, sf_dir):
    return relation(spark, sf_dir, "sources").select((F.col("region_id") % 5).alias("region_id"), "source_id", F.col("pmra").alias("x"), F.col("pmdec").alias("y"))


DB = f"""{duck("sources")}, m AS (SELECT region_id % 5 AS region_id, source_id, pmra AS x, pmdec AS y FROM sources),
p AS (SELECT a.region_id, a.source_id AS a, b.source_id AS b FROM m a JOIN m b ON a.region_id = b.region_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.2),
c AS (SELECT a AS id FROM p GROUP BY a HAVING count(*) >= 3), cc AS (SELECT p.a, p.b FROM p WHERE a IN (FROM c) AND b IN (FROM c)),
r AS (WITH RECURSIVE t(n, m) AS (SELECT id, id FROM c UNION SELECT cc.b, t.m FROM t JOIN cc ON cc.a = t.n) SELECT n, min(m) AS root FROM t GROUP BY n),
l AS (SELECT p.b AS source_id, min(root) AS cluster FROM p JOIN r ON r.n = p.a GROUP BY 1)"""


@query("dbscan_comoving", f"""{DB} SELECT m.region_id, m.source_id, cluster FROM m LEFT JOIN l USING (source_id)""")
def dbscan_comoving(spark, sf_dir):
    return shown(spatial.dbscan(motions(spark, sf_dir), 1.2, 3, ["region_id"]), "region_id", "source_id", "cluster")


@query("comoving_groups", f"""{DB}, f AS (SELECT region_id, count(*) AS n, (max(x) - min(x)) * (max(y) - min(y)) AS area FROM m GROUP BY 1)
SELECT m.region_id, cluster, count(*) AS n_members, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(stddev_pop(x), 6) AS std_x, round(stddev_pop(y), 6) AS std_y, round(sqrt(avg(x) ** 2 + avg(y) ** 2), 6) AS pm_total, round(greatest(any_value(f.n) * pi() * 1.44 / any_value(area), 0.1), 6) AS expected_field
FROM m JOIN l USING (source_id) JOIN f ON f.region_id = m.region_id GROUP BY 1, 2""")
def comoving_groups(spark, sf_dir):
    points = motions(spark, sf_dir)
    return shown(spatial.comoving_groups(points, spatial.dbscan(points, 1.2, 3, ["region_id"]), 1.2), "region_id", "cluster", "n_members", "mean_x", "mean_y", "std_x", "std_y", "pm_total", "expected_field")


@query("stellar_streams")
def stellar_streams(spark, sf_dir):
    return shown(spatial.streams(relation(spark, sf_dir, "sources"), 5))


@query("cross_reference", f"""{duck("sources", "companions")}, n AS (SELECT s.source_id, c.region_id % 4 AS kind, {sep_sql("s.ra", "s.dec", "c.ra", "c.dec")} AS d FROM sources s, companions c)
SELECT s.source_id, count(d) AS n_matches, round(min(d) * 60, 5) AS nearest_arcmin, count(d) > 0 AS is_known, coalesce(bool_or(kind = 0), false) AS is_known_lens FROM sources s LEFT JOIN n ON n.source_id = s.source_id AND d <= 5 GROUP BY 1""")
def cross_reference(spark, sf_dir):
    known = relation(spark, sf_dir, "companions").withColumn("obj_type", F.when(F.col("region_id") % 4 == 0, "gLe").otherwise("star"))
    found = spatial.cross_reference(relation(spark, sf_dir, "sources"), known, 300)
    return shown(found.withColumn("nearest_arcmin", F.round("nearest_arcmin", 5)), "source_id", "n_matches", "nearest_arcmin", "is_known", "is_known_lens")


@query("sky_groups", f"""{duck("sources")}, an AS (SELECT region_id % 3 AS region_id, source_id, ra, dec, CASE WHEN source_id % 4 = 0 THEN mag * 10 END AS x, CASE WHEN source_id % 4 = 0 THEN bp_rp * 20 END AS y FROM sources),
e AS (SELECT a.source_id AS a, b.source_id AS b FROM an a JOIN an b ON a.region_id = b.region_id AND a.source_id <> b.source_id WHERE {sep_sql("a.ra", "a.dec", "b.ra", "b.dec")} <= 2 OR sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1.5),
w AS (WITH RECURSIVE r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n, min(m) AS g FROM r GROUP BY n)
SELECT region_id, source_id, g AS group_id FROM an LEFT JOIN w ON n = source_id""")
def sky_groups(spark, sf_dir):
    """Anomalies connected within 2 degrees on the sky or, a quarter of them, within 1.5 pixels."""
    own = relation(spark, sf_dir, "sources")
    seen = F.col("source_id") % 4 == 0
    found = own.select((F.col("region_id") % 3).alias("region_id"), "source_id", "ra", "dec", F.when(seen, F.col("mag") * 10).alias("x"), F.when(seen, F.col("bp_rp") * 20).alias("y"))
    return shown(spatial.anomaly_groups(found, ["region_id"], "source_id", 7200, 1.5), "region_id", "source_id", "group_id")


PIX = f"""{duck("pixels")}, fr AS (SELECT image_id, x, y, epoch, avg(v) AS v FROM pixels GROUP BY 1, 2, 3, 4), im AS (SELECT image_id, x, y, avg(v) AS v FROM pixels GROUP BY 1, 2, 3)"""


def frames(spark, sf_dir):
    return relation(spark, sf_dir, "pixels").groupBy("image_id", "x", "y", "epoch").agg(F.avg("v").alias("v"))


def image(spark, sf_dir):
    return relation(spark, sf_dir, "pixels").groupBy("image_id", "x", "y").agg(F.avg("v").alias("v"))


DIFF = "rf AS (SELECT image_id, x, y, median(v) AS ref, count(*) AS n_epochs FROM fr GROUP BY 1, 2, 3 HAVING count(*) >= 2), df AS (SELECT fr.*, ref, v - ref AS diff FROM fr JOIN rf USING (image_id, x, y))"


@query("pixel_reference_stack", f"""{PIX}, {DIFF} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(ref, 6) AS ref, n_epochs FROM rf""")
def pixel_reference_stack(spark, sf_dir):
    return shown(images.reference_stack(frames(spark, sf_dir)))


NOISE = """qq AS (SELECT *, row_number() OVER (PARTITION BY image_id, epoch ORDER BY abs(diff), x, y) AS k, count(*) OVER (PARTITION BY image_id, epoch) AS n FROM df),
ns AS (SELECT image_id, epoch, any_value(n) AS n, greatest(1.4826e0 * mad(diff), coalesce(sqrt(avg(diff ** 2) FILTER (k <= floor(n * 0.8))), 0), stddev_pop(ref) * 0.01, 1e-6) AS noise FROM qq GROUP BY 1, 2 HAVING count(*) >= 50)"""


@query("difference_noise", f"""{PIX}, {DIFF}, {NOISE} SELECT image_id, epoch::BIGINT AS epoch, n, round(noise, 6) AS noise FROM ns""")
def difference_noise(spark, sf_dir):
    own = frames(spark, sf_dir)
    return shown(images.difference_noise(images.difference(own, images.reference_stack(own)), 50))


def residuals(spark, sf_dir, threshold=1.5):
    own = frames(spark, sf_dir)
    diffs = images.difference(own, images.reference_stack(own))
    return images.residual_pixels(diffs, images.difference_noise(diffs, 50), threshold)


COMPONENTS = """rs AS (SELECT df.*, abs(diff) / noise AS snr, row_number() OVER (ORDER BY image_id, epoch, x, y) AS id FROM df JOIN ns USING (image_id, epoch) WHERE abs(diff) / noise > 1.5),
ed AS (SELECT a.id AS a, b.id AS b FROM rs a JOIN rs b ON a.image_id = b.image_id AND a.epoch = b.epoch AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
lb AS (WITH RECURSIVE t(n, m) AS (SELECT id, id FROM rs UNION SELECT ed.b, t.m FROM t JOIN ed ON ed.a = t.n) SELECT n, min(m) AS label FROM t GROUP BY n),
rc AS (SELECT image_id, epoch, label, sum(diff) AS total_flux, max(snr) AS peak_snr, count(*) AS area, sum(abs(diff) * x) / sum(abs(diff)) AS cx, sum(abs(diff) * y) / sum(abs(diff)) AS cy FROM rs JOIN lb ON n = id GROUP BY 1, 2, 3)"""


@query("residual_components", f"""{PIX}, {DIFF}, {NOISE}, {COMPONENTS} SELECT image_id, epoch::BIGINT AS epoch, area, round(total_flux, 5) AS total_flux, round(peak_snr, 5) AS peak_snr, round(cx, 5) AS cx, round(cy, 5) AS cy, CASE WHEN total_flux > 0 THEN 'positive' ELSE 'negative' END AS sign FROM rc""")
def residual_components(spark, sf_dir):
    return shown(images.residual_components(residuals(spark, sf_dir)), "image_id", "epoch", "area", "total_flux", "peak_snr", "cx", "cy", "sign", digits=5)


@query("residual_classes", f"""{PIX}, {DIFF}, {NOISE}, rs AS (SELECT image_id, x, y, epoch, diff, abs(diff) / noise AS snr FROM df JOIN ns USING (image_id, epoch) WHERE abs(diff) / noise > 1.5),
g AS (SELECT image_id, x, y, count_if(diff > 0) AS p, count_if(diff <= 0) AS m, avg(epoch) FILTER (diff > 0) AS tp, avg(epoch) FILTER (diff <= 0) AS tm, max(snr) AS peak_snr, count(DISTINCT epoch) AS n_epochs FROM rs GROUP BY 1, 2, 3)
SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, CASE WHEN p > 0 AND m > 0 THEN CASE WHEN tp > tm THEN CASE WHEN p >= 2 THEN 'brightening' ELSE 'new' END WHEN tm > tp THEN CASE WHEN m >= 2 THEN 'fading' ELSE 'disappeared' END ELSE 'brightening' END
  WHEN p > 0 THEN CASE WHEN p >= 2 THEN 'brightening' ELSE 'new' END ELSE CASE WHEN m >= 2 THEN 'fading' ELSE 'disappeared' END END AS kind, round(peak_snr, 5) AS peak_snr, n_epochs FROM g""")
def residual_classes(spark, sf_dir):
    own = residuals(spark, sf_dir).select("image_id", "x", "y", "epoch", F.col("snr").alias("peak_snr"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.when(F.col("diff") > 0, "positive").otherwise("negative").alias("sign"))
    return shown(images.residual_classes(own, ["image_id", "x", "y"]), digits=5)


@query("image_zscale", f"""{PIX}, s AS (SELECT image_id, median(v) AS m, stddev_pop(v) AS s FROM im GROUP BY 1) SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(greatest(0, least(1, (v - m + 2 * s) / (4 * s))), 6) AS norm FROM im JOIN s USING (image_id)""")
def image_zscale(spark, sf_dir):
    return shown(images.normalise(image(spark, sf_dir), "zscale"), "image_id", "x", "y", "norm")


@query("image_linear_rgb", f"""{PIX}, s AS (SELECT image_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM im GROUP BY 1) SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, trunc(greatest(0, least(1, (v - a) / (b - a))) * 255)::BIGINT AS grey FROM im JOIN s USING (image_id)""")
def image_linear_rgb(spark, sf_dir):
    return shown(images.normalise(image(spark, sf_dir), "linear").withColumn("grey", images.rgb(F.col("norm"))), "image_id", "x", "y", "grey")


@query("image_arcsinh", f"""{PIX}, s AS (SELECT image_id, median(abs(v)) AS m FROM im GROUP BY 1) SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(asinh(v / m), 6) AS norm FROM im JOIN s USING (image_id)""")
def image_arcsinh(spark, sf_dir):
    return shown(images.normalise(image(spark, sf_dir), "arcsinh"), "image_id", "x", "y", "norm")


BRIGHT = "br AS (SELECT im.* FROM im JOIN (SELECT image_id, quantile_cont(v, 0.8) AS c FROM im GROUP BY 1) USING (image_id) WHERE v > c), ce AS (SELECT image_id, sum(v * x) / sum(v) AS cx, sum(v * y) / sum(v) AS cy, sum(v) AS tot FROM br GROUP BY 1)"
MORPH = f"""{BRIGHT}, el AS (SELECT image_id, sum(v * (x - cx) ** 2) / any_value(tot) AS xx, sum(v * (y - cy) ** 2) / any_value(tot) AS yy, sum(v * (x - cx) * (y - cy)) / any_value(tot) AS xy FROM br JOIN ce USING (image_id) GROUP BY 1),
e2 AS (SELECT image_id, 1 - sqrt(greatest(0, (xx + yy - sqrt(greatest(0, (xx + yy) ** 2 - 4 * (xx * yy - xy ** 2)))) / 2) / ((xx + yy + sqrt(greatest(0, (xx + yy) ** 2 - 4 * (xx * yy - xy ** 2)))) / 2)) AS ellipticity FROM el),
gi AS (SELECT image_id, 2 * sum(i * a) / (count(*) * sum(a)) - (count(*) + 1) / count(*) AS gini FROM (SELECT image_id, abs(v) AS a, row_number() OVER (PARTITION BY image_id ORDER BY abs(v), x, y) AS i FROM br) GROUP BY 1),
mo AS (SELECT image_id, v * ((x - cx) ** 2 + (y - cy) ** 2) AS mom, tot, coalesce(sum(v) OVER (PARTITION BY image_id ORDER BY v DESC, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM br JOIN ce USING (image_id)),
m2 AS (SELECT image_id, log10(greatest(sum(mom) FILTER (bef < 0.2 * tot) / sum(mom), 1e-20)) AS m20 FROM mo GROUP BY 1),
ra AS (SELECT image_id, r, sum(v) OVER (PARTITION BY image_id ORDER BY r, x, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / tot AS share FROM (SELECT br.*, tot, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM br JOIN ce USING (image_id))),
co AS (SELECT image_id, 5 * log10(greatest(1, min(r) FILTER (share >= 0.8) / min(r) FILTER (share >= 0.2))) AS concentration FROM ra GROUP BY 1),
asy AS (SELECT image_id, sum(abs(v - r)) / (2 * sum(abs(v))) AS asymmetry FROM (SELECT image_id, x, y, sum(v) AS v, sum(r) AS r FROM (SELECT image_id, x, y, v, 0 AS r FROM im UNION ALL SELECT image_id, 31 - x, 30 - y, 0, v FROM im) GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("morphology", f"""{PIX}, {MORPH}, sm AS (SELECT a.image_id, a.x, a.y, any_value(a.v) AS v, sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 18e0) * b.v) / sum(exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 18e0)) AS s FROM im a JOIN im b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 12 AND abs(a.y - b.y) <= 12 GROUP BY 1, 2, 3),
s2 AS (SELECT image_id, sum(abs(v - s)) / sum(abs(v)) AS smoothness FROM sm GROUP BY 1)
SELECT image_id, round(concentration, 6) AS concentration, round(asymmetry, 6) AS asymmetry, round(smoothness, 6) AS smoothness, round(gini, 6) AS gini, round(m20, 6) AS m20, round(ellipticity, 6) AS ellipticity,
round(greatest(0, least(1, 0.3 * least(asymmetry * 3, 1) + 0.25 * gini + 0.2 * smoothness + 0.15 * abs(concentration - 3) / 3 + 0.1 * ellipticity)), 6) AS morphology_score FROM e2 JOIN gi USING (image_id) JOIN m2 USING (image_id) JOIN co USING (image_id) JOIN asy USING (image_id) JOIN s2 USING (image_id)""")
def morphology(spark, sf_dir):
    return shown(images.morphology(image(spark, sf_dir), 32, 31), "image_id", "concentration", "asymmetry", "smoothness", "gini", "m20", "ellipticity", "morphology_score")


@query("radial_profile", f"""{PIX} SELECT image_id, floor(sqrt((x - 16) ** 2 + (y - 15) ** 2))::BIGINT AS radius, round(avg(v), 6) AS mean_v, count(*) AS n FROM im GROUP BY 1, 2""")
def radial_profile(spark, sf_dir):
    return shown(images.radial_profile(image(spark, sf_dir), 16, 15))


@query("density_grid", f"""{PIX} SELECT image_id, least(floor(y / 31 * 8), 7)::BIGINT AS row, least(floor(x / 32 * 8), 7)::BIGINT AS col, count(*) AS n FROM im WHERE v > 28 GROUP BY 1, 2, 3""")
def density_grid(spark, sf_dir):
    return shown(images.density_grid(image(spark, sf_dir).where("v > 28"), 32, 31))


LENS = f"""{PIX}, st AS (SELECT image_id, stddev_pop(v) AS rms, max(v) AS peak FROM im GROUP BY 1), po AS (SELECT image_id, rms, sqrt((x - 16) ** 2 + (y - 15) ** 2) AS r, atan2(y - 15, x - 16) AS th, v - peak * exp(-0.5 * (sqrt((x - 16) ** 2 + (y - 15) ** 2) / 3) ** 2) AS res FROM im JOIN st USING (image_id)),
se AS (SELECT image_id, any_value(rms) AS rms, k AS ring, s AS sector, avg(res) AS f, count(*) AS n FROM po, range(5, 14, 5) a(k), range(12) b(s) WHERE r >= k AND r < k + 4 AND th >= s * (pi() / 6) - pi() AND th < s * (pi() / 6) - pi() + pi() / 3 GROUP BY 1, 3, 4 HAVING count(*) >= 4)"""


@query("lens_arcs", f"""{LENS} SELECT image_id, ring::BIGINT AS ring, sector::BIGINT AS sector, n AS n_pixels, round(f / rms, 6) AS snr FROM se WHERE f / rms > 2 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY f / rms DESC, ring, sector) <= 10""")
def lens_arcs(spark, sf_dir):
    own = image(spark, sf_dir)
    sums = own.groupBy("image_id").agg(F.stddev_pop("v").alias("rms"), F.max("v").alias("peak"))
    centres = sums.select("image_id", F.lit(16.0).alias("x0"), F.lit(15.0).alias("y0"), "peak", F.lit(3.0).alias("radius"))
    return shown(images.lens_arcs(own, centres, sums.select("image_id", "rms")), "image_id", "ring", "sector", "n_pixels", "snr")


MIRROR = "least((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}), 2 * {n} - 1 - (({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"


def convolve_sql(table: str, taps: str, out: str) -> str:
    """Views that convolve v of table with taps (k, w), along x and then y, over 32 x 31 pixels."""
    full = "(SELECT image_id, gx.x, gy.y FROM (SELECT DISTINCT image_id FROM im), range(32) gx(x), range(31) gy(y))"
    return f"""{out}x AS (SELECT g.image_id, g.x, g.y, sum(coalesce(s.v, 0) * w) AS v FROM {full} g, {taps} LEFT JOIN {table} s ON s.image_id = g.image_id AND s.y = g.y AND s.x = {MIRROR.format(i="g.x + k", n=32)} GROUP BY 1, 2, 3),
{out} AS (SELECT g.image_id, g.x, g.y, sum(coalesce(s.v, 0) * w) AS v FROM {full} g, {taps} LEFT JOIN {out}x s ON s.image_id = g.image_id AND s.x = g.x AND s.y = {MIRROR.format(i="g.y + k", n=31)} GROUP BY 1, 2, 3)"""


LENSES = f"""{PIX}, lr AS (SELECT image_id, median(v) AS bg, stddev_pop(v) AS rms FROM im GROUP BY 1), lv AS (SELECT image_id, x, y, v - bg AS v FROM im JOIN lr USING (image_id)),
gt AS (SELECT k, exp(-0.5 * (k / 3e0) ** 2) / sum(exp(-0.5 * (k / 3e0) ** 2)) OVER () AS w FROM range(-12, 13) t(k)), {convolve_sql("lv", "gt", "gs")},
ct AS (SELECT image_id, x AS x0, y AS y0, v AS peak FROM gs QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) = 1),
nb AS (SELECT image_id, x, y, v, sqrt((x - x0) ** 2 + (y - y0) ** 2) AS r, atan2(y - y0, x - x0) AS th, peak, x0, y0 FROM lv JOIN ct USING (image_id) WHERE x - x0 BETWEEN -30 AND 29 AND y - y0 BETWEEN -30 AND 29),
br AS (SELECT image_id, r, row_number() OVER (PARTITION BY image_id ORDER BY r, x, y) AS nth, sum(v) OVER (PARTITION BY image_id ORDER BY v DESC, x, y ROWS UNBOUNDED PRECEDING) AS so_far, sum(v) OVER (PARTITION BY image_id) AS tot FROM nb WHERE r < 25 AND v > 0),
hl AS (SELECT image_id, r AS radius FROM br JOIN (SELECT image_id, least(count(*) FILTER (so_far < 0.5 * tot) + 1, count(*)) AS nth FROM br GROUP BY 1) USING (image_id, nth)),
ce AS (SELECT ct.*, coalesce(radius, 5) AS radius FROM ct LEFT JOIN hl USING (image_id)),
po AS (SELECT nb.image_id, r, th, v - nb.peak * exp(-0.5 * (r / greatest(radius, 1)) ** 2) AS res FROM nb JOIN ce USING (image_id)),
ar AS (SELECT image_id, k AS ring, s AS sector, avg(res) / any_value(rms) AS snr, count(*) AS n FROM po JOIN lr USING (image_id), range(3, 25, 5) a(k), range(12) b(s) WHERE r >= k AND r < k + 8 AND th >= s * (2 * pi() / 12) - pi() AND th < s * (2 * pi() / 12) - pi() + pi() / 3 GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND avg(res) / any_value(rms) > 0.02),
rs AS (SELECT image_id, k AS ring, least(floor((th + pi()) / (2 * pi() / 8)), 7) AS sector, sum(res) AS f, count(*) AS n, any_value(rms) AS rms FROM po JOIN lr USING (image_id), range(3, 25, 2) a(k) WHERE r >= k - 2 AND r < k + 2 GROUP BY 1, 2, 3),
ri AS (SELECT image_id, ring, sum(f) / sum(n) / any_value(rms) AS snr, sum(f) / sum(n) AS mean_flux, count(*) FILTER (f / n > rms) / 8 AS completeness FROM rs GROUP BY 1, 2 HAVING sum(n) >= 20 AND sum(f) / sum(n) / any_value(rms) > 0.02)"""


def lenses(spark, sf_dir):
    return lens.detect(image(spark, sf_dir), 32, 31, pixel_scale=1.0, threshold=0.02)


@query("lens_rings", f"""{LENSES} SELECT image_id, ring::BIGINT AS ring, round(snr, 6) AS snr, round(mean_flux, 6) AS mean_flux, completeness, completeness > 0.6 AS is_complete_ring FROM ri QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY snr DESC, ring) <= 5""")
def lens_rings(spark, sf_dir):
    return shown(lenses(spark, sf_dir)["rings"], "image_id", "ring", "snr", "mean_flux", "completeness", "is_complete_ring")


@query("lens_scores", f"""{LENSES}, ba AS (SELECT image_id, max(snr) AS arc_snr FROM ar GROUP BY 1), bi AS (SELECT image_id, snr AS ring_snr, completeness FROM ri QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY snr DESC, ring) = 1),
z AS (SELECT *, least(1, least(coalesce(arc_snr, 0) / 10, 0.4) + least(coalesce(ring_snr, 0) / 10, 0.3) + CASE WHEN completeness > 0.6 THEN 0.2 ELSE 0 END + CASE WHEN peak > 0 THEN 0.1 ELSE 0 END) AS s FROM ce LEFT JOIN ba USING (image_id) LEFT JOIN bi USING (image_id))
SELECT image_id, x0::BIGINT AS x0, y0::BIGINT AS y0, round(peak, 6) AS peak, round(radius, 6) AS radius, round(arc_snr, 6) AS arc_snr, round(ring_snr, 6) AS ring_snr, round(s, 6) AS lens_score, s > 0.3 AS is_candidate FROM z""")
def lens_scores(spark, sf_dir):
    return shown(lenses(spark, sf_dir)["scores"], "image_id", "x0", "y0", "peak", "radius", "arc_snr", "ring_snr", "lens_score", "is_candidate")


WAVELETS = f"""{PIX}, ta AS (SELECT k, w / 16e0 AS w FROM (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) t(k, w)), tb AS (SELECT 2 * k AS k, w FROM ta), {convolve_sql("im", "ta", "sa")}, {convolve_sql("sa", "tb", "sb")},
pl AS (SELECT image_id, 0 AS scale, x, y, coalesce(im.v, 0) - sa.v AS d FROM sa LEFT JOIN im USING (image_id, x, y) UNION ALL SELECT image_id, 1, x, y, sa.v - sb.v FROM sa JOIN sb USING (image_id, x, y)),
no AS (SELECT image_id, scale, 1.4826e0 * mad(d) AS noise, sum(d * d) AS energy FROM pl GROUP BY 1, 2),
sg AS (SELECT pl.*, y * 32 + x AS id, abs(d) / greatest(noise, 1e-10) AS sig FROM pl JOIN no USING (image_id, scale) WHERE abs(d) / greatest(noise, 1e-10) > 1.5),
cc AS (WITH RECURSIVE c(image_id, scale, id, root) AS (SELECT image_id, scale, id, id FROM sg UNION SELECT c.image_id, c.scale, b.id, c.root FROM c JOIN sg a ON a.image_id = c.image_id AND a.scale = c.scale AND a.id = c.id JOIN sg b ON b.image_id = a.image_id AND b.scale = a.scale AND abs(a.x - b.x) + abs(a.y - b.y) = 1) SELECT image_id, scale, id, min(root) AS root FROM c GROUP BY 1, 2, 3),
rg AS (SELECT image_id, scale, avg(x) AS cx, avg(y) AS cy, count(*) AS area, max(sig) AS peak, avg(d) > 0 AS is_positive FROM sg JOIN cc USING (image_id, scale, id) GROUP BY image_id, scale, root HAVING count(*) >= 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, scale ORDER BY peak DESC, cx, cy) AS rank FROM rg QUALIFY row_number() OVER (PARTITION BY image_id, scale ORDER BY peak DESC, cx, cy) <= 50)"""


def wavelet_parts(spark, sf_dir):
    planes = spatial.kept(stencils.wavelet_planes(image(spark, sf_dir), 32, 31))
    noise = spatial.kept(stencils.wavelet_noise(planes))
    return planes, noise, spatial.kept(stencils.wavelet_regions(planes, noise, threshold=1.5))


@query("wavelet_noise", f"""{WAVELETS} SELECT image_id, scale::BIGINT AS scale, round(noise, 6) AS noise, round(energy, 4) AS energy FROM no""")
def wavelet_noise(spark, sf_dir):
    found = stencils.wavelet_noise(spatial.kept(stencils.wavelet_planes(image(spark, sf_dir), 32, 31)))
    return shown(found.withColumn("energy", F.round("energy", 4)), "image_id", "scale", "noise", "energy")


@query("wavelet_regions", f"""{WAVELETS} SELECT image_id, scale::BIGINT AS scale, round(cx, 6) AS cx, round(cy, 6) AS cy, area, round(peak, 6) AS peak, is_positive FROM rk""")
def wavelet_regions(spark, sf_dir):
    return shown(wavelet_parts(spark, sf_dir)[2], "image_id", "scale", "cx", "cy", "area", "peak", "is_positive")


@query("wavelet_scores", f"""{WAVELETS}, dt AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY peak DESC, scale, cx, cy) AS i FROM rk WHERE rank <= 10),
nx AS (SELECT a.image_id, a.i, list(b.i ORDER BY b.i) FILTER (b.i IS NOT NULL) AS near FROM dt a LEFT JOIN dt b ON a.image_id = b.image_id AND a.scale <> b.scale AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < 5 GROUP BY 1, 2),
gm AS (WITH RECURSIVE g(image_id, i, used, n) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], 0::BIGINT FROM dt UNION ALL
 SELECT g.image_id, nx.i, CASE WHEN list_contains(used, nx.i) THEN used ELSE list_concat(used, [nx.i], list_filter(coalesce(near, []), lambda j: NOT list_contains(used, j))[1:1]) END, n + CASE WHEN NOT list_contains(used, nx.i) AND len(list_filter(coalesce(near, []), lambda j: NOT list_contains(used, j))) > 0 THEN 1 ELSE 0 END
 FROM g JOIN nx ON nx.image_id = g.image_id AND nx.i = g.i + 1) SELECT image_id, max(n) AS n_objects FROM g GROUP BY 1),
en AS (SELECT image_id, sum(scale * energy) / (sum(energy) + 1e-10) AS mean_scale, count(*) AS n_planes FROM no GROUP BY 1), dd AS (SELECT image_id, count(*) AS n, max(peak) AS top FROM dt GROUP BY 1)
SELECT image_id, n_planes, round(mean_scale, 6) AS mean_scale, coalesce(n, 0) AS n_detections, coalesce(n_objects, 0) AS n_objects, round(least(1, least(coalesce(n_objects, 0) / 10, 0.3) + least(coalesce(n, 0) / 30, 0.15) + CASE WHEN top > 10 THEN 0.15 ELSE 0 END), 6) AS wavelet_score
FROM en LEFT JOIN dd USING (image_id) LEFT JOIN gm USING (image_id)""")
def wavelet_scores(spark, sf_dir):
    _, noise, regions = wavelet_parts(spark, sf_dir)
    return shown(stencils.wavelet_scores(noise, regions, stencils.wavelet_objects(regions)), "image_id", "n_planes", "mean_scale", "n_detections", "n_objects", "wavelet_score")


GRID = "ascii(image_id) % 7 * 1.7e0 AS gx, ascii(image_id) % 5 * 2.3e0 AS gy, 0.8e0 + ascii(image_id) % 3 * 0.35e0 AS dx, 0.25e0 - ascii(image_id) % 4 * 0.5e0 AS dy"


@query("mosaic_coadd", f"""{PIX}, fp AS (SELECT image_id, v, least(gx + x * dx, gx + (x + 1) * dx) / 1.5e0 AS xa, greatest(gx + x * dx, gx + (x + 1) * dx) / 1.5e0 AS xb, least(gy + y * dy + 4, gy + (y + 1) * dy + 4) / 1.5e0 AS ya, greatest(gy + y * dy + 4, gy + (y + 1) * dy + 4) / 1.5e0 AS yb FROM im JOIN (SELECT image_id, {GRID} FROM (SELECT DISTINCT image_id FROM im)) USING (image_id)),
ov AS (SELECT image_id, i, j, v / ((xb - xa) * (yb - ya)) AS bright, (least(xb, i + 1) - greatest(xa, i)) * (least(yb, j + 1) - greatest(ya, j)) AS area FROM fp, LATERAL (SELECT unnest(range(floor(xa)::BIGINT, ceil(xb)::BIGINT)) AS i), LATERAL (SELECT unnest(range(floor(ya)::BIGINT, ceil(yb)::BIGINT)) AS j))
SELECT i AS x, j AS y, round(sum(bright * area), 8) AS flux, round(sum(area), 8) AS weight, round(sum(bright * area) / sum(area), 8) AS mean, count(DISTINCT image_id) AS n_images FROM ov WHERE area > 1e-9 GROUP BY 1, 2""")
def mosaic_coadd(spark, sf_dir):
    """Three images of different pixels, one axis of some running backwards, on one grid."""
    own = image(spark, sf_dir)
    grids = own.select("image_id").distinct().selectExpr("image_id", *GRID.split(", "))
    found = images.coadd(own, grids, 0.0, -4.0, 1.5)
    return shown(found.where("weight > 1e-9"), "x", "y", "flux", "weight", "mean", "n_images", digits=8)


@query("mask_algebra", f"""{PIX}, u AS (SELECT image_id, x, y, max(a) AS a, max(b) AS b FROM (SELECT image_id, x, y, 1 AS a, 0 AS b FROM im WHERE v > 27 UNION ALL SELECT image_id, x, y, 0, 1 FROM im WHERE x % 2 = 0) GROUP BY 1, 2, 3) SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, abs(a - b)::BIGINT AS mask FROM u""")
def mask_algebra(spark, sf_dir):
    own = image(spark, sf_dir)
    return shown(images.mask_algebra(own.where("v > 27").withColumn("mask", F.lit(1)), own.where("x % 2 = 0").withColumn("mask", F.lit(1)), "xor"))


@query("sersic_model", f"""{PIX} SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(v - 10 * exp(-(1.9992 * 2 - 0.3271) * (power(sqrt((x - 16) ** 2 + (y - 15) ** 2) / 6, 0.5) - 1)), 6) AS residual FROM im""")
def sersic_model(spark, sf_dir):
    own = image(spark, sf_dir)
    dx, dy = F.col("x") - 16, F.col("y") - 15
    model = images.sersic(F.sqrt(dx * dx + dy * dy), F.lit(2.0), F.lit(6.0), F.lit(10.0))
    return shown(own.withColumn("residual", F.col("v") - model), "image_id", "x", "y", "residual")


@query("ring_injection", f"""{PIX}, o AS (SELECT *, (sqrt((x - 16) ** 2 + (y - 15) ** 2) - 8) / 1.5 AS f FROM im) SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, round(v + CASE WHEN abs(f) < 3 THEN 20 * exp(-0.5 * f * f) ELSE 0 END, 6) AS v FROM o""")
def ring_injection(spark, sf_dir):
    return shown(images.inject_ring(image(spark, sf_dir), 16, 15, 8, 1.5, 20))


def arrays(spark, sf_dir):
    return kernels.to_arrays(image(spark, sf_dir), 32, 31)


@query("wavelet_detections")
def wavelet_detections(spark, sf_dir):
    return shown(kernels.wavelets(arrays(spark, sf_dir)), "image_id", "scale", "x", "y", "significance", "area", "n_scales")


@query("image_kernels")
def image_kernels(spark, sf_dir):
    return shown(kernels.classical(arrays(spark, sf_dir)))


@query("source_extraction")
def source_extraction(spark, sf_dir):
    return shown(kernels.sources(arrays(spark, sf_dir), 1.0))


@query("galaxy_features")
def galaxy_features(spark, sf_dir):
    return shown(kernels.galaxies(arrays(spark, sf_dir)))


@query("sersic_fits")
def sersic_fits(spark, sf_dir):
    return shown(kernels.sersic_fits(arrays(spark, sf_dir)))


class Steps:
    """SQL of composed pipelines, an operation a view, each a whole grid of image_id, x, y, v."""

    def __init__(self) -> None:
        self.views = [PIX[len("WITH "):], "d0 AS (SELECT g.image_id, g.x, g.y, coalesce(im.v, 0) AS v FROM (SELECT image_id, gx.x, gy.y FROM (SELECT DISTINCT image_id FROM im), range(32) gx(x), range(31) gy(y)) g LEFT JOIN im USING (image_id, x, y))", "src AS (SELECT image_id, x, y FROM im QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) <= 5)"]

    def add(self, text: str) -> str:
        name = f"p{len(self.views)}"
        self.views.append(f"{name} AS ({text})")
        return name

    def smooth(self, of: str, sigma: float) -> str:
        reach, k = int(4 * sigma + 0.5), len(self.views)
        self.views.append(f"t{k} AS (SELECT k, exp(-0.5 * (k / {sigma}e0) ** 2) / sum(exp(-0.5 * (k / {sigma}e0) ** 2)) OVER () AS w FROM range(-{reach}, {reach + 1}) t(k)), {convolve_sql(of, f't{k}', f's{k}')}")
        return f"s{k}"

    def less(self, a: str, b: str) -> str:
        return self.add(f"SELECT image_id, x, y, a.v - b.v AS v FROM {a} a JOIN {b} b USING (image_id, x, y)")

    def above(self, of: str, share: float) -> str:
        return self.add(f"SELECT image_id, x, y, (v > c)::INT::DOUBLE AS v FROM {of} JOIN (SELECT image_id, quantile_cont(v, {share}) AS c FROM {of} GROUP BY 1) USING (image_id)")

    def mask_sources(self, of, radius_px):
        return self.add(f"SELECT image_id, x, y, CASE WHEN EXISTS (SELECT 1 FROM src WHERE src.image_id = o.image_id AND abs(src.x - o.x) <= {radius_px} AND abs(src.y - o.y) <= {radius_px}) THEN 0 ELSE v END AS v FROM {of} o")

    def subtract_model(self, of, smooth_sigma):
        return self.less(of, self.smooth(of, smooth_sigma))

    def wavelet_residual(self, of, scale):
        for s in range(scale):
            before, of = of, self.smooth(of, float(2**s))
        return self.less(before, of)

    def threshold_image(self, of, percentile):
        return self.above(of, percentile / 100)

    def convolve_kernel(self, of, kernel_size, type):  # noqa: A002
        if type == "gaussian":
            return self.smooth(of, kernel_size / 4)
        at = lambda i, j: f"(SELECT v FROM {of} q WHERE q.image_id = o.image_id AND q.x = {MIRROR.format(i=f'o.x + {i}', n=32)} AND q.y = {MIRROR.format(i=f'o.y + {j}', n=31)})"
        return self.add(f"SELECT image_id, x, y, {at(-1, 0)} + {at(1, 0)} + {at(0, -1)} + {at(0, 1)} - 4 * v AS v FROM {of} o")

    def cross_correlate(self, of, smooth_sigma):
        density = self.smooth(self.add("SELECT image_id, x, y, count(*)::DOUBLE AS v FROM src GROUP BY 1, 2, 3"), smooth_sigma)
        return self.add(f"SELECT image_id, x, y, a.v * b.v / top AS v FROM {of} a JOIN {density} b USING (image_id, x, y) JOIN (SELECT image_id, max(v) AS top FROM {density} GROUP BY 1) USING (image_id)")

    def region_statistics(self, of, stat_type):
        self.counted = self.add(f"SELECT image_id, x, y FROM {of} WHERE v > 0")
        return of

    def edge_detect(self, of, method, threshold):
        at = lambda i, j: f"(SELECT v FROM {of} q WHERE q.image_id = o.image_id AND q.x = {MIRROR.format(i=f'o.x + {i}', n=32)} AND q.y = {MIRROR.format(i=f'o.y + {j}', n=31)})"
        gx = " + ".join(f"{w} * ({at(1, j)} - {at(-1, j)})" for j, w in ((-1, 1), (0, 2), (1, 1)))
        gy = " + ".join(f"{w} * ({at(j, 1)} - {at(j, -1)})" for j, w in ((-1, 1), (0, 2), (1, 1)))
        edges = self.add(f"SELECT image_id, x, y, sqrt(({gx}) ** 2 + ({gy}) ** 2) AS v FROM {of} o")
        return self.add(f"SELECT image_id, x, y, CASE WHEN v > c THEN 1 WHEN v > 0.4 * c THEN 0.5 ELSE 0 END::DOUBLE AS v FROM {edges} JOIN (SELECT image_id, quantile_cont(v, {(100 - threshold) / 100}) AS c FROM {edges} GROUP BY 1) USING (image_id)")

    def radial_profile_residual(self, of, center_method):
        middle = f"SELECT image_id, x AS x0, y AS y0 FROM {of} QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) = 1" if center_method == "peak" else f"SELECT image_id, sum(x * abs(v)) / sum(abs(v)) AS x0, sum(y * abs(v)) / sum(abs(v)) AS y0 FROM {of} GROUP BY 1"
        far = self.add(f"SELECT image_id, x, y, v, floor(sqrt((x - x0) ** 2 + (y - y0) ** 2)) AS r FROM {of} JOIN ({middle}) USING (image_id)")
        return self.add(f"SELECT image_id, x, y, v - avg(v) OVER (PARTITION BY image_id, r) AS v FROM {far}")

    def score(self, name, of, method):
        if method == "max_residual":
            return f"SELECT image_id, '{name}' AS pipeline, CASE WHEN stddev_pop(v) < 1e-10 THEN 0 ELSE least(max(abs(v)) / (5 * stddev_pop(v)), 1) END AS score FROM {of} GROUP BY 1"
        if method == "area_fraction":
            return f"SELECT image_id, '{name}' AS pipeline, CASE WHEN avg(v) < 0.005 THEN 0 WHEN avg(v) > 0.2 THEN greatest(0, 1 - (avg(v) - 0.2) * 5) ELSE least(avg(v) * 10, 1) END AS score FROM {self.above(of, 0.9)} GROUP BY 1"
        mask = self.counted or self.add(f"SELECT image_id, x, y FROM {self.above(of, 0.95)} WHERE v > 0")
        tree = self.add(f"WITH RECURSIVE c(image_id, x, y, root) AS (SELECT image_id, x, y, y * 32 + x FROM {mask} UNION SELECT c.image_id, b.x, b.y, c.root FROM c JOIN {mask} b ON b.image_id = c.image_id AND abs(b.x - c.x) + abs(b.y - c.y) = 1) SELECT image_id, x, y, min(root) AS root FROM c GROUP BY 1, 2, 3")
        return f"SELECT image_id, '{name}' AS pipeline, least(coalesce(n, 0) / 10, 1) AS score FROM (SELECT DISTINCT image_id FROM im) LEFT JOIN (SELECT image_id, count(DISTINCT root) AS n FROM {tree} GROUP BY 1) USING (image_id)"

    def sql(self, chosen) -> str:
        parts = []
        for name, (operations, method) in chosen.items():
            of, self.counted = "d0", None
            for op, params in operations:
                of = getattr(self, op)(of, **params)
            parts.append(self.add(self.score(name, of, method)))
        return f"WITH {', '.join(self.views)} " + " UNION ALL ".join(f"SELECT image_id, pipeline, round(greatest(0, least(score, 1)), 6) AS score FROM {p}" for p in parts)


@query("composed_pipelines", Steps().sql(pipelines.PRESETS))
def composed_pipelines(spark, sf_dir):
    """The presets over every image; its five brightest pixels are the sources."""
    own = image(spark, sf_dir)
    top = F.row_number().over(Window.partitionBy("image_id").orderBy(F.col("v").desc(), "y", "x"))
    sources = own.withColumn("nth", top).where("nth <= 5").select("image_id", "x", "y")
    return shown(pipelines.run(own, sources, pipelines.PRESETS, 32, 31), "image_id", "pipeline", "score")


@query("isolation_forest")
def isolation_forest(spark, sf_dir):
    vectors = relation(spark, sf_dir, "vectors").select("vec_id", F.col("vec").cast("array<double>").alias("features"))
    return shown(models.isolation_scores(vectors, "vec_id", "features"))


@query("meta_detector")
def meta_detector(spark, sf_dir):
    vectors = relation(spark, sf_dir, "vectors").select("vec_id", F.col("vec").cast("array<double>").alias("features"), (F.col("label") < 5).alias("is_interesting"))
    return shown(models.meta_scores(vectors, "vec_id", "features", "is_interesting"))


@query("feature_vectors", f"""WITH e AS (SELECT event_id, value FROM events) SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN value END, 0), 6) AS n_sources, CASE WHEN event_id % 5 = 0 THEN 1e0 ELSE 0e0 END AS is_candidate, 1e0 AS clark_evans_r, 65::BIGINT AS n_features FROM e""")
def feature_vectors(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sections = events.select("event_id", F.struct(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("n_sources")).alias("sources"), F.struct((F.col("event_id") % 5 == 0).alias("is_candidate"), F.lit(float("nan")).alias("lens_score")).alias("lens"))
    features = models.feature_vector(sections)
    names = [n for _, n, _ in models.FEATURES]
    pick = lambda section, n: features[next(i for i, f in enumerate(models.FEATURES) if f[:2] == (section, n))]
    assert len(names) == 65
    return shown(sections.select("event_id", pick("sources", "n_sources").alias("n_sources"), pick("lens", "is_candidate").alias("is_candidate"), pick("distribution", "clark_evans_r").alias("clark_evans_r"), F.size(F.array(*features)).alias("n_features")))


@query("genome_search")
def genome_search(spark, sf_dir):
    return shown(models.evolve(arrays(spark, sf_dir), population=8, generations=2))


@query("region_snr", f"""{PIX} SELECT image_id, round((max(v) - median(v)) / (1.4826e0 * mad(v)), 6) AS snr FROM im GROUP BY 1""")
def region_snr(spark, sf_dir):
    return shown(evaluation.region_snr(image(spark, sf_dir)))
