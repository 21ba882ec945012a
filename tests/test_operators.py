"""Goldens, planted cases and properties of the operators."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.functions import pvalues, sphere
from skyloom.operators import catalog, evaluation, images, kernels, learning, models, outliers, population, spatial, variability
from skyloom.plans import detect, report
from skyloom.sources import fits, registry, survey
from skyloom.streaming import survey as streams

RNG = np.random.default_rng(42)


def test_fdr_goldens(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate([0.01, 0.04, 0.03])], "region_id int, seq int, p_value double")
    by = lambda mode: [round(r["p_corrected"], 9) for r in evaluation.fdr(df, ["region_id"], mode=mode).orderBy("seq").collect()]
    assert by("by_row") == [0.03, 0.04, 0.045] and by("by_rank") == [0.03, 0.04, 0.04]


def test_chain_is_one_group_and_single_is_none(spark):
    df = spark.createDataFrame([(0, 1, 100.0, 50.0), (0, 2, 110.0, 50.0), (0, 3, 120.0, 50.0), (0, 4, 300.0, 300.0)], "region_id int, source_id int, x double, y double")
    got = {r["source_id"]: r["group_id"] for r in spatial.groups(df, 15, ["region_id"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: None}


def test_floors(spark):
    rows = [(d, f * k) for d, f in evaluation.FLOORS.items() for k in (0.5, 1.0, 1.01)] + [("other", 0.05), ("other", 0.0501)]
    df = spark.createDataFrame(rows, "detector string, p double")
    got = [r["ok"] for r in df.select(evaluation.passes_floor(F.col("detector"), F.col("p")).alias("ok")).collect()]
    assert got == [True, True, False] * len(evaluation.FLOORS) + [True, False]


def test_planted_runaway_noise_and_parallax(spark):
    rows = [(1, i, float(a), float(b), 0.2 + 0.01 * (i % 9), 2.0, 0.05) for i, (a, b) in enumerate(RNG.normal(0, 2, (50, 2)))]
    rows += [(1, 100, 50.0, -30.0, 0.2, 2.0, 0.05), (1, 101, None, 1.0, 9.0, -0.7, 0.3), (1, 102, float("nan"), 0.0, 0.2, 0.01, 0.3)]
    df = spark.createDataFrame(rows, "region_id int, source_id int, pmra double, pmdec double, noise double, parallax double, parallax_error double")
    assert [r["source_id"] for r in outliers.runaways(df).collect()] == [100]
    assert [r["source_id"] for r in outliers.astrometric(df).collect()] == [101]
    assert {r["source_id"]: r["anomaly_type"] for r in outliers.parallax(df).collect()} == {101: "negative_parallax", 102: "low_parallax_snr"}
    assert outliers.runaways(df.limit(0)).count() == 0


def test_light_curves(spark):
    t = np.sort(RNG.uniform(0, 200, 200))
    rows = []
    for name, mag, err in (("flat", 18 + RNG.normal(0, 0.02, 200), 0.03), ("loud", 18 + RNG.normal(0, 0.5, 200), 0.03), ("sine", 18 + 0.5 * np.sin(2 * np.pi * t / 5) + RNG.normal(0, 0.02, 200), 0.02)):
        rows += [(name, "r", i, float(a), float(b), err) for i, (a, b) in enumerate(zip(t, mag, strict=True))]
    points = spark.createDataFrame(rows, "source_id string, band string, seq int, mjd double, mag double, magerr double")
    got = {r["source_id"]: r for r in variability.indices(points).collect()}
    assert not got["flat"]["is_variable"] and got["loud"]["chi2_reduced"] > 10 and got["loud"]["amplitude"] > 0.5 and got["sine"]["eta"] < got["loud"]["eta"]
    periods = {r["source_id"]: r for r in variability.periodograms(points, 0.5, 100).collect()}
    assert periods["sine"]["is_periodic"] and abs(periods["sine"]["best_period"] - 5) < 0.05 and not periods["flat"]["is_periodic"]
    classes = {r["source_id"]: r["class"] for r in variability.classify(points, periods=variability.periodograms(points, 0.5, 100)).collect()}
    assert classes["flat"] == "non_variable" and classes["sine"] == "periodic_pulsator"


def test_population_planted(spark):
    m = RNG.uniform(15, 21, 80)
    rows = [("a", float(x), float(0.5 + 0.12 * (x - 15) + e)) for x, e in zip(m, RNG.normal(0, 0.04, 80), strict=True)]
    rows += [("a", float(a), float(b)) for a, b in zip(RNG.uniform(12, 15, 15), RNG.uniform(1.8, 2.8, 15), strict=True)]
    rows += [("a", float(a), float(b)) for a, b in zip(RNG.uniform(12, 14.5, 5), RNG.uniform(-0.5, 0, 5), strict=True)]
    cmd = spark.createDataFrame([(r, i, a, b) for i, (r, a, b) in enumerate(rows)], "region_id string, seq int, mag double, colour double")
    got = population.evolved(population.main_sequence(cmd)).first()
    assert got["n_blue_stragglers"] > 0 and got["n_red_giants"] > 0 and 12 < got["turnoff_mag"] < 17
    assert 0 < population.population_scores(cmd).first()["population_score"] <= 1


def test_tails(spark):
    df = spark.createDataFrame([(3.0, 1.5, 4), (0.0, 2.0, 1), (12.0, 5.0, 9)], "k double, mean double, half int")
    for r in df.select("k", "mean", "half", pvalues.poisson_sf(F.col("k"), F.col("mean")).alias("p"), pvalues.chi2_sf_even(F.col("k"), F.col("half")).alias("c"), pvalues.chi2_sf("k", (F.col("half") * 2).cast("double")).alias("g"), pvalues.normal_isf(pvalues.normal_sf("mean")).alias("z")).collect():
        assert abs(r["p"] - (1 - sum(math.exp(-r["mean"]) * r["mean"] ** i / math.factorial(i) for i in range(int(r["k"]))))) < 1e-12
        assert abs(r["c"] - r["g"]) < 1e-9 and abs(r["z"] - r["mean"]) < 1e-6
    b = spark.createDataFrame([(2, 60)], "s int, n int").select(pvalues.binomial_sf(F.col("s"), F.col("n"), 0.05).alias("p")).first()["p"]
    assert abs(b - (1 - 0.95**60 - 60 * 0.05 * 0.95**59)) < 1e-12


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(180.0 + a, 45.0 + b) for a in (-1.0, 0.0, 0.5) for b in (-0.7, 0.0, 1.0)], "ra double, dec double")
    xi, eta = sphere.to_plane(F.col("ra"), F.col("dec"), F.lit(180.0), F.lit(45.0))
    back = df.select("ra", "dec", xi.alias("xi"), eta.alias("eta")).select("ra", "dec", *[c.alias(n) for c, n in zip(sphere.from_plane(F.col("xi"), F.col("eta"), F.lit(180.0), F.lit(45.0)), ("a", "d"), strict=True)])
    assert all(abs(r["ra"] - r["a"]) < 1e-9 and abs(r["dec"] - r["d"]) < 1e-9 for r in back.collect())


@pytest.mark.parametrize("nside", [1, 2, 8])
def test_healpix_pixels_cover_the_sphere_evenly(spark, nside):
    rows = survey.survey_pixels(spark, nside, 0.0, "ring").orderBy("pixel").collect()
    n = 12 * nside * nside
    assert len(rows) == n and len({(round(r["ra"], 9), round(r["dec"], 9)) for r in rows}) == n
    z = np.sin(np.radians([r["dec"] for r in rows]))
    assert abs(z.mean()) < 1e-9 and abs((z**2).mean() - 1 / 3) < 0.5 / nside**2 and (np.diff(z) < 1e-9).all()
    assert all(0 <= r["ra"] < 360 for r in rows)


def test_survey_queue(spark):
    pixels = survey.survey_pixels(spark, 2, 0.0, "ring")
    visited = spark.createDataFrame([(0, 1), (1, 0), (999, 1)], "pixel long, n_findings int")
    assert [r["pixel"] for r in survey.next_pixels(pixels, visited, 2).collect()] == [2, 3]
    assert survey.coverage(pixels, visited).first().asDict() == {"total": 48, "visited": 2, "with_findings": 1, "remaining": 46, "percent": 4.17}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0.1, 0.7))
def test_labels_against_flood_fill(seed, share):
    mask = np.random.default_rng(seed).random((13, 17)) < share
    lab, n = kernels.label(mask)
    seen, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 13 and 0 <= b < 17 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert n == count and ((lab > 0) == mask).all() and len({(i, j) for i, j in zip(lab[mask], seen[mask], strict=True)}) == count


def test_wavelet_planes_sum_to_the_image():
    a = RNG.normal(size=(33, 40))
    assert np.allclose(sum(kernels.planes(a, 4)), a)


def test_sersic_fit_recovers():
    r = np.arange(1, 40) + 0.5
    v = kernels.sersic_profile(r, 12.0, 9.0, 2.5)
    i_e, r_e, n, chi2 = kernels.fit_sersic(r, v, np.ones_like(r))
    assert abs(i_e - 12) < 0.1 and abs(r_e - 9) < 0.1 and abs(n - 2.5) < 0.05 and chi2 < 1e-4


def test_planted_source_ring_and_pipelines(spark):
    y, x = np.mgrid[:64, :64]
    a = 100 + RNG.normal(0, 2, (64, 64)) + 300 * np.exp(-((x - 40) ** 2 + (y - 20) ** 2) / 8)
    found = max(kernels.extract(a), key=lambda r: r[2])
    assert abs(found[0] - 40) < 0.5 and abs(found[1] - 20) < 0.5
    ring = 20 * np.exp(-0.5 * ((np.hypot(x - 32, y - 32) - 10) / 1.5) ** 2)
    best = max(kernels.hough_circles(ring, range(4, 20)), key=lambda c: c[3])
    assert abs(best[0] - 32) <= 1.5 and abs(best[1] - 32) <= 1.5
    score, steps = kernels.run_pipeline(a, [("subtract_model", {"sigma": 5.0}), ("edge_detect", {})], "area_fraction")
    assert 0 <= score <= 1 and len(steps) == 2
    assert kernels.run_pipeline(a, [("no_such", {})], "entropy")[0] >= 0


def test_fits_round_trip(spark, tmp_path):
    a = RNG.normal(size=(7, 11)).astype(np.float32)
    (tmp_path / "star").mkdir()
    (tmp_path / "star" / "a.fits").write_bytes(fits.serialise(a, {"MJD": "59000.5", "OBJECT": "x y"}))
    (tmp_path / "star" / "b.fits").write_bytes(fits.serialise(a)[:2880].replace(b"NAXIS   =                    2", b"NAXIS   =                    0"))
    row = fits.labelled(spark, str(tmp_path / "star")).collect()
    assert len(row) == 1 and row[0]["label"] == "star" and row[0]["header"]["MJD"] == "59000.5" and row[0]["header"]["OBJECT"] == "x y"
    assert np.array_equal(np.array(row[0]["data"], np.float32).reshape(7, 11), a)
    assert fits.augment(a, 1, True, 0.1, 1).shape == (11, 7)


def test_isolation_forest_finds_the_far_point(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(RNG.normal(size=(200, 4)))] + [(999, [9.0, 9.0, -9.0, 9.0])]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    got = models.isolation_scores(df, "id", "features").orderBy(F.col("anomaly_score").desc()).first()
    assert got["id"] == 999
    few = models.isolation_scores(df.where("id in (1, 2, 999)"), "id", "features").orderBy(F.col("anomaly_score").desc()).first()
    assert few["id"] == 999 and few["anomaly_score"] == 1.0


def test_feature_defaults(spark):
    df = spark.createDataFrame([(1,)], "id int").select(F.struct(F.lit(None).cast("double").alias("clark_evans_r"), F.lit(float("inf")).alias("voronoi_cv")).alias("distribution"), F.struct(F.lit(True).alias("is_candidate")).alias("lens"))
    got = df.select(F.array(*models.feature_vector(df)).alias("f")).first()["f"]
    want = {("distribution", "clark_evans_r"): 1.0, ("lens", "is_candidate"): 1.0, ("top", "embedding_anomaly_score"): 0.5}
    assert len(got) == 65 and {f[:2]: v for f, v in zip(models.FEATURES, got, strict=True) if v} == want


def test_temporal_classes(spark):
    rows = [(1, 1.0, "positive"), (1, 2.0, "positive"), (2, 1.0, "positive"), (3, 5.0, "positive"), (3, 1.0, "negative"), (4, 1.0, "negative"), (5, 1.0, "positive"), (5, 2.0, "negative"), (5, 3.0, "negative")]
    df = spark.createDataFrame([(g, t, s, 6.0, 1.0, 1.0) for g, t, s in rows], "g int, epoch double, sign string, peak_snr double, cx double, cy double")
    found = images.residual_classes(df, ["g"])
    assert {r["g"]: r["kind"] for r in found.collect()} == {1: "brightening", 2: "new", 3: "new", 4: "disappeared", 5: "fading"}
    assert 0 < images.temporal_scores(found.withColumn("r", F.lit(1)), ["r"]).first()["temporal_score"] <= 1


def test_merge_keeps_first_and_empty_ids(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("", 3)], "source_id string, seq int")
    right = spark.createDataFrame([("a", 4), ("b", 6), ("b", 5), ("", 7), (None, 8)], "source_id string, seq int")
    assert sorted(r["seq"] for r in catalog.merge(left, right).collect()) == [1, 2, 3, 5, 7, 8]


def test_cones_match_brute_force(spark):
    stars = [(i, float(a), float(d), float(m)) for i, (a, d, m) in enumerate(zip(RNG.uniform(0, 360, 400), RNG.uniform(-90, 90, 400), RNG.uniform(10, 20, 400), strict=True))]
    regions = [(0, 0.5, 0.0, 900.0), (1, 180.0, 89.0, 600.0), (2, 359.0, -88.0, 900.0), (3, 90.0, 60.0, 1200.0)]
    df, rg = spark.createDataFrame(stars, "source_id int, ra double, dec double, mag double"), spark.createDataFrame(regions, "region_id int, ra double, dec double, radius_arcmin double")

    def sep(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return math.degrees(math.acos(max(-1, min(1, math.sin(b) * math.sin(d) + math.cos(b) * math.cos(d) * math.cos(a - c)))))

    want = {(r[0], s[0]) for r in regions for s in stars if sep(r[1], r[2], s[1], s[2]) * 60 <= r[3]}
    assert {(r["region_id"], r["source_id"]) for r in catalog.cones(df, rg).collect()} == want
    for r in regions:
        assert {x["source_id"] for x in catalog.cone(df, r[1], r[2], r[3]).collect()} == {s for k, s in want if k == r[0]}
    near = spatial.sky_join(rg, df, 900.0)
    assert {(r["region_id"], r["source_id_r"]) for r in near.collect()} == {(r[0], s[0]) for r in regions for s in stars if sep(r[1], r[2], s[1], s[2]) <= 15}


def test_token_budget_and_text(spark):
    calls = spark.createDataFrame([(1, 10, False), (2, 10, True), (3, 10, False), (4, 1, False)], "seq int, tokens int, cached boolean")
    assert [r["seq"] for r in learning.within_budget(calls, 15).orderBy("seq").collect()] == [1, 2, 3]
    texts = spark.createDataFrame([('say ```json\n{"a": 1}\n``` {"b": 2}',), ('x {"c": {"d": 1}} y',), ("none",)], "t string")
    assert [r["j"] for r in texts.select(learning.json_in_text(F.col("t")).alias("j")).collect()] == ['{"a": 1}', '{"c": {"d": 1}}', None]


def test_detect_gates_and_reports(spark, tmp_path):
    rows = [(r, i, float(a), float(b), 0.2 + 0.01 * (i % 9), 2.0, 0.05, 14 + i / 10, 0.5) for r in (1, 2) for i, (a, b) in enumerate(RNG.normal(0, 2, (40, 2)))]
    rows += [(1, 99, 60.0, 0.0, 8.0, -1.0, 0.1, 15.0, 4.0)]
    t = {"catalog": spark.createDataFrame(rows, "region_id int, source_id int, pmra double, pmdec double, noise double, parallax double, parallax_error double, mag double, bp_rp double")}
    assert {r["detector"] for r in detect.scores(t).collect()} == {"transient", "kinematic"}
    assert {r["detector"] for r in detect.scores(t, {"transient": False}).collect()} == {"kinematic"}
    assert set(detect.survey(t, threshold=0.0).columns) >= {"region_id", "classification", "verdict"}
    findings = spark.createDataFrame([(1, 1, "t", "lens", 0.8, "real", "NEW"), (2, 1, "t", "lens", 0.2, "artifact", "LOW")], "seq int, region_id int, anomaly_type string, detector string, score double, verdict string, category string")
    page = report.markdown(findings)
    assert "## NEW (1)" in page and "score 0.80 (High)" in page
    run = report.Run(spark, f"file://{tmp_path}/run1")
    run.save("findings", findings)
    assert run.load("findings").count() == 2 and open(run.text("report.md", page).removeprefix("file://")).read() == page
    assert report.latest(spark, f"file://{tmp_path}").endswith("run1")


def test_sources(spark, tmp_path):
    for name, shift in (("one", 0), ("two", 1000)):
        spark.createDataFrame([(shift + i, 180 + i / 100, 45.0, 15.0 + i) for i in range(5)], "source_id int, ra double, dec double, mag double").write.parquet(f"{tmp_path}/{name}/catalog")
        spark.createDataFrame([(1, "r"), (1, name)], "region_id int, band string").write.parquet(f"{tmp_path}/{name}/images")
        spark.createDataFrame([(1, "g", 3.0), (1, "g", 1.0)], "region_id int, band string, mjd double").write.parquet(f"{tmp_path}/{name}/epochs")
        registry.parquet_source(name, f"{tmp_path}/{name}", ("r",))
    regions = spark.createDataFrame([(1, 180.0, 45.0, 3.0)], "region_id int, ra double, dec double, radius_arcmin double")
    got = registry.fetch_catalogs(spark, regions, ["one", "two"], 3)
    assert got.groupBy("source").count().count() == 2 and got.count() == 6
    assert sorted(r["key"] for r in registry.fetch_images(spark).collect()) == ["one", "one_r", "two", "two_r"]
    epochs = registry.fetch_epochs(spark)
    assert epochs.count() == 4 and {r["epoch_band"] for r in registry.epochs_of_band(registry.fetch_images(spark), epochs).collect()} == {"g"}
    tiles = spark.createDataFrame([("s", 1, 0), ("s", 1, 1), ("s", None, 1)], "source string, source_id int, tile int")
    assert detect.wide_field(tiles).count() == 2


def test_streams(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(k, 10.0 * k, 1.0, 3.0, 0)], streams.REGION).write.mode("append").parquet(f"{tmp_path}/queue")
    work = lambda df: df.select("region_id", (F.col("ra") + 1).alias("score"))
    streams.run_queue(spark, f"{tmp_path}/queue", f"{tmp_path}/state", f"{tmp_path}/out", work)
    assert sorted(r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1.0, 11.0, 21.0]
    spark.createDataFrame([(9, 90.0, 1.0, 3.0, 0)], streams.REGION).write.mode("append").parquet(f"{tmp_path}/queue")
    streams.run_queue(spark, f"{tmp_path}/queue", f"{tmp_path}/state", f"{tmp_path}/out", work)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4

    t0 = pd.Timestamp("2024-01-01")
    mags = [18 + 0.01 * ((7 * i) % 5) for i in range(40)]
    mags[30] = 14.0
    rows = [(1, "r", (t0 + pd.Timedelta(hours=i)).to_pydatetime(), float(m), 0.1) for i, m in enumerate(mags)]
    spark.createDataFrame(rows, streams.POINT).coalesce(1).write.parquet(f"{tmp_path}/points")

    def drain(make, name, mode="append"):
        q = make(spark.readStream.schema(streams.POINT).parquet(f"{tmp_path}/points")).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sum(r["n"] for r in drain(streams.windowed_brightness, "w", "complete")) == 40
    assert len(drain(lambda p: streams.observing_sessions(p, "6 hours"), "s", "complete")) == 1
    assert [(r["mag"], r["type"]) for r in drain(streams.running_outbursts, "o")] == [(14.0, "brightening")]


def test_fixed_tables_hold_a_row_for_each_detector():
    from skyloom.operators import evaluation
    from skyloom.plans import report

    assert len(evaluation.CLASSES) == 13 and set(evaluation.RATIONALES) == set(evaluation.CLASSES)
    assert set(evaluation.FOLLOW_UPS) == set(evaluation.CLASSES.values()) == set(report.DISPLAY)
    assert all(len(x) == 3 for x in evaluation.FOLLOW_UPS.values())


def test_sersic_classes():
    from skyloom.operators.kernels import morphology_class

    got = [morphology_class(n, e) for n, e in ((0.3, 0.1), (1.0, 0.6), (1.0, 0.5), (2.0, 0.9), (4.0, 0.1), (4.0, 0.2), (5.0, 0.1))]
    assert got == ["irregular", "edge-on_disk", "disk/spiral", "lenticular", "elliptical", "elliptical_elongated", "compact/cD"]


def test_confidence_edges(spark):
    from skyloom.operators.confidence import confidences

    rows = [("lens", "lens_ring", 0.5, {"completeness": 0.8}), ("lens", "lens_arc", 0.5, {}), ("kinematic", "group", 0.4, {}), ("kinematic", "group", 2.0, {"n_members": 4.0, "expected_field": 0.0}), ("unknown", "x", 0.0, {}), ("unknown", "x", 1.5, None), ("sersic", "x", 0.0, {}), ("population", "blue_straggler", 0.0, {})]
    df = spark.createDataFrame(rows, "detector string, anomaly_type string, score double, properties map<string,double>")
    got = [(round(r["p_value"], 6), r["quantity"], r["method"]) for r in confidences(df).collect()]
    assert got == [(3.2e-05, "completeness", "gaussian_sf"), (0.308538, "SNR", "gaussian_sf"), (0.6, "sigma", "gaussian_sf"), (0.0455, "n_members", "gaussian_sf"), (1.0, "score", "score_proxy"), (0.0, "score", "score_proxy"), (1.0, "score", "chi2_sf"), (1.0, "bs_fraction", "binomial_sf")]
    assert confidences(df.limit(0)).count() == 0


def test_nearest_finds_far_points(spark):
    from skyloom.operators.spatial import nearest

    rows = [(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 1e6, 1e6), (2, 4, 0.0, 0.0), (1, 5, float("nan"), 0.0)]
    got = nearest(spark.createDataFrame(rows, "region_id int, source_id int, x double, y double"), ["region_id"], 1.0, rounds=3)
    assert sorted((r["source_id"], r["nearest_id"], round(r["distance"])) for r in got.collect()) == [(1, 2, 5), (2, 1, 5), (3, 2, 1414209)]


def test_links_of_dense_groups_are_few(spark):
    rows = [(i % 2, i, float(a), float(b)) for i, (a, b) in enumerate(RNG.uniform(0, 4, (600, 2)))] + [(0, 1000, 5.0 + 1e-3, 0.5), (1, 1001, 40.0, 40.0), (0, 1002, None, 1.0), (0, 1003, float("nan"), 1.0)]
    rows += [(2, 2000 + i, float(i), 0.0) for i in range(9)] + [(2, 3000, 30.0, 0.0), (2, 3001, 31.0 + 1e-6, 0.0)]
    df = spark.createDataFrame(rows, "region_id int, source_id int, x double, y double")
    pairs = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] is not None and b[2] is not None and math.dist(a[2:], b[2:]) <= 1]
    root = {i: i for p in pairs for i in p}
    for _ in range(len(root)):
        new = dict(root)
        for a, b in pairs:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            break
        root = new
    links = spatial.spanning_links(df, 1.0, ["region_id"])
    assert links.count() < 3 * len(rows) < len(pairs)
    assert {r["source_id"]: r["group_id"] for r in spatial.groups(df, 1.0, ["region_id"]).collect()} == {r[1]: root.get(r[1]) for r in rows}
    for least in (4,):
        close = {a[1]: [b[1] for b in rows if a[0] == b[0] and None not in (a[2], b[2]) and math.dist(a[2:], b[2:]) <= 0.3] for a in rows}
        core = {i for i, near in close.items() if len(near) >= least}
        own = {i: i for i in core}
        for _ in core:
            new = {i: min(own[j] for j in close[i] if j in core) for i in core}
            if new == own:
                break
            own = new
        want = {i: min((own[j] for j in near if j in core), default=None) for i, near in close.items()}
        assert {r["source_id"]: r["cluster"] for r in spatial.dbscan(df, 0.3, least, ["region_id"]).collect()} == want
