"""Results that do not hang on the order of sums, and work that spreads over keys, distances and light curves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import stats
from skyloom.operators import catalog, spatial, surveys, variability


def test_means_that_differ_by_rounding_are_ties(spark):
    rows = [(1, x, 1.0) for x in (0.3, 0.2, 0.1)] + [(2, x, 1.0) for x in (0.1, 0.2, 0.3)] + [(3, None, 1.0)]
    ratings = spark.createDataFrame(rows, "pattern_id int, rating double, weight double").coalesce(1)
    got = sorted((r["place"], r["pattern_id"]) for r in surveys.consensus_ranking(ratings).collect())
    assert got == [(1, 1), (2, 2), (3, 3)]


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_rows_of_one_group_are_dealt_over_tasks(spark, no_broadcast):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    for out in (stats.equal_bins(df, ["g"], "v", 10, 3, 1), stats.with_robust(df, ["g"], "v")):
        assert out.count() == 1000 and out.select(F.spark_partition_id()).distinct().count() > 1


def test_pairs_on_the_sky_are_made_by_many_tasks(spark):
    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1))), "gLe" if i % 4 == 0 else "star") for i in range(400)] + [(400, 10.0, 89.9, "gLe"), (401, 190.0, 89.9, None), (402, 10.0, 89.9, "star")]
    df = spark.createDataFrame(rows, "source_id int, ra double, dec double, obj_type string")
    assert spatial.sky_join(df, df, 600.0).rdd.getNumPartitions() == 8

    def sep(a, b):
        u, v = ([math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d))] for _, r, d, _ in (a, b))
        return math.degrees(2 * math.asin(min(1.0, math.dist(u, v) / 2))) * 60

    got = {r["source_id"]: r for r in spatial.cross_reference(df.drop("obj_type"), df, 600.0).collect()}
    for a in rows:
        near = [b for b in rows if sep(a, b) <= 600]
        r = got[a[0]]
        assert (r["n_matches"], r["nearest_arcmin"] == 0, r["types"], r["is_known_lens"]) == (len(near), True, sorted({b[3] for b in near} - {None}), any(b[3] == "gLe" for b in near))


def all_pairs(*_, **__):
    raise AssertionError("a row for each pair of a cell")


def test_nearest_makes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(spatial, "distance_join", all_pairs)
    rng = random.Random(6)
    rows = [(g, 1000 * g + i, float(rng.randrange(20)), float(rng.randrange(20))) for g in (0, 1) for i in range(150)] + [(2, 5000, 1.0, 1.0), (3, 6000, 0.0, 0.0), (3, 6001, 0.0, 0.0), (3, 6002, 1e7, 1e-7)]
    got = spatial.nearest(spark.createDataFrame(rows, "region_id int, source_id int, x double, y double"), ["region_id"], 16)
    want = [(a[1], *min((math.dist(a[2:], b[2:]), b[1]) for b in rows if a[0] == b[0] and a[1] != b[1])) for a in rows if a[0] != 2]
    assert sorted((r["source_id"], r["distance"], r["nearest_id"]) for r in got.collect()) == sorted(want)


def test_pairs_are_counted_without_a_row_each(spark, monkeypatch):
    monkeypatch.setattr(spatial, "distance_join", all_pairs)
    monkeypatch.setattr(spatial, "BLOCK", 16, raising=False)
    rng = random.Random(7)
    rows = [(g, i, float(rng.randrange(60)), float(rng.randrange(60))) for g in (0, 1) for i in range(120)] + [(0, 500, None, 1.0), (1, 501, 1.0, float("nan"))]
    df, edges = spark.createDataFrame(rows, "g int, source_id int, x double, y double"), [1.0, 5.0, 10.0, 30.0]
    own = [r for r in rows if r[2] is not None and r[3] == r[3]]

    def counts(pairs):
        out = {}
        for a, b in pairs:
            d = math.dist(a[2:], b[2:])
            if edges[0] <= d < edges[-1]:
                key = (a[0], sum(d >= e for e in edges) - 1)
                out[key] = out.get(key, 0) + 1
        return out

    read = lambda df: {(r["g"], r["bin"]): r["n_pairs"] for r in df.collect()}
    assert read(spatial.pair_counts(df, edges, ["g"])) == counts((a, b) for a in own for b in own if a[0] == b[0] and a[1] < b[1])
    some = df.where("source_id % 3 = 0")
    assert read(spatial.pair_counts(df, edges, ["g"], other=some)) == counts((a, b) for a in own for b in own if a[0] == b[0] and b[1] % 3 == 0)


def test_cones_ask_for_faint_sources_only_where_needed(spark, monkeypatch):
    read = []
    monkeypatch.setattr(catalog, "saved", lambda df: read.append(spatial.saved(df)) or read[-1], raising=False)
    rng = random.Random(8)
    stars = [(i, rng.uniform(0, 30), rng.uniform(-15, 15), rng.choice([None, 15.0, rng.uniform(10, 20)])) for i in range(1500)]
    regions = [(j, rng.uniform(0, 30), rng.uniform(-15, 15), rng.choice([60.0, 400.0])) for j in range(40)]
    df, rg = spark.createDataFrame(stars, "source_id int, ra double, dec double, mag double"), spark.createDataFrame(regions, "region_id int, ra double, dec double, radius_arcmin double")
    got = {(r["region_id"], r["rank"]): r["source_id"] for r in catalog.cones(df, rg, 3).collect()}
    want = {}
    unit = lambda r, d: (math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d)))
    for j, ra, dec, radius in regions:
        inside = sorted((s[3] is None, s[3] or 0, s[0]) for s in stars if 2 * math.degrees(math.asin(math.dist(unit(ra, dec), unit(s[1], s[2])) / 2)) * 60 <= radius)
        want |= {(j, k + 1): s[2] for k, s in enumerate(inside[:3])}
    assert got == want
    assert read  # cells and tiers are written once


def test_periodograms_run_in_many_tasks_as_the_plain_scan(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for s in range(30):
        n = int(rng.integers(8, 40))
        t, dy = np.sort(rng.uniform(0, 60, n)) + 59000, rng.uniform(0.02, 0.2, n)
        y = 15 + 0.4 * np.sin(2 * np.pi * t / (0.3 + s)) + rng.normal(0, dy)
        rows += [(s, "r", float(a), float(b), float(c)) for a, b, c in zip(t, y, dy, strict=True)]
        if n < 10:
            continue
        t = t - t.min()
        low, high = 1 / min(500.0, t.max() / 2), 10.0
        f = np.linspace(low, high, int(min(10_000, max(100, (high - low) * t.max() * 5))))
        w = 1 / (dy**2 + 1e-10)
        w /= w.sum()
        y = y - (w * y).sum()
        c, s_ = np.cos(2 * np.pi * f[:, None] * t), np.sin(2 * np.pi * f[:, None] * t)
        cc, ss, cs = (c * c) @ w - (c @ w) ** 2, (s_ * s_) @ w - (s_ @ w) ** 2, (c * s_) @ w - (c @ w) * (s_ @ w)
        yc, ys = c @ (w * y), s_ @ (w * y)
        power = (ss * yc**2 + cc * ys**2 - 2 * cs * yc * ys) / ((w * y * y).sum() * (cc * ss - cs * cs))
        want[s] = (1 / f[power.argmax()], power.max())
    found = variability.periodograms(spark.createDataFrame(rows, "source_id int, band string, mjd double, mag double, magerr double"))
    assert found.rdd.getNumPartitions() == 8
    got = {r["source_id"]: (r["best_period"], r["best_power"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_running_median_needs_no_second_sort():
    import statistics

    from skyloom.streaming.survey import median_of

    for n in range(1, 32):
        x = sorted((7.3 * i) % 5 for i in range(n))
        assert median_of(x) == statistics.median(x)
