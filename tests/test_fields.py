"""Fields of positions and images: cells, groups on the sky, mosaics, stencils and resampling, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import images, lens, resampling, spatial, stencils, tessellation


def brute_cells(points, box):
    """Areas by clipping with every other point."""
    out = {}
    for i, (x, y) in enumerate(points):
        poly = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
        for u, v in points:
            if (u, v) == (x, y):
                continue
            side = lambda p: (p[0] - x) * (u - x) + (p[1] - y) * (v - y) - ((u - x) ** 2 + (v - y) ** 2) / 2  # noqa: B023, E731
            new = []
            for a, b in zip(poly, poly[1:] + poly[:1], strict=True):
                if side(a) <= 0:
                    new.append(a)
                if side(a) * side(b) < 0:
                    t = side(a) / (side(a) - side(b))
                    new.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            poly = new
        out[i] = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(poly, poly[1:] + poly[:1], strict=True))) / 2
    return out


def test_cells_against_brute_force(spark):
    rng = random.Random(8)
    points = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(150)] + [(50 + rng.gauss(0, 0.02), 50 + rng.gauss(0, 0.02)) for _ in range(200)] + [(float(i), 10.0) for i in range(20)]
    box = (0.0, 0.0, 100.0, 100.0)
    rows = [("a", i, x, y) for i, (x, y) in enumerate(points)] + [("b", 1000, 5.0, 5.0), ("c", 1001, 1.0, 2.0), ("c", 1002, 1.0, 2.0), ("c", 1003, 9.0, 2.0), ("c", 1004, None, 2.0), ("c", 1005, float("nan"), 2.0), ("c", 1006, 300.0, 2.0)]
    df = spark.createDataFrame(rows, "field string, source_id long, x double, y double")
    got = {r["source_id"]: r for r in tessellation.voronoi_cells(df, ["field"], box=box).collect()}
    want = brute_cells(points, box)
    assert all(abs(got[i]["area"] - want[i]) < 1e-6 for i in want) and abs(sum(got[i]["area"] for i in want) - 1e4) < 1e-6
    assert got[1000]["area"] == 1e4 and got[1000]["edge"] and {i for i in got if i > 1000} == {1001, 1002, 1003}
    assert got[1001]["area"] == got[1002]["area"] == 250 and abs(sum(got[i]["area"] for i in (1001, 1002, 1003)) - 1e4) < 1e-6
    own = {r["field"]: r for r in tessellation.voronoi_statistics(tessellation.voronoi_cells(df, ["field"], box=box), ["field"]).collect()}
    assert set(own) == {"a"} and own["a"]["clustering_excess"] > 0
    whole = tessellation.voronoi_cells(df.where("field = 'c' and x < 100"), ["field"]).agg(F.sum("area")).first()[0]
    assert whole == 0  # points on a line have a rectangle without area
    assert tessellation.voronoi_cells(df.limit(0), ["field"]).count() == 0


def separated(a, b):
    d1, d2, da = math.radians(a[1]), math.radians(b[1]), math.radians(a[0] - b[0])
    return math.degrees(2 * math.asin(math.sqrt(min(1, math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin(da / 2) ** 2))))


@pytest.mark.parametrize("radius", [0.3, 2.0, 20.0])
def test_groups_around_poles(spark, radius):
    rng = random.Random(3)
    sky = [(rng.uniform(0, 360), rng.choice([90, -90]) * (1 - abs(rng.gauss(0, 0.02)))) for _ in range(80)] + [(rng.choice([359.9, 0.1, 0.0, 360.0]) + rng.uniform(-0.5, 0.5), rng.uniform(-3, 3)) for _ in range(60)]
    sky += [(10.0, 90.0), (200.0, 90.0), (77.0, -90.0), (-0.2, 0.0), (359.8, 0.0)]
    rows = [(i % 2, i, ra, max(-90.0, min(90.0, dec)), None, None) for i, (ra, dec) in enumerate(sky)] + [(0, 900, None, None, 5.0, 5.0), (0, 901, None, None, 14.0, 5.0), (0, 902, 10.0, 89.99, 14.5, 5.0), (1, 903, None, None, 5.0, 5.0), (1, 904, None, None, None, None)]
    parent = {r[1]: r[1] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in rows:
        for b in rows:
            on_sky = None not in (a[2], b[2]) and separated(a[2:4], b[2:4]) <= radius
            on_image = None not in (a[4], b[4]) and math.hypot(a[4] - b[4], a[5] - b[5]) <= 15
            if a[0] == b[0] and a[1] < b[1] and (on_sky or on_image):
                x, y = sorted((root(a[1]), root(b[1])))
                parent[y] = x
    sizes = {}
    for r in rows:
        sizes[root(r[1])] = sizes.get(root(r[1]), 0) + 1
    df = spark.createDataFrame(rows, "region int, seq long, ra double, dec double, x double, y double")
    got = {r["seq"]: r["group_id"] for r in spatial.anomaly_groups(df, ["region"], sky_arcsec=radius * 3600).collect()}
    assert got == {r[1]: root(r[1]) if sizes[root(r[1])] > 1 else None for r in rows}


def test_mosaics_keep_flux(spark):
    rng = random.Random(1)
    rows = [(k, x, y, rng.uniform(0, 9)) for k in "abc" for x in range(9) for y in range(7)] + [("a", 20, 20, None), ("a", 21, 20, float("nan"))]
    df = spark.createDataFrame(rows, "image_id string, x int, y int, v double")
    grids = spark.createDataFrame([("a", 0.3, 0.1, 1.0, 1.0), ("b", 7.0, 2.2, -0.7, 1.9), ("c", -3.0, 9.0, 0.05, -2.5)], "image_id string, gx double, gy double, dx double, dy double")
    out = images.coadd(df, grids, -5.0, -9.0, 0.8)
    total, area = out.agg(F.sum("flux"), F.sum("weight")).first()
    assert abs(total - sum(r[3] for r in rows[:189])) < 1e-9
    assert abs(area * 0.64 - 63 * (1 + 0.7 * 1.9 + 0.05 * 2.5)) < 1e-9
    same = {(r["x"], r["y"]): r["mean"] for r in images.coadd(df.where("image_id = 'a' and x < 9"), grids.withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0)}), 0.0, 0.0, 1.0).collect()}
    assert all(abs(same[x, y] - v) < 1e-12 for k, x, y, v in rows[:63])


def test_stencils_against_loops(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 17))
    df = spark.createDataFrame([("i", x, y, float(a[y, x])) for y in range(20) for x in range(17)], "image_id string, x int, y int, v double")
    mirror = lambda k, n: (lambda m: m if m < n else 2 * n - 1 - m)(k % (2 * n))

    def convolve(a, taps):
        out = np.array([[sum(w * a[y, mirror(x + k, a.shape[1])] for k, w in taps.items()) for x in range(a.shape[1])] for y in range(a.shape[0])])
        return np.array([[sum(w * out[mirror(y + k, a.shape[0]), x] for k, w in taps.items()) for x in range(a.shape[1])] for y in range(a.shape[0])])

    for taps in (stencils.gaussian(3.0), stencils.gaussian(12.0), {-2: 1 / 16, 0: 0.5, 2: 7 / 16}):
        got = {(r["x"], r["y"]): r["v"] for r in stencils.smoothed(df, taps, 17, 20).collect()}
        turned = {-k: w for k, w in taps.items()}
        want = convolve(a, taps) if taps.keys() != {-2, 0, 2} else convolve(a, taps)
        assert all(abs(got[x, y] - want[y, x]) < 1e-9 for y in range(20) for x in range(17)), turned
    planes = stencils.wavelet_planes(df, 17, 20)
    assert planes.select("scale").distinct().count() == 2


def test_planted_ring_and_source(spark):
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:64, :64]
    a = rng.normal(0, 1, (64, 64))
    r = np.hypot(x - 30, y - 33)
    b = a + 200 * np.exp(-0.5 * (r / 2) ** 2) + 120 * (np.abs(r - 16) < 2)
    rows = [(k, int(i), int(j), float(m[j, i])) for k, m in (("noise", a), ("ring", b)) for j in range(64) for i in range(64)]
    df = spark.createDataFrame(rows, "image_id string, x int, y int, v double")
    found = lens.detect(df, 64, 64, pixel_scale=1.0, threshold=1.0)
    ring = found["rings"].where("image_id = 'ring' and rank = 1").first()
    assert abs(ring["ring"] - 16) <= 2 and ring["is_complete_ring"]
    score = {s["image_id"]: s["lens_score"] for s in found["scores"].collect()}
    assert score["ring"] > 0.4 > score["noise"]
    planes = spatial.kept(stencils.wavelet_planes(df, 64, 64))
    noise = stencils.wavelet_noise(planes)
    regions = spatial.kept(stencils.wavelet_regions(planes, noise, threshold=5.0))
    objects = {r["image_id"]: r for r in stencils.wavelet_objects(regions).collect()}
    assert math.hypot(objects["ring"]["x"] - 30, objects["ring"]["y"] - 33) < 3
    scores = {r["image_id"]: r["wavelet_score"] for r in stencils.wavelet_scores(noise, regions, stencils.wavelet_objects(regions)).collect()}
    assert scores["ring"] > scores["noise"]


def test_resampling(spark):
    rng = random.Random(4)
    rows = [("a", i, rng.gauss(3, 1), i % 3 == 0) for i in range(900)] + [("b", i, 5.0 + (i % 2) * 4, i % 2 == 1) for i in range(60)] + [("c", 1, None, True), ("d", 2, 7.0, None), (None, 3, 2.0, True)]
    df = spark.createDataFrame(rows, "kind string, seq long, v double, good boolean")
    out = {r["kind"]: r for r in resampling.bootstrap(df, ["kind"], resampling.mean(F.col("v")), 300).collect()}
    own = [r[2] for r in rows[:900]]
    assert abs(out["a"]["estimate"] - np.mean(own)) < 1e-9 and abs(out["a"]["spread"] / (np.std(own) / 30) - 1) < 0.2
    assert out["a"]["low"] < out["a"]["estimate"] < out["a"]["high"] and out["d"]["estimate"] == out["d"]["low"] == 7.0 and "c" not in out
    mid = {r["kind"]: r["estimate"] for r in resampling.bootstrap(df, ["kind"], resampling.median(F.col("v"), 0.0, 10.0, 200), 20).collect()}
    assert abs(mid["a"] - np.median(own)) < 0.05 and mid["d"] == 7.025
    wide = {r["kind"]: r["estimate"] for r in resampling.bootstrap(df, ["kind"], resampling.deviation(F.col("v")), 20).collect()}
    assert abs(wide["a"] - np.std(own)) < 1e-9
    p = {r["kind"]: r["p_value"] for r in resampling.randomisation_test(df, ["kind"], resampling.mean(F.col("v")), "good", 99).collect()}
    assert set(p) == {"a", "b"} and p["b"] == 0.01 and p["a"] > 0.01
