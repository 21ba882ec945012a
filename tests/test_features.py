"""Feature vectors and injections against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import features, injection, surveys

PIXELS = "image_id string, x int, y int, v double"


def pixels(spark, **images):
    return spark.createDataFrame([(k, int(x), int(y), float(a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])], PIXELS)


def test_hand_features(spark):
    rng = np.random.default_rng(1)
    a, flat = rng.gamma(2, 10, (9, 12)), np.full((9, 12), 7.0)
    found = {r.image_id: r for r in features.hand_features(pixels(spark, a=a, flat=flat).union(spark.createDataFrame([("bad", 0, 0, math.nan)], PIXELS)), 12, 9).collect()}
    assert list(found["a"].asDict()) == ["image_id", *features.FEATURES] and len(features.FEATURES) == 20
    p = np.pad(a, 1, mode="symmetric")
    gx = sum(w * (p[1 + j : 10 + j, 2:] - p[1 + j : 10 + j, :-2]) for j, w in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(w * (p[2:, 1 + i : 13 + i] - p[:-2, 1 + i : 13 + i]) for i, w in ((-1, 1), (0, 2), (1, 1)))
    lap = p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * a
    g, z = np.hypot(gx, gy), (a - a.mean()) / a.std()
    want = [a.mean(), a.std(), (z**3).mean(), (z**4).mean() - 3, *np.percentile(a, [5, 25, 50, 75, 95]), np.log1p(np.ptp(a))]
    assert [found["a"][c] for c in features.STATISTICS] == pytest.approx(want)
    assert [found["a"][c] for c in features.TEXTURE] == pytest.approx([g.mean(), g.std(), np.abs(lap).mean(), lap.std()])
    assert [found["flat"][c] for c in ("std", "skew", "kurtosis", "gradient_mean", "laplacian_std")] == [0] * 5
    assert [found["bad"][c] for c in features.FEATURES] == [0.0] * 20


def test_no_images(spark):
    none = spark.createDataFrame([], PIXELS)
    assert features.hand_features(none, 12, 9).count() == 0
    assert injection.injected(none, injection.injections(none, 12, 9), 12, 9).count() == 0


def test_injected_light(spark):
    own = injection.scaled(0.3)
    images = pixels(spark, a=np.ones((40, 40)), **{"b#1": np.zeros((40, 40))})
    plan = injection.injections(images, 40, 40)
    rows = injection.parted(injection.injected(images, plan, 40, 40, own)).collect()
    assert {(r.image_id, r.injection) for r in rows} == {(k, i) for k in ("a", "b#1") for i in range(4)}
    got = np.zeros((4, 40, 40))
    for r in rows:
        if r.image_id == "a":
            got[r.injection, r.y, r.x] = r.v
    assert (got[0] == 1).all()
    yy, xx = np.mgrid[:40, :40]
    radius, theta = np.hypot(xx - 20, yy - 20), np.arctan2(yy - 20, xx - 20)
    assert got[2] - 1 == pytest.approx(150 * np.exp(-0.5 * ((radius - 7.5) / 1.5) ** 2))
    start = plan.where("image_id = 'a' and kind = 'arc'").select(injection.unit(F.col("image_id"), F.col("kind"), F.lit("angle")).alias("u")).first().u * 2 * math.pi - math.pi
    inside = (np.abs(radius - 9) < 3) & ((theta - start) % (2 * math.pi) < math.pi / 2)
    assert got[1] - 1 == pytest.approx(np.where(inside, 200 * np.exp(-0.5 * ((radius - 9) / 1.5) ** 2), 0))
    assert got[3].sum() > 1600 + 1000 and (got[3] >= 1).all()


def test_gains(spark):
    scores = spark.createDataFrame([("a", 0, 0.2), ("a", 1, 0.3), ("a", 2, 0.22), ("a", 3, 0.2)], "image_id string, injection int, score double")
    assert {r.injection: r.credit for r in injection.gains(scores).collect()} == {1: 1.0, 2: 0.5, 3: 0.0}


def test_fitness_top_part(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(s)) for g in range(4) for s in np.concatenate([rng.choice([0.2, 0.5, 0.5001, 0.9, 1.7, -0.3], 7 * g + 1), [] if g else [1.0]])]
    results = spark.createDataFrame(rows, "genome_id long, score double").selectExpr("*", "0.5D novelty", "0.5D diversity", "0.5D recovery")
    for r in surveys.fitness_components(results).collect():
        own = sorted(s for g, s in rows if g == r.genome_id)
        assert r.anomaly == pytest.approx(np.mean(own[-max(1, len(own) // 5) :]))
