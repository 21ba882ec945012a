"""Composed pipelines and their search against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import evolution, pipelines
from skyloom.operators.evolution import DRAWS, NAMES


def unit(x):
    low = (1 << 31) - 1
    x = (x * 1103515245 + 12345) & low
    x ^= x >> 15
    x = (x * 1664525 + 1013904223) & low
    x ^= x >> 13
    return ((x * 69069 + 1) & low) / (1 << 31)


def plain_next(genomes, population, turn, rate=0.2, elite=2):
    u = lambda p, k: unit((turn * 4096 + p) * DRAWS + k)
    new = lambda p, k: [NAMES[int(u(p, k) * len(NAMES))], u(p, k + 1), u(p, k + 2)]
    by = {g[0]: g for g in genomes}
    out = [(i, g[1], g[2]) for i, g in enumerate(sorted(genomes, key=lambda g: (-g[3], g[0]))[:elite])]
    for p in range(elite, population):
        a, b = (max((by[int(u(p, k) * population)] for k in ks), key=lambda g: (g[3], -g[0])) for ks in ((0, 1, 2), (3, 4, 5)))
        short = min(len(a[1]), len(b[1]))
        ops = [list(o) for o in a[1]]
        if short > 1:
            cut = 1 + int(u(p, 10) * (short - 1))
            ops = ([list(o) for o in a[1]][:cut] + [list(o) for o in b[1]][cut:])[:5]
        if u(p, 11) < rate:
            ops[int(u(p, 12) * len(ops))] = new(p, 13)
        if u(p, 16) < rate * 0.5 and len(ops) < 5:
            ops.insert(int(u(p, 17) * (len(ops) + 1)), new(p, 18))
        if u(p, 21) < rate * 0.3 and len(ops) > 2:
            ops.pop(int(u(p, 22) * len(ops)))
        for i, o in enumerate(ops):
            if u(p, 24 + 6 * i) < rate:
                o[1] = min(1.0, max(0.0, o[1] + (u(p, 25 + 6 * i) + u(p, 26 + 6 * i) - 1) * 0.25))
                o[2] = min(1.0, max(0.0, o[2] + (u(p, 27 + 6 * i) + u(p, 28 + 6 * i) - 1) * 0.25))
        method = pipelines.SCORE_METHODS[int(u(p, 61) * 3)] if u(p, 60) < rate * 0.3 else a[2]
        out.append((p, ops, method))
    return out


def listed(df):
    return {r["genome_id"]: ([(o["name"], round(o["a"], 9), round(o["b"], 9)) for o in r["ops"]], r["method"]) for r in df.collect()}


def test_generations_against_plain_loops(spark):
    df = evolution.first_generation(spark, 40)
    now = [(r["genome_id"], [tuple(o) for o in r["ops"]], r["method"], r["genome_id"] * 7 % 11 / 10) for r in df.collect()]
    assert {len(g[1]) for g in now} == {2, 3, 4, 5} and {o[0] for g in now for o in g[1]} == set(NAMES)
    df = df.withColumn("fitness", F.pmod(F.col("genome_id") * 7, F.lit(11)) / 10)
    for turn in range(4):
        new = plain_next(now, 40, turn, rate=0.5)
        df = evolution.next_generation(df, 40, turn, rate=0.5)
        assert listed(df) == {p: ([(o[0], round(o[1], 9), round(o[2], 9)) for o in ops], m) for p, ops, m in new}
        now = [(p, ops, m, (p * 5 + turn) % 13 / 10) for p, ops, m in new]
        df = spark.createDataFrame([(p, [tuple(o) for o in ops], m, f) for p, ops, m, f in now], df.withColumn("fitness", F.lit(0.0)).schema)
        assert all(2 <= len(ops) <= 5 for _, ops, _, _ in now)


def test_operations_and_search(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=(16, 18))
    a[5:8, 5:8] += 30
    pixels = spark.createDataFrame([("i", x, y, float(a[y, x])) for y in range(16) for x in range(18)], "image_id string, x int, y int, v double")
    sources = spark.createDataFrame([("i", 6, 6), ("i", -3, 40)], "image_id string, x int, y int")

    def run(*ops):
        state = pipelines.State(pipelines.dense(pixels, 18, 16), sources, 18, 16)
        for name, params in ops:
            pipelines.OPERATIONS[name](state, **params)
        out = np.zeros((16, 18))
        for r in state.pixels.collect():
            out[r["y"], r["x"]] = r["v"]
        return out

    masked = a.copy()
    masked[4:9, 4:9] = 0
    assert np.allclose(run(("mask_sources", {"radius_px": 2})), masked)
    assert np.allclose(run(("threshold_image", {"percentile": 90})), a > np.percentile(a, 90))
    e = np.pad(a, 1, mode="symmetric")
    lap = e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:] - 4 * a
    assert np.allclose(run(("convolve_kernel", {"kernel_size": 3, "type": "laplacian"})), lap)
    gx = (e[:-2, 2:] + 2 * e[1:-1, 2:] + e[2:, 2:]) - (e[:-2, :-2] + 2 * e[1:-1, :-2] + e[2:, :-2])
    gy = (e[2:, :-2] + 2 * e[2:, 1:-1] + e[2:, 2:]) - (e[:-2, :-2] + 2 * e[:-2, 1:-1] + e[:-2, 2:])
    assert np.allclose(run(("edge_detect", {"method": "sobel"})), np.hypot(gx, gy) / np.hypot(gx, gy).std())
    f = np.pad(a, 2, mode="symmetric")
    disc = sum(f[2 + j : 18 + j, 2 + i : 20 + i] for j in range(-2, 3) for i in range(-2, 3) if i * i + j * j <= 6.25)
    assert np.allclose(run(("convolve_kernel", {"kernel_size": 4, "type": "tophat"})), disc / 21)
    both = run(("combine_masks", {"mode": "and"}), ("convolve_kernel", {"kernel_size": 3}), ("combine_masks", {"mode": "xor"}))
    assert set(np.unique(both)) == {0.0, 1.0}
    scores = {r["pipeline"]: r["score"] for r in pipelines.run(pixels, sources, {"one": ([("threshold_image", {"percentile": 97}), ("region_statistics", {"stat_type": "count"})], "component_count"), "none": ([("no_such", {})], "max_residual")}, 18, 16).collect()}
    assert scores["one"] == 0.1 and 0 < scores["none"] <= 1
    rate = lambda g: g.select("genome_id", (F.size("ops") / 10).alias("fitness"))
    lineage = [tuple(r) for r in evolution.evolve(pixels, sources, 18, 16, 6, 3, fitness=rate).orderBy("generation", "genome_id").collect()]
    assert lineage == [tuple(r) for r in evolution.evolve(pixels, sources, 18, 16, 6, 3, fitness=rate).orderBy("generation", "genome_id").collect()]
    assert len(lineage) == 18 and max(r[4] for r in lineage[12:]) >= max(r[4] for r in lineage[:6])
    found = evolution.evolve(pixels, sources, 18, 16, 2, 1).collect()
    assert len(found) == 2 and all(0 <= r["fitness"] <= 1 for r in found)
