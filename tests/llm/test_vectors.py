import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import ann, topk
from skyloom.llm.common import load
from skyloom.llm.queries import ORACLE_SQL, QUERIES

VECTORS = "vec_id long, embedding array<float>, score string, rank int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1) for i, v in rows], VECTORS)


def asks():
    return F.pmod("vec_id", F.lit(100)) == 0


def listed(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.orderBy("query_id", "rank").collect()]


def inner(rows, k=10):
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in fine:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in sorted(queries.items()):
        found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return out


def near(rows, k=10):
    fine = {(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    queries = {}
    for i, v in fine:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in sorted(queries.items()):
        found = sorted((math.dist(v, w), i) for i, w in fine if i != q and len(w) == len(v))[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return out


ODD = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [-3.0, 0.5]), (10, [1.0, 2.0, 3.0]), (100, [2.0, 2.0, 1.0]), (200, [0.0, 0.0]), (300, [5.0]), (400, [-1.0, 7.0]), (400, [-2.0, 7.0])]


def test_top_k_edges(spark):
    assert listed(topk.top_inner_products(frame(spark, ODD), asks())) == inner(ODD)
    assert listed(topk.top_inner_products(frame(spark, ODD), asks(), k=1)) == inner(ODD, 1)
    assert listed(topk.top_inner_products(frame(spark, ODD).limit(0), asks())) == []


def test_top_k_with_ties_over_many_tiles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, 1.0]) for _ in range(5)]) for i in range(700)] + [(i, [1.0] * 5) for i in range(700, 900)]
    want = inner(rows)
    assert listed(topk.top_inner_products(frame(spark, rows), asks(), tile_rows=97)) == want == listed(topk.top_inner_products(frame(spark, rows), asks()))


def test_neighbours_edges(spark):
    got, want = listed(ann.nearest_neighbours(frame(spark, ODD), asks())), near(ODD)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert listed(ann.nearest_neighbours(frame(spark, ODD).limit(0), asks())) == []


def test_neighbours_of_many_equal_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(i, rng.normal(size=4).tolist()) for i in range(400, 700)]
    got, want = listed(ann.nearest_neighbours(frame(spark, rows), asks())), near(rows)
    assert [g for g in got if g[0] < 400] == [w for w in want if w[0] < 400]


def test_recall(spark, sf):
    vectors = load(spark, sf.replace("0.001", "0.1"), "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    got, want = listed(ann.nearest_neighbours(vectors, asks())), near(rows)
    assert len(got) == len(want) and len({g[:3:2] for g in got} & {w[:3:2] for w in want}) / len(want) >= 0.9


def test_graph_search_finds_near_centres():
    rng = np.random.default_rng(3)
    model = ann.Centroids.fit(rng.normal(size=(6000, 8)), 1024, 0)
    x = rng.normal(size=(200, 8))
    at, d = model.nearest(x, 40)
    exact = np.argsort(((x[:, None] - model.centres[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(e)) for a, e in zip(at, exact, strict=True)]) > 9.3
    assert (np.diff(d, axis=1) >= -1e-6).all() and len(model.centres) > 500


def exact_top(rows, k):
    """By Python's whole numbers."""
    scaled = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows}
    out = []
    for q in sorted(i for i in scaled if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_topk_large_components(spark):
    rng = random.Random(3)
    rows = [(0, [100_000.0, 1.0]), (1, [70_000.0, 2.0]), (2, [90_000.0, 1.0]), (3, [-1e5, 4e5]), (4, [float(1 << 20), -1e6])]
    assert listed(topk.top_inner_products(frame(spark, rows), asks(), k=4)) == exact_top(rows, 4)
    wide = [(i, [rng.uniform(-1e6, 1e6) for _ in range(3000)]) for i in range(0, 120)]
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_inner_products(frame(spark, wide), asks(), k=3, scale=1 << 20).collect()
    wide = [(i, [rng.uniform(-1e4, 1e4) for _ in range(3000)]) for i in range(0, 120)]
    assert listed(topk.top_inner_products(frame(spark, wide), asks(), k=3)) == exact_top(wide, 3)
    far = [(0, [4e12, 1.0]), (1, [-4e12, 5.0]), (2, [0.0, 4e12]), (3, [0.0, 7.0])]
    assert listed(topk.top_inner_products(frame(spark, far), asks(), k=2)) == exact_top(far, 2)
    with pytest.raises(Exception, match="2\\^62"):
        topk.top_inner_products(frame(spark, [(0, [1e30]), (1, [1.0])]), asks()).collect()


def test_topk_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(ORACLE_SQL["op10_topk"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op10_topk"](spark, sf).collect()) == want


def test_few_rows_near_still_give_k(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 0.01, 4) + (1000 * (i % 40), 1, 0, 0)]) for i in range(1, 2000)] + [(100_000, [9e6, 1.0, 0.0, 0.0])]
    df = frame(spark, rows)
    got = listed(ann.nearest_neighbours(df, asks(), k=60, beam=1, ratio=0.0))
    by = {}
    for q, *_ in got:
        by[q] = by.get(q, 0) + 1
    assert set(by.values()) == {60} and len(by) == len({i for i, _ in rows if i % 100 == 0})
