"""Queries run over whole relations, and the tails hold at the counts that these give."""

import math

from pyspark.sql import functions as F

from skyloom.functions import pvalues
from skyloom.operators import learning, spatial
from skyloom.plans import catalog_queries, image_queries, survey_queries
from skyloom.plans.relations import relation


def test_every_row_is_read(spark, sf):
    n = relation(spark, sf, "anomalies").count()
    assert survey_queries.fisher_groups(spark, sf).agg(F.sum("k")).first()[0] == n
    assert survey_queries.finding_anomalies_unnested(spark, sf).count() == n
    assert image_queries.dbscan_comoving(spark, sf).count() == relation(spark, sf, "sources").count()
    assert catalog_queries.hex_tiling(spark, sf).select("field_id").distinct().count() == relation(spark, sf, "companions").count()


def test_tails_of_large_counts(spark):
    r = spark.range(1).select(
        pvalues.poisson_sf(F.lit(1010.0), F.lit(1000.0)).alias("p"),
        pvalues.binomial_sf(F.lit(1010), F.lit(20_000), 0.05).alias("b"),
        pvalues.chi2_sf_even(F.lit(4900.0), F.lit(2400)).alias("c"),
        pvalues.poisson_sf(F.lit(2.0), F.lit(0.0)).alias("none"),
    ).first()
    term = lambda i, m: math.exp(-m + i * math.log(m) - math.lgamma(i + 1))
    choose = lambda n, i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
    assert abs(r["p"] - (1 - math.fsum(term(i, 1000.0) for i in range(1010)))) < 1e-9
    assert abs(r["b"] - (1 - math.fsum(math.exp(choose(20_000, i) + i * math.log(0.05) + (20_000 - i) * math.log(0.95)) for i in range(1010)))) < 1e-9
    assert abs(r["c"] - math.fsum(term(i, 2450.0) for i in range(2400))) < 1e-9
    assert r["none"] == 0


def test_dbscan_and_diversity_against_brute_force(spark):
    points = [(0, i, float(i % 4 * (i % 3)), float(i * 7 % 11)) for i in range(40)]
    close = {a[1]: [b[1] for b in points if math.dist(a[2:], b[2:]) <= 1.2] for a in points}
    core = {i for i, near in close.items() if len(near) >= 3}
    root = {i: i for i in core}
    for _ in core:
        root = {i: min(root[j] for j in close[i] if j in core) for i in core}
    want = {i: min((root[j] for j in near if j in core), default=None) for i, near in close.items()}
    df = spark.createDataFrame(points, "region_id long, source_id long, x double, y double")
    assert {r["source_id"]: r["cluster"] for r in spatial.dbscan(df, 1.2, 3, ["region_id"]).collect()} == want
    vectors = [(0, i, [float(i), float(i * i % 7)]) for i in range(15)]
    d = [math.dist(a[2], b[2]) for a in vectors for b in vectors if a[1] < b[1]]
    got = learning.diversity(spark.createDataFrame(vectors, "label long, vec_id long, vec array<double>"), ["label"]).first()["diversity"]
    assert abs(got - sum(d) / len(d) / max(d)) < 1e-9


def test_mahalanobis_references_are_the_last(spark, sf):
    items = relation(spark, sf, "vectors")
    last = sorted(r[0] for r in items.select("vec_id").collect())[-500:]
    want = learning.mahalanobis_novelty(items, items.where(F.col("vec_id").isin(last))).select("vec_id", F.round("distance", 6).alias("d"))
    got = survey_queries.novelty_mahalanobis(spark, sf).select("vec_id", F.col("distance").alias("d"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_query_band_leaves_out_its_ends(spark):
    df = spark.createDataFrame([(1, 0.405), (2, 0.4051), (3, 0.595), (4, 0.5949)], "seq long, score double")
    assert {r["seq"] for r in learning.query_band(df, 21).collect()} == {2, 4}
