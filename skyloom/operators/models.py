"""Feature vectors, isolation forests, the learned detector and the genetic search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.operators.kernels import run_pipeline

#: The features in their order: section, name, and the value that stands for a missing one.
FEATURES: list[tuple[str, str, float]] = [
    ("sources", "n_sources", 0.0),
    ("sources", "mean_flux", 0.0),
    ("sources", "flux_std", 0.0),
    ("sources", "spatial_concentration", 0.0),
    ("sources", "ellipticity_mean", 0.0),
    ("classical", "gabor_score", 0.0),
    ("classical", "fft_score", 0.0),
    ("classical", "arc_score", 0.0),
    ("classical", "n_arcs", 0.0),
    ("classical", "dominant_frequency", 0.0),
    ("classical", "dominant_orientation", 0.0),
    ("morphology", "concentration", 0.0),
    ("morphology", "asymmetry", 0.0),
    ("morphology", "smoothness", 0.0),
    ("morphology", "gini", 0.0),
    ("morphology", "m20", 0.0),
    ("morphology", "morphology_score", 0.0),
    ("lens", "lens_score", 0.0),
    ("lens", "n_arcs", 0.0),
    ("lens", "n_rings", 0.0),
    ("lens", "arc_coverage", 0.0),
    ("lens", "is_candidate", 0.0),
    ("distribution", "distribution_score", 0.0),
    ("distribution", "voronoi_cv", 0.0),
    ("distribution", "clark_evans_r", 1.0),
    ("distribution", "n_overdensities", 0.0),
    ("galaxy", "galaxy_score", 0.0),
    ("galaxy", "n_tidal", 0.0),
    ("galaxy", "n_mergers", 0.0),
    ("galaxy", "n_color_outliers", 0.0),
    ("kinematic", "kinematic_score", 0.0),
    ("kinematic", "n_comoving_groups", 0.0),
    ("kinematic", "n_streams", 0.0),
    ("kinematic", "n_runaways", 0.0),
    ("transient", "transient_score", 0.0),
    ("transient", "n_astrometric", 0.0),
    ("transient", "n_photometric", 0.0),
    ("transient", "n_parallax", 0.0),
    ("sersic", "sersic_score", 0.0),
    ("sersic", "sersic_n", 0.0),
    ("sersic", "r_e", 0.0),
    ("sersic", "ellipticity", 0.0),
    ("sersic", "n_residual_features", 0.0),
    ("wavelet", "wavelet_score", 0.0),
    ("wavelet", "n_detections", 0.0),
    ("wavelet", "n_multiscale", 0.0),
    ("wavelet", "mean_scale", 0.0),
    ("population", "population_score", 0.0),
    ("population", "n_blue_stragglers", 0.0),
    ("population", "n_red_giants", 0.0),
    ("population", "multiple_populations", 0.0),
    ("variability", "variability_score", 0.0),
    ("variability", "n_variables", 0.0),
    ("variability", "n_periodic", 0.0),
    ("variability", "n_transients", 0.0),
    ("temporal", "temporal_score", 0.0),
    ("temporal", "n_new_sources", 0.0),
    ("temporal", "n_disappeared", 0.0),
    ("temporal", "n_brightenings", 0.0),
    ("temporal", "n_moving", 0.0),
    ("temporal", "baseline_days", 0.0),
    ("anomaly", "anomaly_score", 0.0),
    ("top", "anomaly_score", 0.0),
    ("top", "embedding_anomaly_score", 0.5),
    ("top", "composed_score", 0.0),
]


def feature_vector(df: DataFrame) -> list[Column]:
    """A double for each feature of FEATURES from struct columns named by section; absent sections and fields, null, NaN and infinities give the default or 0."""
    out = []
    for section, name, default in FEATURES:
        field = None
        if section in df.columns and isinstance(kind := df.schema[section].dataType, T.StructType) and name in kind.names:
            field = F.col(f"`{section}`.`{name}`").cast("double")
        if field is None:
            out.append(F.lit(default))
        else:
            out.append(F.when(field.isNull(), default).when(F.isnan(field) | (F.abs(field) == float("inf")), 0.0).otherwise(field))
    return out


def _grow(rows: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    if depth == 0 or len(rows) <= 1:
        return (len(rows),)
    spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0))
    if not len(spread):
        return (len(rows),)
    j = int(rng.choice(spread))
    cut = float(rng.uniform(rows[:, j].min(), rows[:, j].max()))
    low = rows[:, j] < cut
    return (j, cut, _grow(rows[low], depth - 1, rng), _grow(rows[~low], depth - 1, rng))


def _expected(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree: tuple, rows: np.ndarray, at: np.ndarray, depth: int, out: np.ndarray) -> None:
    if len(tree) == 1:
        out[at] += depth + _expected(tree[0])
        return
    low = rows[at, tree[0]] < tree[1]
    _depths(tree[2], rows, at[low], depth + 1, out)
    _depths(tree[3], rows, at[~low], depth + 1, out)


def isolation_scores(items: DataFrame, id_col: str, features: str, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, anomaly_score): a forest grown on the driver from trees * sample rows at most, chosen by hash, and applied in Arrow batches.

    Fewer than ten rows get their distance from the mean over the greatest one.
    """
    chosen = items.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(trees * sample).select(features).collect()
    rows = np.array([r[0] for r in chosen], float)
    schema = T.StructType([T.StructField(id_col, items.schema[id_col].dataType), T.StructField("anomaly_score", T.DoubleType())])
    if len(rows) < 10:
        mean = rows.mean(axis=0).tolist() if len(rows) else []
        gap = F.sqrt(F.aggregate(F.zip_with(features, F.array(*[F.lit(x) for x in mean]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        far = items.select(id_col, gap.alias("d"))
        return far.crossJoin(F.broadcast(far.agg(F.max("d").alias("m")))).select(id_col, F.coalesce(F.col("d") / F.nullif(F.col("m"), F.lit(0.0)), F.lit(0.0)).alias("anomaly_score"))
    rng = np.random.default_rng(seed)
    mean, std = rows.mean(axis=0), np.where(rows.std(axis=0) > 1e-12, rows.std(axis=0), 1.0)
    unit, size = (rows - mean) / std, min(sample, len(rows))
    forest = [_grow(unit[rng.choice(len(unit), size, replace=False)], int(np.ceil(np.log2(size))), rng) for _ in range(trees)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = (np.array(batch[features].tolist(), float) - mean) / std
            depth = np.zeros(len(x))
            for tree in forest:
                _depths(tree, x, np.arange(len(x)), 0, depth)
            yield pd.DataFrame({id_col: batch[id_col], "anomaly_score": 2 ** (-depth / trees / _expected(size))})

    return items.select(id_col, features).mapInPandas(run, schema)


def meta_scores(samples: DataFrame, id_col: str, features: str, label: str, least_gbm: int = 50, least_nn: int = 200) -> DataFrame:
    """(id, learned_score) of the learned detector: a neural net from least_nn labelled rows on, boosted trees from least_gbm on, else the mean of the features."""
    from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = samples.select(id_col, array_to_vector(features).alias("raw"), F.col(label).cast("double").alias("label"), F.col(features).alias("values"))
    n = own.where("label is not null").count()
    if n < least_gbm:
        return samples.select(id_col, (F.aggregate(features, F.lit(0.0), lambda s, x: s + x) / F.size(features)).alias("learned_score"))
    own = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(own).transform(own)
    known = own.where("label is not null")
    if n >= least_nn:
        width = len(known.first()["values"])
        model = MultilayerPerceptronClassifier(layers=[width, 64, 32, 2], maxIter=60, seed=42).fit(known)
    else:
        model = GBTClassifier(maxDepth=3, maxIter=20, seed=42).fit(known)
    return model.transform(own).select(id_col, vector_to_array("probability")[1].alias("learned_score"))


#: Genes as name, least, greatest and kind.
GENES: list[tuple[str, float, float, str]] = [
    ("subtract_sigma", 2.0, 8.0, "float"), ("smooth_sigma", 0.5, 3.0, "float"), ("wavelet_scale", 0, 3, "int"), ("threshold_sigma", 2.0, 6.0, "float"), ("use_wavelet", 0, 1, "bool"), ("use_edges", 0, 1, "bool"),
]


def _clip(genes: np.ndarray) -> np.ndarray:
    low, high = np.array([g[1] for g in GENES]), np.array([g[2] for g in GENES])
    out = np.clip(genes, low, high)
    whole = np.array([g[3] == "int" for g in GENES])
    return np.where(whole, np.rint(out), out)


def decode(genes: np.ndarray) -> list[tuple[str, dict]]:
    """The pipeline that a genome stands for."""
    g = dict(zip([x[0] for x in GENES], genes, strict=True))
    steps: list[tuple[str, dict]] = [("subtract_model", {"sigma": float(g["subtract_sigma"])}), ("convolve_kernel", {"sigma": float(g["smooth_sigma"])})]
    if g["use_wavelet"] >= 0.5:
        steps.append(("wavelet_residual", {"scale": int(g["wavelet_scale"])}))
    if g["use_edges"] >= 0.5:
        steps.append(("edge_detect", {}))
    return [*steps, ("threshold_image", {"sigma": float(g["threshold_sigma"])})]


def fitness(images: DataFrame, genomes: list[np.ndarray]) -> list[float]:
    """Mean score of each genome's pipeline over all images: images stay where they are, and genomes, a driver's handful, go to them."""
    specs = [(decode(g)) for g in genomes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, w, data in zip(batch["height"], batch["width"], batch["data"], strict=True):
                a = np.asarray(data, float).reshape(h, w)
                yield pd.DataFrame([(k, run_pipeline(a, s, "area_fraction")[0]) for k, s in enumerate(specs)], columns=["genome", "score"])

    found = {r["genome"]: r["s"] for r in images.mapInPandas(run, "genome int, score double").groupBy("genome").agg(F.avg("score").alias("s")).collect()}
    return [found.get(k, 0.0) for k in range(len(genomes))]


def evolve(images: DataFrame, population: int = 30, generations: int = 10, elite: int = 2, tournament: int = 3, rate: float = 0.2, seed: int = 42) -> DataFrame:
    """Best, mean and spread of fitness by generation: elitism, tournaments, two-point crossover, mutation by a tenth of the range.

    The mutation rate falls while the best improves and rises after three generations without.
    """
    rng = np.random.default_rng(seed)
    low, high = np.array([g[1] for g in GENES], float), np.array([g[2] for g in GENES], float)
    genomes, rows, best, still = [_clip(rng.uniform(low, high)) for _ in range(population)], [], -1.0, 0
    for generation in range(generations):
        scores = np.array(fitness(images, genomes))
        rows.append((generation, float(scores.max()), float(scores.mean()), float(scores.std()), rate))
        still = 0 if scores.max() > best + 1e-9 else still + 1
        best = max(best, float(scores.max()))
        rate = max(0.05, rate * 0.9) if still == 0 else min(0.5, rate * 1.2) if still >= 3 else rate
        order = np.argsort(-scores, kind="stable")
        pick = lambda: genomes[min(rng.choice(population, min(tournament, population), replace=False), key=lambda i: -scores[i])]
        new = [genomes[i] for i in order[:elite]]
        while len(new) < population:
            a, b = pick(), pick()
            i, j = sorted(rng.choice(len(GENES) + 1, 2, replace=False))
            child = np.concatenate([a[:i], b[i:j], a[j:]])
            child = np.where(rng.random(len(GENES)) < rate, child + rng.normal(0, 0.1 * (high - low)), child)
            new.append(_clip(child))
        genomes = new
    return images.sparkSession.createDataFrame(rows, "generation int, best double, mean double, std double, mutation_rate double")
