"""Confidence of anomalies by detector: each detector's own measure as a tail probability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.pvalues import binomial_sf, chi2_sf, chi2_sf_even, normal_sf, normal_sf_two_sided, poisson_sf

#: Rates of red giants and blue stragglers in the field.
GIANT_RATE, STRAGGLER_RATE = 0.05, 0.01


def score_proxy(score: Column) -> Column:
    """The p-value that stands for a score where nothing better is known."""
    return F.greatest(1 - score, F.lit(1e-15))


def first_of(properties: Column, *names: str, default: Column | float = 0.0) -> Column:
    """The first property that is there."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(*[F.try_element_at(properties, F.lit(n)) for n in names], default)


def case(pairs: list[tuple[Column, Column]], default: Column) -> Column:
    return reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), reversed(pairs), default)


def confidences(anomalies: DataFrame, properties: str = "properties") -> DataFrame:
    """anomalies (detector, anomaly_type, score, properties: map of doubles) with p_value, p_corrected, confidence, quantity and method.

    Every tail is one column over all detectors: rows that it doesn't concern hold null there, so a batch passes each
    Arrow function once. A measure of 0 or less gives way to the score.
    """
    c, of = F.col, lambda *names, default=0.0: first_of(F.col(properties), *names, default=default)
    score, kind, detector = c("score"), c("anomaly_type"), c("detector")
    is_ = lambda *names: detector.isin(*names)
    or_score = lambda x: F.when(x <= 0, score).otherwise(x)
    ring = (kind == "lens_ring") & (of("completeness") > 0) & (of("snr") <= 0)
    votes, gabor = of("hough_votes", "votes", "strength"), of("gabor_energy")
    hough = is_("classical") & (votes > gabor)
    members, field = of("n_members"), of("expected_field", default=1.0)
    grouped = is_("kinematic") & (members > 0) & (field > 0)
    moving = is_("kinematic") & (members > 0) & (field <= 0)
    residual, chi2 = of("residual_snr", "peak_snr"), of("chi2_reduced")
    varied = of("chi2_variability", "chi2_reduced")
    fap = F.try_element_at(c(properties), F.lit("fap"))
    periodic = is_("variability") & (kind == "periodic_variable") & fap.isNotNull()
    excess = is_("variability") & ~periodic & (varied > 1)
    epochs = F.greatest(of("n_epochs", default=10.0).cast("int") - 1, F.lit(1))
    giant = is_("population") & (kind == "red_giant")
    straggler = is_("population") & (kind != "red_giant")
    coloured = of("n_sources_with_color")
    pool = F.when(giant | (coloured != 0), coloured).otherwise(of("n_blue_stragglers"))
    share = of("bs_fraction")
    blue = of("n_blue_stragglers", default=F.greatest(F.lit(1.0), F.floor(share * pool).cast("double")))
    giants, few = giant & (of("n_red_giants") > 0) & (pool >= 5), straggler & (share > 0) & (pool >= 5)
    z = {k: F.try_element_at(c(properties), F.lit(k)) for k in ("C_zscore", "A_zscore", "S_zscore", "gini_zscore")}
    told = F.filter(F.array(*[F.nullif(x, F.lit(0.0)) for x in z.values()]), lambda x: x.isNotNull())

    sigma = case([
        (is_("lens") & ring, of("completeness") * 5),
        (is_("lens"), or_score(of("snr"))),
        (is_("distribution"), or_score(of("sigma", "significance", default=score))),
        (is_("galaxy") & (kind == "merger"), or_score(of("asymmetry_sigma", "asymmetry", default=score))),
        (is_("galaxy"), or_score(of("tidal_snr", "strength", default=score))),
        (is_("wavelet"), or_score(of("peak_snr", "peak_significance", "max_significance", default=score))),
        (is_("classical") & ~hough, gabor),
        (is_("sersic") & (residual > 0), residual),
        (is_("temporal"), or_score(of("peak_snr", default=score))),
    ], F.lit(None).cast("double"))
    two_sided = case([(is_("transient"), or_score(of("deviation_sigma", "deviation", default=score))), (moving, F.greatest(of("deviation_sigma", default=score), F.lit(0.0)))], F.lit(None).cast("double"))
    spread = case([(is_("sersic") & (chi2 > 1), F.struct((chi2 * of("n_pixels", default=100.0)).alias("x"), of("n_pixels", default=100.0).alias("dof"))), (excess, F.struct((varied * epochs).alias("x"), epochs.cast("double").alias("dof")))], F.lit(None).cast("struct<x: double, dof: double>"))
    out = anomalies.withColumn("_sigma", sigma).withColumn("_two", two_sided).withColumn("_chi2", spread).withColumn("_z", told)
    out = out.withColumn("_normal", normal_sf("_sigma")).withColumn("_sides", normal_sf_two_sided("_two")).withColumn("_spread", chi2_sf(c("_chi2.x"), c("_chi2.dof")))
    for k, name in enumerate(z):
        out = out.withColumn(f"_z{k}", normal_sf_two_sided(F.when(is_("morphology"), F.nullif(z[name], F.lit(0.0)))))
    fisher = -2 * sum((F.when(c(f"_z{k}").isNotNull(), F.log(F.greatest(c(f"_z{k}"), F.lit(1e-300)))).otherwise(0.0) for k in range(len(z))), F.lit(0.0))
    shaped = is_("morphology") & (F.size("_z") > 0)
    normal, known = c("_normal"), F.coalesce(c("_spread"), F.lit(1.0))
    residual_p = F.coalesce(normal, F.lit(1.0))
    by_residual = is_("sersic") & (residual_p < known)
    fit_p = F.least(residual_p, known)
    fallback = F.when(score > 0, score_proxy(score)).otherwise(1.0)
    rules = [
        (shaped, chi2_sf_even(fisher, F.size("_z")), "Fisher_chi2", "fisher_combined"),
        (is_("morphology"), score_proxy(score), "morphology_score", "score_proxy"),
        (is_("lens") & ring, normal, "completeness", "gaussian_sf"),
        (is_("lens", "wavelet", "temporal") | (is_("galaxy") & (kind != "merger")), normal, "SNR", "gaussian_sf"),
        (is_("distribution", "galaxy"), normal, "sigma", "gaussian_sf"),
        (hough, poisson_sf(F.greatest(F.floor(votes), F.lit(1)), F.greatest(votes * 0.1, F.lit(1.0))), "Hough_votes", "poisson_cdf"),
        (is_("classical"), normal, "gabor_energy", "gaussian_sf"),
        (grouped, poisson_sf(F.greatest(F.floor(members), F.lit(1)), field), "n_members", "poisson_cdf"),
        (moving, c("_sides"), "n_members", "gaussian_sf"),
        (is_("kinematic"), score_proxy(score), "sigma", "gaussian_sf"),
        (is_("transient"), c("_sides"), "sigma", "gaussian_sf_twotailed"),
        (is_("sersic") & (fit_p >= 1), fallback, "score", "chi2_sf"),
        (by_residual, fit_p, "SNR", "gaussian_sf"),
        (is_("sersic"), fit_p, "chi2_reduced", "chi2_sf"),
        (giants, binomial_sf(F.greatest(of("n_red_giants"), F.lit(1.0)), pool, GIANT_RATE), "rgb_fraction", "binomial_sf"),
        (giant, fallback, "rgb_fraction", "binomial_sf"),
        (few, binomial_sf(F.greatest(blue, F.lit(1.0)), pool, STRAGGLER_RATE), "bs_fraction", "binomial_sf"),
        (straggler, fallback, "bs_fraction", "binomial_sf"),
        (periodic, fap, "FAP", "lomb_scargle_fap"),
        (excess, known, "chi2_reduced", "chi2_sf"),
        (is_("variability"), fallback, "score", "score_proxy"),
        (is_("anomaly"), score_proxy(score), "IF_score", "empirical_rank"),
    ]
    choose = lambda k, default: case([(r[0], r[k] if isinstance(r[k], Column) else F.lit(r[k])) for r in rules], default)
    tests = case([(is_("distribution"), of("n_grid_cells", default=100.0)), (is_("wavelet"), F.greatest(of("n_scales", default=1.0), F.lit(4.0)))], F.lit(1.0))
    out = out.withColumn("p_value", choose(1, fallback)).withColumn("p_corrected", F.least(c("p_value") * tests, F.lit(1.0)))
    by_score = is_("anomaly") | (is_("morphology") & ~shaped)
    known_detector = is_("lens", "distribution", "galaxy", "morphology", "wavelet", "classical", "kinematic", "transient", "sersic", "population", "variability", "temporal", "anomaly")
    sure = F.when(by_score, score).when(known_detector, 1 - c("p_corrected")).otherwise(F.least(score, F.lit(1.0)))
    out = out.withColumn("confidence", sure).withColumn("quantity", choose(2, F.lit("score"))).withColumn("method", choose(3, F.lit("score_proxy")))
    return out.select(*anomalies.columns, "p_value", "p_corrected", "confidence", "quantity", "method")


def by_confidence(anomalies: DataFrame, most: int = 20, order: str = "seq") -> DataFrame:
    """The first rows by confidence, by score where there is none; ties keep their order. Top-k without a full sort."""
    return anomalies.orderBy(F.coalesce("confidence", "score").desc(), order).limit(most)
