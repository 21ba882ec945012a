"""Images: reductions on the pixel relation (image_id, x, y, v) in DataFrame operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.stats import MAD_TO_SIGMA, clip

KEY = ["image_id"]


def normalise(pixels: DataFrame, method: str) -> DataFrame:
    """pixels with norm: arcsinh, log, linear (1st to 99th percentile) or zscale (median and two deviations)."""
    v = F.when(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf")), 0.0).otherwise(F.col("v"))
    clean = pixels.withColumn("v", v)
    if method == "arcsinh":
        own, out = [F.median(F.abs("v")).alias("m")], F.asinh(F.col("v") / F.nullif(F.col("m"), F.lit(0.0)))
    elif method == "log":
        own, out = [F.min("v").alias("m")], F.log1p(F.col("v") - F.col("m"))
    elif method == "linear":
        own = [F.percentile("v", F.array(F.lit(0.01), F.lit(0.99))).alias("m")]
        out = clip((F.col("v") - F.col("m")[0]) / F.nullif(F.col("m")[1] - F.col("m")[0], F.lit(0.0)))
    elif method == "zscale":
        own = [F.median("v").alias("m"), F.stddev_pop("v").alias("s")]
        out = clip((F.col("v") - F.col("m") + 2 * F.col("s")) / F.nullif(4 * F.col("s"), F.lit(0.0)))
    else:
        raise ValueError(method)
    return clean.join(clean.groupBy(*KEY).agg(*own), KEY).withColumn("norm", out).drop("m", "s")


def cutout(pixels: DataFrame, x0: int, y0: int, half: int) -> DataFrame:
    return pixels.where(F.col("x").between(x0 - half, x0 + half) & F.col("y").between(y0 - half, y0 + half)).withColumn("x", F.col("x") - (x0 - half)).withColumn("y", F.col("y") - (y0 - half))


def rgb(norm: Column) -> Column:
    return (clip(norm) * 255).cast("int")


def reference_stack(frames: DataFrame, least: int = 2) -> DataFrame:
    """The median over epochs of every pixel that least epochs cover: (image_id, x, y, ref, n_epochs)."""
    return frames.groupBy(*KEY, "x", "y").agg(F.median("v").alias("ref"), F.count("v").alias("n_epochs")).where(F.col("n_epochs") >= least)


def difference(frames: DataFrame, reference: DataFrame) -> DataFrame:
    return frames.join(reference, [*KEY, "x", "y"]).withColumn("diff", F.col("v") - F.col("ref"))


def difference_noise(diffs: DataFrame, least: int = 100) -> DataFrame:
    """Noise of each epoch's difference: the largest of the robust deviation, the RMS of the quietest 80 % and 1 % of the reference's deviation."""
    by = [*KEY, "epoch"]
    middle = diffs.groupBy(*by).agg(F.median("diff").alias("med"), F.count("*").alias("n"), F.stddev_pop("ref").alias("ref_std")).where(F.col("n") >= least)
    near = diffs.join(middle, by)
    order = Window.partitionBy(*by).orderBy(F.abs("diff"), "x", "y")
    quiet = F.row_number().over(order) <= F.floor(F.col("n") * 0.8)
    sums = near.withColumn("quiet", quiet).groupBy(*by, "n", "ref_std").agg(F.median(F.abs(F.col("diff") - F.col("med"))).alias("mad"), F.sqrt(F.avg(F.when(F.col("quiet"), F.col("diff") * F.col("diff")))).alias("rms80"))
    return sums.select(*by, "n", F.greatest(F.col("mad") * MAD_TO_SIGMA, F.coalesce("rms80", F.lit(0.0)), F.col("ref_std") * 0.01, F.lit(1e-6)).alias("noise"))


def residual_pixels(diffs: DataFrame, noise: DataFrame, threshold: float = 5.0) -> DataFrame:
    by = [*KEY, "epoch"]
    return diffs.join(noise.select(*by, "noise"), by).withColumn("snr", F.abs("diff") / F.col("noise")).where(F.col("snr") > threshold)


def label_pixels(pixels: DataFrame, by: list[str]) -> DataFrame:
    """pixels with label: 4-connected components within by, as one distributed component search over all images."""
    from skyloom.operators.spatial import components

    node = F.xxhash64(*by, "x", "y")
    own = pixels.withColumn("node", node)
    right = own.select(F.col("node").alias("a"), F.xxhash64(*by, F.col("x") + 1, "y").alias("b"))
    up = own.select(F.col("node").alias("a"), F.xxhash64(*by, "x", F.col("y") + 1).alias("b"))
    edges = right.union(up).join(own.select(F.col("node").alias("b")), "b", "left_semi")
    return own.join(components(edges.select("a", "b")).withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")


def residual_components(residuals: DataFrame) -> DataFrame:
    """Flux, peak, area, sign and weighted centre of each connected residual."""
    labelled = label_pixels(residuals, [*KEY, "epoch"])
    w = F.abs("diff")
    out = labelled.groupBy(*KEY, "epoch", "label").agg(F.sum("diff").alias("total_flux"), F.max("snr").alias("peak_snr"), F.count("*").alias("area"), (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy"))
    return out.withColumn("sign", F.when(F.col("total_flux") > 0, "positive").otherwise("negative"))


def residual_classes(residuals: DataFrame, by: list[str], mjd: str = "epoch") -> DataFrame:
    """The kind of change of each group of residuals: by signs, numbers of epochs and which came later."""
    pos, neg = F.col("sign") == "positive", F.col("sign") == "negative"
    days = lambda s: F.countDistinct(F.when(s, F.col(mjd)))
    mean_day = lambda s: F.expr(f"aggregate(collect_set(CASE WHEN sign = '{s}' THEN {mjd} END), 0D, (a, x) -> a + x) / nullif(size(collect_set(CASE WHEN sign = '{s}' THEN {mjd} END)), 0)")
    mean = lambda s, c: F.avg(F.when(s, F.col(c)))
    out = residuals.groupBy(*by).agg(
        F.count_if(pos).alias("n_pos"), F.count_if(neg).alias("n_neg"), days(pos).alias("d_pos"), days(neg).alias("d_neg"), mean_day("positive").alias("t_pos"), mean_day("negative").alias("t_neg"),
        (mean(pos, "cx") - mean(neg, "cx")).alias("dx"), (mean(pos, "cy") - mean(neg, "cy")).alias("dy"), F.max("peak_snr").alias("peak_snr"), F.countDistinct(mjd).alias("n_epochs"),
    )
    c = F.col
    both = (c("n_pos") > 0) & (c("n_neg") > 0)
    kind = (
        F.when(both & (c("t_pos") > c("t_neg")), F.when(c("d_pos") >= 2, "brightening").otherwise("new"))
        .when(both & (c("t_neg") > c("t_pos")), F.when(c("d_neg") >= 2, "fading").otherwise("disappeared"))
        .when(both, F.when(c("dx") * c("dx") + c("dy") * c("dy") > 1, "moving").otherwise("brightening"))
        .when(c("n_pos") > 0, F.when(c("d_pos") >= 2, "brightening").otherwise("new"))
        .otherwise(F.when(c("d_neg") >= 2, "fading").otherwise("disappeared"))
    )
    return out.withColumn("kind", kind).select(*by, "kind", "peak_snr", "n_epochs")


def temporal_scores(classes: DataFrame, by: list[str]) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    kinds = 0.3 * n("new") + 0.25 * n("moving") + 0.2 * n("brightening") + 0.15 * n("fading") + 0.1 * n("disappeared")
    score = 0.4 * clip(F.max("peak_snr") / 20) + 0.35 * F.least(kinds / 3, F.lit(1.0)) + 0.25 * F.least(F.count("*") / 10, F.lit(1.0))
    return classes.groupBy(*by).agg(clip(score).alias("temporal_score"))


def bright(pixels: DataFrame, percentile: float = 0.8) -> DataFrame:
    """Pixels above the percentile of their image."""
    cut = pixels.groupBy(*KEY).agg(F.percentile("v", F.lit(percentile)).alias("cut"))
    return pixels.join(cut, KEY).where(F.col("v") > F.col("cut")).drop("cut")


def moments(pixels: DataFrame) -> DataFrame:
    """Weighted centre and ellipticity of each image, from sums alone."""
    s = lambda e: F.sum(F.col("v") * e)
    x, y, c = F.col("x"), F.col("y"), F.col
    out = pixels.groupBy(*KEY).agg(F.sum("v").alias("m"), s(x).alias("mx"), s(y).alias("my"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy")).where("m <> 0")
    out = out.withColumn("cx", c("mx") / c("m")).withColumn("cy", c("my") / c("m"))
    xx, yy, xy = c("sxx") / c("m") - c("cx") * c("cx"), c("syy") / c("m") - c("cy") * c("cy"), c("sxy") / c("m") - c("cx") * c("cy")
    root = F.sqrt(F.greatest((xx + yy) * (xx + yy) - 4 * (xx * yy - xy * xy), F.lit(0.0)))
    one, two = (xx + yy + root) / 2, (xx + yy - root) / 2
    return out.select(*KEY, "cx", "cy", F.when(one > 0, 1 - F.sqrt(F.greatest(two, F.lit(0.0)) / one)).otherwise(F.lit(0.0)).alias("ellipticity"))


def gini(pixels: DataFrame) -> DataFrame:
    i = F.row_number().over(Window.partitionBy(*KEY).orderBy("a", "x", "y"))
    own = pixels.withColumn("a", F.abs("v")).withColumn("i", i).groupBy(*KEY).agg(F.sum(F.col("i") * F.col("a")).alias("ranked"), F.sum("a").alias("total"), F.count("*").alias("n"))
    return own.where("n >= 2 and total > 0").select(*KEY, (2 * F.col("ranked") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def m20(pixels: DataFrame) -> DataFrame:
    """Log share of the second moment in the brightest fifth of the light."""
    centre = moments(pixels).select(*KEY, "cx", "cy")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    order = Window.partitionBy(*KEY).orderBy(F.col("v").desc(), "x", "y")
    before = F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    own = pixels.join(centre, KEY).withColumn("moment", F.col("v") * (dx * dx + dy * dy)).withColumn("before", before).withColumn("total", F.sum("v").over(Window.partitionBy(*KEY)))
    sums = own.groupBy(*KEY).agg(F.sum(F.when(F.col("before") < 0.2 * F.col("total"), F.col("moment"))).alias("top"), F.sum("moment").alias("all")).where("all <> 0")
    return sums.select(*KEY, F.log10(F.greatest(F.col("top") / F.col("all"), F.lit(1e-20))).alias("m20"))


def concentration(pixels: DataFrame) -> DataFrame:
    """Five times the log ratio of the radii that hold 80 % and 20 % of the light."""
    centre = moments(pixels).select(*KEY, "cx", "cy")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    own = pixels.join(centre, KEY).withColumn("r", F.sqrt(dx * dx + dy * dy))
    order = Window.partitionBy(*KEY).orderBy("r", "x", "y").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("v").over(order) / F.sum("v").over(Window.partitionBy(*KEY))
    radii = own.withColumn("share", share).groupBy(*KEY).agg(F.min(F.when(F.col("share") >= 0.2, F.col("r"))).alias("r20"), F.min(F.when(F.col("share") >= 0.8, F.col("r"))).alias("r80"))
    return radii.select(*KEY, F.when(F.col("r20") > 0, 5 * F.log10(F.greatest(F.col("r80") / F.col("r20"), F.lit(1.0)))).otherwise(F.lit(0.0)).alias("concentration"))


def asymmetry(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Half the share of light that a half turn doesn't bring to itself; absent pixels are 0, so the join is a union and a sum."""
    both = pixels.select(*KEY, "x", "y", "v", F.lit(0.0).alias("r")).unionByName(pixels.select(*KEY, (F.lit(width - 1) - F.col("x")).alias("x"), (F.lit(height - 1) - F.col("y")).alias("y"), F.lit(0.0).alias("v"), F.col("v").alias("r")))
    own = both.groupBy(*KEY, "x", "y").agg(F.sum("v").alias("v"), F.sum("r").alias("r"))
    return own.groupBy(*KEY).agg(F.sum(F.abs(F.col("v") - F.col("r"))).alias("d"), F.sum(F.abs("v")).alias("t")).where("t > 0").select(*KEY, (F.col("d") / (2 * F.col("t"))).alias("asymmetry"))


def smoothness(pixels: DataFrame, sigma: float = 3.0) -> DataFrame:
    """Share of light that a Gaussian takes away; each pixel adds to its neighbours within four deviations, weights renormalised at edges."""
    reach = int(4 * sigma + 0.5)
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    spread = pixels.select(*KEY, F.col("x").alias("sx"), F.col("y").alias("sy"), "v").withColumn("i", F.explode(offsets)).withColumn("j", F.explode(offsets))
    w = F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) / (2 * sigma * sigma))
    smooth = spread.withColumn("w", w).groupBy(*KEY, (F.col("sx") + F.col("i")).alias("x"), (F.col("sy") + F.col("j")).alias("y")).agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("smooth"))
    own = pixels.join(smooth, [*KEY, "x", "y"])
    return own.groupBy(*KEY).agg(F.sum(F.abs(F.col("v") - F.col("smooth"))).alias("d"), F.sum(F.abs("v")).alias("t")).where("t > 0").select(*KEY, (F.col("d") / F.col("t")).alias("smoothness"))


def morphology(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Concentration, asymmetry, smoothness, Gini, M20, ellipticity and morphology_score of each image; bright pixels for all but asymmetry and smoothness."""
    top = bright(pixels)
    out = moments(top).join(gini(top), KEY).join(m20(top), KEY).join(concentration(top), KEY).join(asymmetry(pixels, width, height), KEY).join(smoothness(pixels), KEY)
    c = F.col
    score = 0.3 * F.least(c("asymmetry") * 3, F.lit(1.0)) + 0.25 * c("gini") + 0.2 * c("smoothness") + 0.15 * F.abs(c("concentration") - 3) / 3 + 0.1 * c("ellipticity")
    return out.withColumn("morphology_score", clip(score))


def radial_profile(pixels: DataFrame, x0: float, y0: float) -> DataFrame:
    dx, dy = F.col("x") - x0, F.col("y") - y0
    return pixels.groupBy(*KEY, F.floor(F.sqrt(dx * dx + dy * dy)).cast("int").alias("radius")).agg(F.avg("v").alias("mean_v"), F.count("*").alias("n"))


def density_grid(points: DataFrame, width: float, height: float, grid: int = 8, by: str = "image_id") -> DataFrame:
    at = lambda c, size: F.least(F.floor(F.col(c) / size * grid), F.lit(grid - 1)).cast("int")
    return points.groupBy(by, at("y", height).alias("row"), at("x", width).alias("col")).agg(F.count("*").alias("n"))


def lens_arcs(pixels: DataFrame, centres: DataFrame, rms: DataFrame, inner: int = 5, outer: int = 14, step: int = 5, width: int = 4, least: int = 4, snr: float = 2.0, most: int = 10) -> DataFrame:
    """Bright sectors of 60 degrees, starting every 30, in rings around each image's centre (x0, y0, peak, radius): a pixel joins its rings and sectors by explode, and one aggregate sums them."""
    dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    r = F.sqrt(dx * dx + dy * dy)
    near = pixels.join(centres, KEY).withColumn("r", r).withColumn("theta", F.atan2(dy, dx)).withColumn("residual", F.col("v") - F.col("peak") * F.exp(-0.5 * F.pow(F.col("r") / F.greatest(F.col("radius"), F.lit(1.0)), 2)))
    rings = F.array(*[F.lit(k) for k in range(inner, outer, step)])
    near = near.withColumn("ring", F.explode(F.filter(rings, lambda k: (F.col("r") >= k) & (F.col("r") < k + width))))
    start = lambda k: k * (math.pi / 6) - math.pi
    sectors = F.array(*[F.lit(k) for k in range(12)])
    near = near.withColumn("sector", F.explode(F.filter(sectors, lambda k: (F.col("theta") >= start(k)) & (F.col("theta") < start(k) + math.pi / 3))))
    sums = near.groupBy(*KEY, "ring", "sector").agg(F.avg("residual").alias("mean_flux"), F.count("*").alias("n_pixels")).where(F.col("n_pixels") >= least)
    found = sums.join(rms, KEY).withColumn("snr", F.col("mean_flux") / F.greatest("rms", F.lit(1e-10))).where(F.col("snr") > snr).drop("rms")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("snr").desc(), "ring", "sector"))).where(F.col("rank") <= most)


def coadd(pixels: DataFrame, grids: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """Images brought to one grid of square pixels and added: (x, y, flux, weight, mean, n_images).

    grids has for each image the place of its first pixel's corner (gx, gy) and its pixel's sides (dx, dy, negative where an
    axis runs backwards). A pixel's footprint goes to the pixels that it overlaps, as a join of its rows to
    themselves would, with the shares of its area as weights: flux adds up to the images' flux, weight is the area
    covered in new pixels, and mean the overlapping brightness a unit of area. Axes of images and grid are parallel.
    Null and NaN pixels are left out.
    """
    own = pixels.where(F.col("v").isNotNull() & ~F.isnan("v")).join(grids, KEY)
    for c, low in (("x", x0), ("y", y0)):
        a, b = (F.col(f"g{c}") + (F.col(c) + k) * F.col(f"d{c}") - low for k in (0, 1))
        own = own.withColumns({f"_{c}a": F.least(a, b) / size, f"_{c}b": F.greatest(a, b) / size})
    cells = lambda c: F.explode(F.sequence(F.floor(f"_{c}a"), F.greatest(F.ceil(f"_{c}b") - 1, F.floor(f"_{c}a"))))
    over = lambda c: F.least(F.col(f"_{c}b"), F.col(f"_{c}") + 1) - F.greatest(F.col(f"_{c}a"), F.col(f"_{c}"))
    near = own.withColumn("_x", cells("x")).withColumn("_y", cells("y")).withColumn("area", over("x") * over("y")).where("area > 0")
    bright = F.col("v") / ((F.col("_xb") - F.col("_xa")) * (F.col("_yb") - F.col("_ya")))
    sums = near.groupBy(F.col("_x").alias("x"), F.col("_y").alias("y")).agg(F.sum(bright * F.col("area")).alias("flux"), F.sum("area").alias("weight"), F.countDistinct(*KEY).alias("n_images"))
    return sums.select("x", "y", "flux", "weight", (F.col("flux") / F.col("weight")).alias("mean"), "n_images")


def mask_algebra(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """and, or, xor of two masks of 0 and 1; absent pixels are 0."""
    both = left.select(*KEY, "x", "y", F.col("mask").alias("a"), F.lit(0).alias("b")).unionByName(right.select(*KEY, "x", "y", F.lit(0).alias("a"), F.col("mask").alias("b")))
    own = both.groupBy(*KEY, "x", "y").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    rule = {"and": F.least("a", "b"), "or": F.greatest("a", "b"), "xor": F.abs(F.col("a") - F.col("b"))}[how]
    return own.select(*KEY, "x", "y", rule.cast("int").alias("mask"))


def sersic(r: Column, n: Column, r_e: Column, i_e: Column) -> Column:
    """Brightness at radius r of a profile of index n."""
    b = F.greatest(1.9992 * n - 0.3271, F.lit(0.01))
    return i_e * F.exp(-b * (F.pow(F.greatest(r, F.lit(0.0)) / F.greatest(r_e, F.lit(1e-6)), 1 / n) - 1))


def inject_ring(pixels: DataFrame, x0: float, y0: float, radius: float, width: float, brightness: float) -> DataFrame:
    dx, dy = F.col("x") - x0, F.col("y") - y0
    off = (F.sqrt(dx * dx + dy * dy) - radius) / width
    return pixels.withColumn("v", F.col("v") + F.when(F.abs(off) < 3, brightness * F.exp(-0.5 * off * off)).otherwise(0.0))
