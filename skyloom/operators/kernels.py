"""Image kernels in NumPy, one image a row through Arrow batches: filters, labels, wavelets, transforms, fits and composed pipelines."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAYS = "image_id string, height int, width int, data array<double>"


def to_arrays(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, height, width, data) in rows of pixels; absent pixels are 0. An image is a bounded group."""
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("k"), "v")
    grouped = pixels.groupBy(F.col("image_id").cast("string").alias("image_id")).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    data = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return grouped.select("image_id", F.lit(height).alias("height"), F.lit(width).alias("width"), data.alias("data"))


def per_image(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """The rows that kernel makes of each image, behind its image_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["image_id", *[x.strip().split()[0] for x in schema.split(",")]]
        for batch in batches:
            rows = [(i, *row) for i, h, w, data in zip(batch["image_id"], batch["height"], batch["width"], batch["data"], strict=True) for row in kernel(np.nan_to_num(np.asarray(data, float), posinf=0, neginf=0).reshape(h, w))]
            yield pd.DataFrame(rows, columns=names)

    return images.select("image_id", "height", "width", "data").mapInPandas(run, f"image_id string, {schema}")


def convolve_axis(a: np.ndarray, taps: np.ndarray, axis: int, spacing: int = 1) -> np.ndarray:
    """Convolution with symmetric taps along an axis, edges reflected (half-sample symmetric)."""
    half = len(taps) // 2
    n = a.shape[axis]
    at = np.arange(n)
    out = np.zeros_like(a)
    for k, t in enumerate(taps):
        i = np.mod(at + (k - half) * spacing, 2 * n)
        out += t * np.take(a, np.where(i < n, i, 2 * n - 1 - i), axis=axis)
    return out


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, int(4 * sigma + 0.5))
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    return convolve_axis(convolve_axis(a, taps, 0), taps, 1)


def gradient(a: np.ndarray) -> np.ndarray:
    """Sobel magnitude."""
    smooth, step = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return np.hypot(convolve_axis(convolve_axis(a, smooth, 0), step, 1), convolve_axis(convolve_axis(a, smooth, 1), step, 0))


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components: numbers by least pixel, spread along whole runs until nothing changes."""
    n = mask.size
    lab = np.where(mask, np.arange(1, n + 1).reshape(mask.shape), 0)
    while True:
        before = lab.copy()
        for axis in (0, 1):
            for flip in (False, True):
                view = np.flip(lab, axis) if flip else lab
                view = np.moveaxis(view, axis, 0)
                run = np.full(view.shape[1], n + 1)
                for row in view:  # a view: writes reach lab
                    run = np.where(row > 0, np.minimum(run, np.where(row > 0, row, n + 1)), n + 1)
                    row[:] = np.where(row > 0, run, 0)
        if (lab == before).all():
            break
    found = np.unique(lab[lab > 0])
    return np.searchsorted(found, lab, side="left") * (lab > 0) + (lab > 0), len(found)


def mad_sigma(a: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(a - np.median(a))))


# wavelets


def planes(a: np.ndarray, scales: int) -> list[np.ndarray]:
    """À-trous planes with the B3 spline and the smooth rest; their sum is the image."""
    taps, out = np.array([1, 4, 6, 4, 1]) / 16, []
    for j in range(scales):
        smooth = convolve_axis(convolve_axis(a, taps, 0, 2**j), taps, 1, 2**j)
        out.append(a - smooth)
        a = smooth
    return [*out, a]


def wavelet_objects(a: np.ndarray, scales: int = 4, threshold: float = 3.0, least: int = 3, most: int = 10) -> list[tuple]:
    """(scale, x, y, significance, area, n_scales) of connected significant regions, each matched greedily across scales."""
    from skyloom.operators.spatial import greedy_matches

    rows = []
    for j, plane in enumerate(planes(a, scales)[:-1]):
        noise = mad_sigma(plane) or float(plane.std())
        if noise < 1e-10:
            continue
        lab, n = label(np.abs(plane) > threshold * noise)
        own = []
        for k in range(1, n + 1):
            y, x = np.nonzero(lab == k)
            if len(y) >= least:
                w = np.abs(plane[y, x])
                own.append((j, float((x * w).sum() / w.sum()), float((y * w).sum() / w.sum()), float(w.max() / noise), len(y)))
        rows += sorted(own, key=lambda r: -r[3])[:most]
    rows.sort(key=lambda r: (-r[3], r[0], r[1], r[2]))
    frame = pd.DataFrame(rows, columns=["scale", "x", "y", "significance", "area"])
    groups = greedy_matches(frame, lambda own, other: np.maximum(2 * 2.0**other, 5)) if rows else []
    return [(*rows[g[0]], len(g)) for g in groups]


def wavelets(images: DataFrame, scales: int = 4, threshold: float = 3.0) -> DataFrame:
    return per_image(images, lambda a: wavelet_objects(a, scales, threshold), "scale int, x double, y double, significance double, area int, n_scales int")


# classical transforms


def gabor_score(a: np.ndarray, frequencies=(0.05, 0.1, 0.2, 0.4), orientations: int = 8) -> tuple[float, float, float]:
    """Best mean response relative to the spread of the image, with its frequency and orientation."""
    best = (-1.0, 0.0, 0.0)
    scale = a.std() or 1.0
    spectrum = np.fft.rfft2(a - a.mean())
    fy, fx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.rfftfreq(a.shape[1])[None, :]
    for f in frequencies:
        for k in range(orientations):
            t = math.pi * k / orientations
            u, v = fx * math.cos(t) + fy * math.sin(t), -fx * math.sin(t) + fy * math.cos(t)
            band = np.exp(-0.5 * (((np.abs(u) - f) / (0.3 * f)) ** 2 + (v / (0.3 * f)) ** 2))
            r = float(np.abs(np.fft.irfft2(spectrum * band, s=a.shape)).mean() / scale)
            if r > best[0]:
                best = (r, f, t)
    return min(1.0, best[0]), best[1], best[2]


def dominant_frequency(a: np.ndarray) -> float:
    """The radius of the radial power profile's peak beside the origin, in cycles a pixel."""
    power = np.abs(np.fft.fft2(a - a.mean())) ** 2
    fy, fx = np.fft.fftfreq(a.shape[0])[:, None], np.fft.fftfreq(a.shape[1])[None, :]
    at = (np.hypot(fy, fx) * min(a.shape)).astype(int)
    total, n = np.bincount(at.ravel(), power.ravel()), np.bincount(at.ravel())
    profile = total / np.maximum(n, 1)
    return float((1 + np.argmax(profile[1 : max(2, min(a.shape) // 2)])) / min(a.shape))


def hough_circles(a: np.ndarray, radii=range(4, 15), angles: int = 72, most_edges: int = 5000) -> list[tuple[float, float, float, float]]:
    """(x, y, radius, strength) of the peak of each radius, strengths relative to the strongest; edges beyond most_edges are the weakest."""
    g = gradient(a)
    y, x = np.nonzero(g > np.percentile(g, 95))
    if not len(y):
        return []
    order = np.argsort(-g[y, x], kind="stable")[:most_edges]
    y, x = y[order], x[order]
    t = np.arange(angles) * 2 * math.pi / angles
    out = []
    for r in radii:
        cx, cy = np.rint(x[:, None] + r * np.cos(t)).astype(int), np.rint(y[:, None] + r * np.sin(t)).astype(int)
        fine = (cx >= 0) & (cx < a.shape[1]) & (cy >= 0) & (cy < a.shape[0])
        votes = np.bincount((cy[fine] * a.shape[1] + cx[fine]), minlength=a.size)
        k = int(votes.argmax())
        out.append((float(k % a.shape[1]), float(k // a.shape[1]), float(r), float(votes[k])))
    top = max(v for *_, v in out) or 1.0
    return sorted(((cx, cy, r, v / top) for cx, cy, r, v in out), key=lambda c: -c[3])


def classical(images: DataFrame) -> DataFrame:
    """Gabor, Fourier and Hough measures and classical_score of each image."""

    def run(a: np.ndarray) -> list[tuple]:
        gabor, f, t = gabor_score(a)
        arcs = hough_circles(a)
        arc = arcs[0][3] if arcs else 0.0
        return [(gabor, f, t, dominant_frequency(a), len(arcs), arc, (gabor + arc) / 2)]

    return per_image(images, run, "gabor_score double, gabor_frequency double, dominant_orientation double, dominant_frequency double, n_arcs int, arc_score double, classical_score double")


# sources and galaxies


def background(a: np.ndarray, mesh: int = 16) -> tuple[np.ndarray, float]:
    """Sigma-clipped medians on a mesh, linearly spread over the image, and the median noise of the cells."""
    rows, cols = max(1, a.shape[0] // mesh), max(1, a.shape[1] // mesh)
    level, noise = np.zeros((rows, cols)), np.zeros((rows, cols))
    for i, band in enumerate(np.array_split(a, rows, axis=0)):
        for j, cell in enumerate(np.array_split(band, cols, axis=1)):
            v = cell.ravel()
            for _ in range(5):
                keep = np.abs(v - np.median(v)) <= 3 * max(v.std(), 1e-12)
                if keep.all():
                    break
                v = v[keep]
            level[i, j], noise[i, j] = np.median(v), v.std()
    spread = lambda m, n, axis: np.apply_along_axis(lambda v: np.interp((np.arange(n) + 0.5) * len(v) / n - 0.5, np.arange(len(v)), v), axis, m)
    return spread(spread(level, a.shape[0], 0), a.shape[1], 1), float(np.median(noise))


def extract(a: np.ndarray, threshold: float = 3.0, least: int = 5) -> list[tuple]:
    """(x, y, flux, peak, area, ellipticity, fwhm, is_star) of connected regions above the background."""
    level, noise = background(a)
    clean = a - level
    lab, n = label(clean > threshold * max(noise, 1e-10))
    rows = []
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        if len(y) < least:
            continue
        w = clean[y, x]
        cx, cy = (x * w).sum() / w.sum(), (y * w).sum() / w.sum()
        xx, yy, xy = ((x - cx) ** 2 * w).sum() / w.sum(), ((y - cy) ** 2 * w).sum() / w.sum(), ((x - cx) * (y - cy) * w).sum() / w.sum()
        root = math.sqrt(max((xx - yy) ** 2 + 4 * xy * xy, 0))
        major, minor = math.sqrt(max((xx + yy + root) / 2, 1e-6)), math.sqrt(max((xx + yy - root) / 2, 1e-6))
        rows.append((float(cx), float(cy), float(w.sum()), float(w.max()), len(y), 1 - minor / major, 2.3548 * math.sqrt(major * minor), math.sqrt(major * minor)))
    typical = float(np.median([r[7] for r in rows])) if rows else 0.0
    return [(*r[:7], bool(r[5] < 0.3 and r[7] < 1.5 * typical)) for r in rows]


def sources(images: DataFrame, threshold: float = 1.5) -> DataFrame:
    return per_image(images, lambda a: extract(a, threshold), "x double, y double, flux double, peak double, area int, ellipticity double, fwhm double, is_star boolean")


def spaced(rows: list[tuple], apart: float) -> list[tuple]:
    """Rows (strength, x, y, ...) by strength, without those within apart of a stronger one."""
    kept: list[tuple] = []
    for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2])):
        if all(math.hypot(r[1] - k[1], r[2] - k[2]) >= apart for k in kept):
            kept.append(r)
    return kept


def tidal_features(a: np.ndarray, share: float = 0.3, least: int = 5) -> list[tuple]:
    rms = np.sqrt(np.maximum(gaussian((a - gaussian(a, 3)) ** 2, 3), 1e-12))
    r = (a - gaussian(a, 3)) / rms
    lab, n = label(r > max(share * r.max(), 3 * mad_sigma(r)))
    rows = []
    for k in range(1, n + 1):
        y, x = np.nonzero(lab == k)
        if len(y) >= least:
            rows.append((float(r[y, x].max()), float(x.mean()), float(y.mean()), len(y)))
    return spaced(rows, 5.0)


def mergers(a: np.ndarray, asymmetry: float = 0.2, most: int = 200) -> list[tuple]:
    """Pairs of bright peaks within an eighth of the image whose surroundings a half turn doesn't repeat."""
    s = gaussian(a, 1.5)
    pad = np.pad(s, 1, constant_values=-np.inf)
    around = np.max([pad[1 + i : pad.shape[0] - 1 + i, 1 + j : pad.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
    y, x = np.nonzero((s > around) & (s > np.median(s) + 3 * max(mad_sigma(s), 1e-10)))
    order = np.argsort(-s[y, x], kind="stable")[:most]
    peaks, reach, out = list(zip(x[order].tolist(), y[order].tolist(), strict=True)), max(a.shape) / 8, []
    for i, (x1, y1) in enumerate(peaks):
        for x2, y2 in peaks[i + 1 :]:
            if math.hypot(x1 - x2, y1 - y2) > reach:
                continue
            half = int(max(4, math.hypot(x1 - x2, y1 - y2)))
            cx, cy = (x1 + x2) // 2, (y1 + y2) // 2
            cut = a[max(0, cy - half) : cy + half + 1, max(0, cx - half) : cx + half + 1]
            cut = cut - np.median(np.concatenate([cut[0], cut[-1], cut[:, 0], cut[:, -1]]))
            value = float(np.abs(cut - cut[::-1, ::-1]).sum() / max(2 * np.abs(cut).sum(), 1e-10))
            if value > asymmetry:
                out.append((value, float(cx), float(cy)))
    return spaced(out, 3.0)[:50]


def galaxies(images: DataFrame) -> DataFrame:
    def run(a: np.ndarray) -> list[tuple]:
        tidal, merging = tidal_features(a), mergers(a)
        return [(len(tidal), len(merging), min(1.0, 0.3 * min(len(tidal), 3) / 3 + 0.4 * min(len(merging), 2) / 2))]

    return per_image(images, run, "n_tidal int, n_mergers int, galaxy_score double")


# Sérsic profiles


def sersic_profile(r: np.ndarray, i_e: float, r_e: float, n: float) -> np.ndarray:
    b = max(1.9992 * n - 0.3271, 0.01)
    return i_e * np.exp(-b * ((r / max(r_e, 1e-6)) ** (1 / n) - 1))


def fit_sersic(r: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[float, float, float, float]:
    """i_e, r_e, n and reduced chi2, by damped least squares in logarithms of the parameters, within bounds."""
    low, high = np.log([1e-3, 0.3, 0.3]), np.log([max(float(np.abs(v).max()) * 10, 1.0), float(r.max()) * 3, 8.0])
    p = np.clip(np.log([max(float(np.median(np.abs(v))), 1e-3), max(float(np.median(r)), 0.5), 2.0]), low, high)
    cost = lambda q: float((((sersic_profile(r, *np.exp(q)) - v) * w) ** 2).sum())
    now, damp = cost(p), 1e-2
    for _ in range(100):
        base = sersic_profile(r, *np.exp(p))
        jac = np.array([(sersic_profile(r, *np.exp(p + 1e-5 * np.eye(3)[k])) - base) / 1e-5 * w for k in range(3)]).T
        res = (v - base) * w
        h = jac.T @ jac
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-9), jac.T @ res, rcond=None)[0]
        new = np.clip(p + step, low, high)
        if (c := cost(new)) < now:
            done, p, now, damp = abs(now - c) < 1e-9 * (now + 1e-12), new, c, damp / 3
            if done:
                break
        else:
            damp *= 5
            if damp > 1e8:
                break
    i_e, r_e, n = np.exp(p)
    return float(i_e), float(r_e), float(n), now / max(len(r) - 3, 1)


#: Classes by Sérsic index, below each cut.
SERSIC_CUTS = (0.5, 1.5, 2.5, 5.0)


def morphology_class(n: float, ellipticity: float) -> str:
    irregular, disk, lenticular, elliptical = SERSIC_CUTS
    if n < irregular:
        return "irregular"
    if n < disk:
        return "edge-on_disk" if ellipticity > 0.5 else "disk/spiral"
    if n < lenticular:
        return "lenticular"
    if n >= elliptical:
        return "compact/cD"
    return "elliptical" if ellipticity < 0.2 else "elliptical_elongated"


def sersic_fits(images: DataFrame) -> DataFrame:
    """Profile fit of each image about its light's centre: median brightness by elliptical radius."""

    def run(a: np.ndarray) -> list[tuple]:
        v = a - np.median(np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]]))
        w = np.maximum(v, 0)
        if w.sum() <= 0:
            return []
        y, x = np.mgrid[: a.shape[0], : a.shape[1]]
        cx, cy = (x * w).sum() / w.sum(), (y * w).sum() / w.sum()
        xx, yy, xy = (((x - cx) ** 2 * w).sum(), ((y - cy) ** 2 * w).sum(), ((x - cx) * (y - cy) * w).sum())
        root = math.sqrt((xx - yy) ** 2 + 4 * xy * xy)
        axis = math.sqrt(max(xx + yy - root, 1e-9) / max(xx + yy + root, 1e-9))
        t = 0.5 * math.atan2(2 * xy, xx - yy)
        u, s = (x - cx) * math.cos(t) + (y - cy) * math.sin(t), -(x - cx) * math.sin(t) + (y - cy) * math.cos(t)
        r = np.hypot(u, s / max(axis, 0.1))
        at = r.astype(int)
        rings = [k for k in range(int(0.8 * min(a.shape) / 2)) if (at == k).sum() >= 3]
        if len(rings) < 5:
            return []
        value = np.array([np.median(v[at == k]) for k in rings])
        error = np.array([max(v[at == k].std() / math.sqrt((at == k).sum()), 1e-6) for k in rings])
        i_e, r_e, n, chi2 = fit_sersic(np.array(rings) + 0.5, value, 1 / error)
        return [(i_e, r_e, n, 1 - axis, chi2, morphology_class(n, 1 - axis))]

    return per_image(images, run, "i_e double, r_e double, n double, ellipticity double, chi2_reduced double, morphology string")


# operations on one image, for the search over six genes (operators/pipelines.py has those of composed pipelines)


def _radial_residual(a: np.ndarray, **_) -> np.ndarray:
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    at = np.hypot(x - a.shape[1] / 2, y - a.shape[0] / 2).astype(int)
    return a - (np.bincount(at.ravel(), a.ravel()) / np.maximum(np.bincount(at.ravel()), 1))[at]


def _mask_sources(a: np.ndarray, threshold: float = 3.0, radius: float = 3.0, **_) -> np.ndarray:
    out = a.copy()
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    for sx, sy, *_rest in extract(a, threshold):
        out[np.hypot(x - sx, y - sy) <= radius] = np.median(a)
    return out


def _correlate(a: np.ndarray, sigma: float = 2.0, **_) -> np.ndarray:
    """Normalised response to a Gaussian source."""
    s = gaussian(a - a.mean(), sigma)
    return s / (s.std() or 1.0)


OPERATIONS: dict[str, Callable[..., np.ndarray]] = {
    "mask_sources": _mask_sources,
    "subtract_model": lambda a, sigma=5.0, **_: a - gaussian(a, sigma),
    "wavelet_residual": lambda a, scale=1, **_: planes(a, int(scale) + 1)[int(scale)],
    "threshold_image": lambda a, sigma=3.0, **_: (a > np.median(a) + sigma * max(mad_sigma(a), 1e-10)).astype(float),
    "convolve_kernel": lambda a, sigma=1.5, **_: gaussian(a, sigma),
    "cross_correlate": _correlate,
    "combine_masks": lambda a, previous=None, how="and", **_: a if previous is None else {"and": np.minimum, "or": np.maximum, "xor": lambda u, v: np.abs(u - v)}[how](a, previous),
    "region_statistics": lambda a, size=8, **_: np.repeat(np.repeat(np.array([[c.std() for c in np.array_split(b, max(1, a.shape[1] // size), 1)] for b in np.array_split(a, max(1, a.shape[0] // size), 0)]), size, 0), size, 1)[: a.shape[0], : a.shape[1]],
    "edge_detect": lambda a, **_: gradient(a),
    "radial_profile_residual": _radial_residual,
}
SCORERS: dict[str, Callable[[np.ndarray], float]] = {
    "max_significance": lambda a: min(1.0, float(np.abs(a - np.median(a)).max() / max(mad_sigma(a), a.std(), 1e-10)) / 10),
    "area_fraction": lambda a: float((np.abs(a - np.median(a)) > 3 * max(mad_sigma(a), 1e-10)).mean()),
    "entropy": lambda a: float(-sum(p * math.log2(p) for p in np.histogram(a, 32)[0] / a.size if p > 0) / 5),
}


def run_pipeline(a: np.ndarray, operations: list[tuple[str, dict]], scorer: str) -> tuple[float, list[str]]:
    """Score and a description of each step; an operation that is unknown or fails leaves the image as it is."""
    steps, previous = [], None
    for name, params in operations:
        try:
            out = OPERATIONS[name](a, **params, previous=previous)
        except (KeyError, ValueError, TypeError, FloatingPointError):
            out = a
        previous, a = a, out
        steps.append(f"{name}: mean {a.mean():.4g}, std {a.std():.4g}")
    return min(1.0, max(0.0, SCORERS[scorer](a))), steps
