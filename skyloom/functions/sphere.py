"""Positions on the sky as column expressions; angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values (J2000): right ascension and declination of the north galactic pole, galactic longitude of the celestial pole.
POLE_RA, POLE_DEC, POLE_L = 192.85948, 27.12825, 122.93192


def separation(ra1, dec1, ra2, dec2) -> Column:
    """Angular distance, by the Vincenty form, which is good at all distances."""
    a1, d1, a2, d2 = (F.radians(x) for x in (ra1, dec1, ra2, dec2))
    da = a2 - a1
    far = F.cos(d2) * F.sin(da)
    near = F.cos(d1) * F.sin(d2) - F.sin(d1) * F.cos(d2) * F.cos(da)
    return F.degrees(F.atan2(F.sqrt(far * far + near * near), F.sin(d1) * F.sin(d2) + F.cos(d1) * F.cos(d2) * F.cos(da)))


def galactic_lat(ra, dec) -> Column:
    d, p, a = F.radians(dec), F.radians(F.lit(POLE_DEC)), F.radians(ra - F.lit(POLE_RA))
    return F.degrees(F.asin(F.sin(d) * F.sin(p) + F.cos(d) * F.cos(p) * F.cos(a)))


def galactic_lon(ra, dec) -> Column:
    d, p, a = F.radians(dec), F.radians(F.lit(POLE_DEC)), F.radians(ra - F.lit(POLE_RA))
    angle = F.degrees(F.atan2(F.cos(d) * F.sin(a), F.sin(d) * F.cos(p) - F.cos(d) * F.sin(p) * F.cos(a)))
    return F.pmod(F.lit(POLE_L) - angle, F.lit(360.0))


def in_box(ra, dec, ra0: float, dec0: float, radius: float) -> Column:
    """A box around a cone of literals, plain comparisons that reach the scan."""
    import math

    low, high = max(-90.0, dec0 - radius), min(90.0, dec0 + radius)
    inside = dec.between(low, high)
    if high < 90 and low > -90:
        wide = math.degrees(math.asin(min(1.0, math.sin(math.radians(radius)) / math.cos(math.radians(dec0)))))
        a, b = (ra0 - wide) % 360, (ra0 + wide) % 360
        if wide < 180:
            inside = inside & (ra.between(a, b) if a <= b else (ra >= a) | (ra <= b))
    return inside


def in_stripe(ra, dec) -> Column:
    """The footprint of the equatorial stripe with repeated imaging."""
    return (F.abs(dec) <= 1.5) & ((ra >= 310) | (ra <= 60))


def to_plane(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Gnomonic (TAN) projection about a point: standard coordinates in degrees."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    scale = F.sin(d) * F.sin(d0) + F.cos(d) * F.cos(d0) * F.cos(a)
    return F.degrees(F.cos(d) * F.sin(a) / scale), F.degrees((F.sin(d) * F.cos(d0) - F.cos(d) * F.sin(d0) * F.cos(a)) / scale)


def from_plane(xi, eta, ra0, dec0) -> tuple[Column, Column]:
    """The inverse of to_plane."""
    x, y, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    below = F.cos(d0) - y * F.sin(d0)
    ra = F.pmod(ra0 + F.degrees(F.atan2(x, below)), F.lit(360.0))
    return ra, F.degrees(F.atan2(F.sin(d0) + y * F.cos(d0), F.sqrt(x * x + below * below)))
