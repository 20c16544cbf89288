"""Universal Transverse Mercator as column expressions, and pixel lattices on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid of WGS 84, the scale on a zone's middle line, and the eastings and southern northings that zones begin with.
A, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0

# Krüger's series in the third flattening to its fourth power: less than a millimetre off within a zone and well beyond.
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]
_BETA = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
_DELTA = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
_E = 2 * _N**0.5 / (1 + _N)  # the ellipsoid's eccentricity


def zone_of(lon: Column) -> Column:
    """1 to 60, 6 degrees each from the date line on."""
    return (F.floor((lon + 180) / 6).cast("int") % 60) + 1


def epsg_of(lat: Column, lon: Column) -> Column:
    """The code of the zone around a position: 326 and the zone in the north, 327 and the zone in the south."""
    return F.when(lat >= 0, 32600).otherwise(32700) + zone_of(lon)


def _middle(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6 - 183)


def _southern(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(SOUTH)).otherwise(0.0)


def to_utm(lat: Column, lon: Column, epsg: Column) -> tuple[Column, Column]:
    """East and north in metres, in a zone that the position need not lie in."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    away = F.radians(lon) - _middle(epsg)
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_ALPHA, start=1):
        x += a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y += a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return EAST + SCALE * _RADIUS * x, _southern(epsg) + SCALE * _RADIUS * y


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    xi, eta = (north - _southern(epsg)) / (SCALE * _RADIUS), (east - EAST) / (SCALE * _RADIUS)
    x, y = xi, eta
    for k, b in enumerate(_BETA, start=1):
        x -= b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y -= b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, d in enumerate(_DELTA, start=1):
        lat += d * F.sin(2 * k * chi)
    return F.degrees(lat), F.degrees(_middle(epsg) + F.atan2(F.sinh(y), F.cos(x)))


def lattice(west: Column, south: Column, east: Column, north: Column, epsg: Column, step: float = 40.0, samples: int = 21) -> Column:
    """The box of a cell in a zone, widened to multiples of step: a struct of x0, y0, x1, y1 and its pixels, height and width.

    Sides bend under projection, so so many places between the corners of each side count too.
    """
    share = F.transform(F.sequence(F.lit(0), F.lit(samples + 1)), lambda k: k / (samples + 1.0))
    def side(lat, lon):  # noqa: E306
        return F.transform(share, lambda t: F.struct(*(c.alias(n) for c, n in zip(to_utm(lat(t), lon(t), epsg), "xy", strict=True))))

    up, along = (lambda t: south + (north - south) * t), (lambda t: west + (east - west) * t)
    outline = F.concat(side(up, lambda t: west), side(up, lambda t: east), side(lambda t: south, along), side(lambda t: north, along))
    values = {"x": F.transform(outline, lambda p: p["x"]), "y": F.transform(outline, lambda p: p["y"])}
    ends = {n: (F.floor(F.array_min(v) / step) * step, F.ceil(F.array_max(v) / step) * step) for n, v in values.items()}
    pixels = lambda n: F.round((ends[n][1] - ends[n][0]) / step).cast("int")
    edge = lambda c: c.cast("double")
    return F.struct(edge(ends["x"][0]).alias("x0"), edge(ends["y"][0]).alias("y0"), edge(ends["x"][1]).alias("x1"), edge(ends["y"][1]).alias("y1"), pixels("y").alias("height"), pixels("x").alias("width"))
