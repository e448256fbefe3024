"""Geometry on columns: distances, web Mercator, rings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: radius of the sphere of web Mercator in metres.
MERCATOR_RADIUS = 6378137.0


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def mercator_x(lon: Column) -> Column:
    return lon * F.lit(math.pi * MERCATOR_RADIUS / 180)


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + lat * F.lit(math.pi / 360))) * F.lit(MERCATOR_RADIUS)


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of ``struct<x,y>``; the ring closes itself."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda acc, c: acc + c)) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against an array of ``struct<x,y>``."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(
        ring, following, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)
    )
    return F.aggregate(crossed, F.lit(0), lambda acc, c: acc + c) % 2 == 1


def ring_centroid(ring: Column) -> Column:
    """``struct<x, y>`` of the centre of gravity of a ring with area, else null."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    total = lambda f: F.aggregate(F.zip_with(ring, following, f), F.lit(0.0), lambda acc, c: acc + c)
    area6 = total(cross) * 3
    x, y = total(lambda a, b: (a["x"] + b["x"]) * cross(a, b)), total(lambda a, b: (a["y"] + b["y"]) * cross(a, b))
    return F.when(area6 != 0, F.struct((x / area6).alias("x"), (y / area6).alias("y")))


def clip_box(ring: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """The part of a ring within a box, as a ring; empty where they do not meet. A ring that is not convex may come out with seams along the box."""
    for axis, other, bound, sign in (("x", "y", west, 1), ("x", "y", east, -1), ("y", "x", south, 1), ("y", "x", north, -1)):
        before = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
        ring = F.flatten(F.zip_with(before, ring, _clip_step(axis, other, bound, sign)))
    return ring


def _clip_step(axis: str, other: str, bound: Column, sign: int):
    """What a side of a ring, from ``a`` to ``b``, leaves on the inner side of one side of the box."""

    def step(a: Column, b: Column) -> Column:
        inside = lambda p: sign * (p[axis] - bound) >= 0
        at = a[other] + (b[other] - a[other]) * (bound - a[axis]) / (b[axis] - a[axis])
        crossing = F.struct(bound.alias("x"), at.alias("y")) if axis == "x" else F.struct(at.alias("x"), bound.alias("y"))
        point = F.struct(b["x"].alias("x"), b["y"].alias("y"))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when(inside(b), F.when(inside(a), F.array(point)).otherwise(F.array(crossing, point))).otherwise(F.when(inside(a), F.array(crossing)).otherwise(none))

    return step


#: The WGS 84 ellipsoid, and the scale and false origin of the UTM grid.
ELLIPSOID_A, ELLIPSOID_F, UTM_SCALE, UTM_EAST, UTM_SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def _series() -> tuple[float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """Radius of the rectifying sphere and the series of the transverse Mercator map in the third flattening, to its fourth power."""
    n = ELLIPSOID_F / (2 - ELLIPSOID_F)
    radius = ELLIPSOID_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return radius, forward, back, latitude


def utm_zone(lon: Column) -> Column:
    return F.floor((F.pmod(lon + 180, F.lit(360.0))) / 6).cast("int") + 1


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in a zone, of the northern grid or below the equator the southern one."""
    radius, forward, _, _ = _series()
    e = math.sqrt(ELLIPSOID_F * (2 - ELLIPSOID_F))
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for k, a in enumerate(forward, 1):
        east = east + F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        north = north + F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    scale = UTM_SCALE * radius
    return F.lit(UTM_EAST) + F.lit(scale) * east, F.when(lat < 0, F.lit(UTM_SOUTH)).otherwise(0.0) + F.lit(scale) * north


def from_utm(east: Column, north: Column, zone: Column, southern: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in a zone of the UTM grid."""
    radius, _, back, latitude = _series()
    scale = UTM_SCALE * radius
    xi = (north - F.when(southern, F.lit(UTM_SOUTH)).otherwise(0.0)) / F.lit(scale)
    eta = (east - F.lit(UTM_EAST)) / F.lit(scale)
    x, y = xi, eta
    for k, b in enumerate(back, 1):
        x = x - F.lit(b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - F.lit(b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for k, d in enumerate(latitude, 1):
        phi = phi + F.lit(d) * F.sin(2 * k * chi)
    return zone * 6 - 183 + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)


def utm_to_mercator(east: Column, north: Column, zone: Column, southern: Column) -> tuple[Column, Column]:
    lon, lat = from_utm(east, north, zone, southern)
    return mercator_x(lon), mercator_y(lat)


def scientific(value: Column) -> Column:
    """One digit after the point, exponent without padding: ``1.5e-4``."""
    exponent = F.floor(F.log10(F.abs(value)))
    digits = F.round(F.abs(value) / F.pow(F.lit(10.0), exponent), 1)
    up = digits >= 10
    exponent, digits = F.when(up, exponent + 1).otherwise(exponent), F.when(up, 1.0).otherwise(digits)
    sign = F.when(value < 0, "-").otherwise("")
    return F.when(value == 0, "0.0e0").otherwise(F.concat(sign, F.format_string("%.1f", digits), F.lit("e"), exponent.cast("bigint").cast("string")))
