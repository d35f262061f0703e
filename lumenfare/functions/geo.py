"""Distances and cells on the sphere, as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def cosine_law_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the law of cosines, its argument held within -1 to 1."""
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.cos(a) * F.cos(b) * F.cos(F.radians(lon2) - F.radians(lon1)) + F.sin(a) * F.sin(b)
    return F.lit(RADIUS_KM) * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, exact for small distances too."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def cell(lat: Column, lon: Column, size: float = 0.01) -> tuple[Column, Column]:
    """Row and column of the square cell (of `size` degrees) that a point lies in."""
    return F.floor(lat / size), F.floor(lon / size)


def ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How many rings of cells apart two cells are."""
    return F.greatest(F.abs(x1 - x2), F.abs(y1 - y2))


def nearness(km: Column, half: float = 5.0) -> Column:
    """1 at no distance, 1/2 at `half` km."""
    return 1 / (1 + km / half)


# The ellipsoid of WGS 84.
SEMI_MAJOR_KM, FLATTENING = 6378.137, 1 / 298.257223563


def geodesic_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the ellipsoid by Lambert's formula, some ten metres off at thousands of kilometres."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(x))) for x in (lat1, lat2))
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    angle = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (angle - F.sin(angle)) * F.pow(F.sin(p) * F.cos(q) / F.cos(angle / 2), 2)
    y = (angle + F.sin(angle)) * F.pow(F.cos(p) * F.sin(q) / F.sin(angle / 2), 2)
    return F.when(angle == 0, 0.0).otherwise(SEMI_MAJOR_KM * (angle - FLATTENING / 2 * (x + y)))


# The point that hexagons are laid out from, a city's centre.
CENTRE_LAT, CENTRE_LON = 55.6761, 12.5683


def hexagon(lat: Column, lon: Column, edge_km: float = 0.5, lat0: float = CENTRE_LAT, lon0: float = CENTRE_LON) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the hexagon, `edge_km` to an edge, that a point lies in.

    Hexagons have a corner up and lie on the plane that touches the sphere's parallel at lat0, so they keep their size
    near lat0 and narrow or widen far from it. The ids are this library's own. Points between hexagons go by rounding all
    three cube coordinates and mending the one that moved most.
    """
    x = F.radians(lon - lon0) * RADIUS_KM * math.cos(math.radians(lat0))
    y = F.radians(lat - lat0) * RADIUS_KM
    q, r = (x * (3**0.5 / 3) - y / 3) / edge_km, y * (2 / 3) / edge_km
    rounded = lambda v: F.floor(v + 0.5)
    a, b, c = rounded(q), rounded(r), rounded(-q - r)
    off_a, off_b, off_c = F.abs(a - q), F.abs(b - r), F.abs(c + q + r)
    mend_a = (off_a > off_b) & (off_a > off_c)
    return F.when(mend_a, -b - c).otherwise(a), F.when(~mend_a & (off_b > off_c), -a - c).otherwise(b)


def hexagon_rings(q1: Column, r1: Column, q2: Column, r2: Column) -> Column:
    """How many rings of hexagons apart two hexagons are."""
    return F.greatest(F.abs(q1 - q2), F.abs(r1 - r2), F.abs(q1 + r1 - q2 - r2))


def hexagon_disk(rings: int) -> list[tuple[int, int, int]]:
    """(dq, dr, ring) of the hexagons at most `rings` rings around one, itself included: 6 in ring 1, 12 in ring 2."""
    span = range(-rings, rings + 1)
    return [(q, r, max(abs(q), abs(r), abs(q + r))) for q in span for r in span if abs(q + r) <= rings]
