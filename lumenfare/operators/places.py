"""Points that lie near each other: radius joins over cells, and counts over rings of hexagons."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfare.functions import geo

#: Rows of a cell that are joined in one piece; fuller cells are dealt into pieces of about that many.
PIECE = 4096

_AROUND = list(product((-1, 0, 1), repeat=3))


def _cells(points: DataFrame, km: float) -> DataFrame:
    """points with the cube _x, _y, _z that each lies in. Cubes are as wide as the chord of `km` on the sphere is long, so
    that points within `km` lie in the same cube or in two that touch, at the poles and the date line as elsewhere."""
    edge = 2 * geo.RADIUS_KM * math.sin(min(km / (2 * geo.RADIUS_KM), math.pi / 2)) * (1 + 1e-9) + 1e-9
    a, b = F.radians("lat"), F.radians("lon")
    at = {"_x": F.cos(a) * F.cos(b), "_y": F.cos(a) * F.sin(b), "_z": F.sin(a)}
    return points.withColumns({k: F.floor(v * geo.RADIUS_KM / edge) for k, v in at.items()})


def _met(left: DataFrame, right: DataFrame, km: float, around: list[tuple[int, int, int]], piece: int) -> DataFrame:
    """left (id, lat, lon, n) and right, as structs l and r, of rows whose cubes differ by one of `around`.

    Only the right rows are repeated, once for each cube around theirs that holds left rows. A full cube's left rows are
    dealt into pieces by their id, and the right rows go to each piece: no task holds a whole dense cube.
    """
    cube = ["_x", "_y", "_z"]
    l, r = (_cells(t.where("id is not null and lat is not null and lon is not null"), km) for t in (left, right))
    full = l.groupBy(*cube).agg(F.ceil(F.count("*") / piece).cast("int").alias("_pieces"))
    l = l.join(full, cube).select(*cube, F.pmod(F.xxhash64("id"), F.col("_pieces")).cast("int").alias("_piece"), F.struct("id", "lat", "lon", "n").alias("l"))
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("xyz", d)]) for d in around]))
    r = r.select(F.struct("id", "lat", "lon", "n").alias("r"), *cube, step.alias("_d"))
    r = r.select("r", *[(F.col(f"_{k}") + F.col(f"_d.{k}")).alias(f"_{k}") for k in "xyz"], (F.col("_d") == F.struct(*[F.lit(0).alias(k) for k in "xyz"])).alias("same"))
    r = r.join(full, cube).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    return l.join(r, [*cube, "_piece"]).select("l", "r", "same")


def _km() -> Column:
    return geo.haversine_km(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))


def places(points: DataFrame) -> DataFrame:
    """(id, lat, lon, n): one row for all points (id, lat, lon) of equal coordinates, with their smallest id and number.
    Points without an id or a coordinate are left out."""
    p = points.where("id is not null and lat is not null and lon is not null")
    return p.groupBy("lat", "lon").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "lat", "lon", "n")


def near_points(left: DataFrame, right: DataFrame, km: float, piece: int = PIECE) -> DataFrame:
    """(l, r, km) of the rows of two tables of places (id, lat, lon, n) that are at most `km` apart, each pair met once.
    Rows without an id or a coordinate are near nothing."""
    return _met(left, right, km, _AROUND, piece).withColumn("km", _km()).where(F.col("km") <= km).select("l", "r", "km")


def near_pairs(table: DataFrame, km: float, piece: int = PIECE) -> DataFrame:
    """near_points of one table of places of different ids with itself: each pair of two places once, and none of a
    place with itself. Half of the cubes around one suffice; in the same cube the smaller id is on the left."""
    half = [d for d in _AROUND if d >= (0, 0, 0)]
    met = _met(table, table, km, half, piece).where(~F.col("same") | (F.col("l.id") < F.col("r.id")))
    p = met.withColumn("km", _km()).where(F.col("km") <= km)
    swap = F.col("l.id") > F.col("r.id")
    return p.select(F.when(swap, F.col("r")).otherwise(F.col("l")).alias("l"), F.when(swap, F.col("l")).otherwise(F.col("r")).alias("r"), "km")


def neighbour_counts(points: DataFrame, km: float, piece: int = PIECE) -> DataFrame:
    """(id, n_near, nearest_km) of every row of points (id, lat, lon): how many other rows lie at most `km` away, and how
    far the nearest of them is (null if there is none).

    Rows of equal coordinates meet as one place, so a place that holds a third of all rows is one row of the join. Rows
    with a null coordinate have no neighbours; repeated ids are rows like others.
    """
    points = points.select("id", "lat", "lon")
    own = places(points).withColumn("id", F.struct("id", "lat", "lon"))
    both = F.explode(F.array(F.struct(F.col("l.id").alias("id"), F.col("r.n").alias("n")), F.struct(F.col("r.id").alias("id"), F.col("l.n").alias("n"))))
    around = near_pairs(own, km, piece).select(both.alias("e"), "km").groupBy(F.col("e.id").alias("id")).agg(F.sum("e.n").alias("others"), F.min("km").alias("nearest"))
    found = own.join(around, "id", "left").select("lat", "lon", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_near"), F.when(F.col("n") > 1, 0.0).otherwise(F.col("nearest")).alias("nearest_km"))
    known = F.col("id").isNotNull()
    r = points.join(found, ["lat", "lon"], "left")
    return r.select("id", F.when(known, F.coalesce("n_near", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("nearest_km")).alias("nearest_km"))


def hexagon_counts(points: DataFrame, edge_km: float = 0.5, rings: int = 2) -> DataFrame:
    """(q, r, n, ring_1, ..., ring_k): the points (lat, lon) of every hexagon that holds any, and of the rings around it.
    Counts of hexagons meet by equality, never points, so a full hexagon is one row. Points without a coordinate are in
    no hexagon."""
    q, r = geo.hexagon(F.col("lat"), F.col("lon"), edge_km)
    own = points.where("lat is not null and lon is not null").select(q.alias("q"), r.alias("r")).groupBy("q", "r").agg(F.count("*").alias("n"))
    around = [d for d in geo.hexagon_disk(rings) if d[2]]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("q"), F.lit(b).alias("r"), F.lit(k).alias("ring")) for a, b, k in around]))
    given = own.select("q", "r", "n", step.alias("d")).select((F.col("q") + F.col("d.q")).alias("q"), (F.col("r") + F.col("d.r")).alias("r"), F.col("d.ring").alias("ring"), "n")
    sums = given.groupBy("q", "r").agg(*[F.sum(F.when(F.col("ring") == k, F.col("n")).otherwise(0)).alias(f"ring_{k}") for k in range(1, rings + 1)])
    return own.join(sums, ["q", "r"], "left").fillna(0, [f"ring_{k}" for k in range(1, rings + 1)])


# Likeness of places in the same hexagon and in the rings around it.
RING_LIKENESS = [1.0, 0.8, 0.5]


def ring_likeness(ring: Column) -> Column:
    """How alike places are by the rings between their hexagons; 0 beyond the listed rings."""
    return F.coalesce(F.get(F.array(*map(F.lit, RING_LIKENESS)), ring.cast("int")), F.lit(0.0))
