"""Radius joins and hexagons against all pairs of points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfare.functions import geo
from lumenfare.operators import places as P


def km(a, b):
    (p, q), (r, s) = ([math.radians(x) for x in t] for t in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.fixture(scope="module")
def points():
    rng = random.Random(3)
    city = [(55.6 + rng.random() / 10, 12.5 + rng.random() / 10) for _ in range(120)]
    poles = [(89.9 + rng.random() / 10, rng.uniform(-180, 180)) for _ in range(20)] + [(rng.uniform(-1, 1) / 50, side * (180 - rng.random() / 50)) for side in (1, -1) for _ in range(15)]
    hot = [(55.65, 12.55)] * 60  # a third of a city at one place
    return list(enumerate(city + poles + hot))


def table(spark, points):
    return spark.createDataFrame([(i, *p) for i, p in points], "id long, lat double, lon double")


@pytest.mark.parametrize("radius,piece", [(0.3, 4096), (1.5, 3), (8.0, 16)])
def test_neighbours_equal_all_pairs(spark, points, radius, piece):
    got = {r.id: (r.n_near, r.nearest_km) for r in P.neighbour_counts(table(spark, points), radius, piece).collect()}
    want = {}
    for i, p in points:
        near = [x for j, q in points if j != i and (x := km(p, q)) <= radius]
        want[i] = (len(near), min(near, default=None))
    assert {i: n for i, (n, _) in got.items()} == {i: n for i, (n, _) in want.items()}
    for i in want:
        assert got[i][1] == (None if want[i][1] is None else pytest.approx(want[i][1], abs=1e-9))


def test_each_pair_is_met_once(spark, points):
    own = P.places(table(spark, points))
    at = {r.id: (r.lat, r.lon) for r in own.collect()}
    pairs = [(r.a, r.b) for r in P.near_pairs(own, 2.0, 5).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()]
    assert sorted(pairs) == sorted((a, b) for a in at for b in at if a < b and km(at[a], at[b]) <= 2)
    both = [(r.a, r.b) for r in P.near_points(own, own, 2.0, 5).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).collect()]
    assert sorted(both) == sorted((a, b) for a in at for b in at if km(at[a], at[b]) <= 2)


def test_odd_points(spark):
    rows = [(1, 55.0, 12.0), (1, 55.0, 12.0), (2, None, 12.0), (3, 55.0, None), (None, 55.0, 12.0), (4, -55.0, -168.0), (5, 20.0, 12.0), (5, 20.0, 12.001)]
    p = spark.createDataFrame(rows, "id long, lat double, lon double").withColumn("n", F.lit("kept out"))
    got = sorted(((r.id or 0), r.n_near, r.nearest_km) for r in P.neighbour_counts(p, 5.0).collect())
    assert got == [(0, 0, None), (1, 1, 0.0), (1, 1, 0.0), (2, 0, None), (3, 0, None), (4, 0, None), (5, 1, pytest.approx(0.104, abs=1e-3)), (5, 1, pytest.approx(0.104, abs=1e-3))]
    assert P.neighbour_counts(p.limit(0), 5.0).count() == 0
    everywhere = {r.id: r.n_near for r in P.neighbour_counts(p.where("id in (1, 4)"), 30000.0).collect()}
    assert everywhere == {1: 2, 4: 2}  # farther than any two points are


def test_hexagons(spark, points):
    disk = geo.hexagon_disk(2)
    assert [sum(k == n for *_, k in disk) for n in range(3)] == [1, 6, 12]
    q, r = geo.hexagon(F.col("lat"), F.col("lon"))
    city = [(i, p) for i, p in points if 55 < p[0] < 56]
    cells = {x.id: (x.q, x.r) for x in table(spark, city).select("id", q.alias("q"), r.alias("r")).collect()}
    # The hexagon of a point is the one whose centre is nearest.
    flat = lambda p: (math.radians(p[1] - geo.CENTRE_LON) * 6371 * math.cos(math.radians(geo.CENTRE_LAT)), math.radians(p[0] - geo.CENTRE_LAT) * 6371)
    centre = lambda c: (0.5 * math.sqrt(3) * (c[0] + c[1] / 2), 0.5 * 1.5 * c[1])
    for i, p in city:
        c = cells[i]
        near = min(((c[0] + a, c[1] + b) for a, b, _ in disk), key=lambda x: math.dist(flat(p), centre(x)))
        assert near == c
        assert math.dist(flat(p), centre(c)) <= 0.5 + 1e-9
    apart = lambda x, y: max(abs(x[0] - y[0]), abs(x[1] - y[1]), abs(sum(x) - sum(y)))
    for row in P.hexagon_counts(table(spark, city)).collect():
        n = [sum(apart((row.q, row.r), c) == k for c in cells.values()) for k in range(3)]
        assert n == [row.n, row.ring_1, row.ring_2]
