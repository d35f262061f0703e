"""Registered queries of places near each other."""

from pyspark.sql import functions as F

from lumenfare.functions import geo
from lumenfare.operators import places as P
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, sql, venues

_KM = "2*6371.0::double*asin(sqrt(least(1.0::double, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2))))"


def _points(spark, d):
    return venues(spark, d).select(F.col("venue_id").alias("id"), "lat", "lon")


@query(sql(f"SELECT a.venue_id, count(b.venue_id) AS n_near, round(min({_KM}),6) AS nearest_km FROM venues a LEFT JOIN venues b ON a.venue_id<>b.venue_id AND {_KM}<=1 GROUP BY ALL", "venues"))
def venue_neighbours(spark, d):
    """Venues at most a kilometre from each venue, and the nearest of them."""
    return P.neighbour_counts(_points(spark, d), 1.0).select(F.col("id").alias("venue_id"), "n_near", F.round("nearest_km", 6).alias("nearest_km"))


@query(sql(f", p AS (SELECT min(venue_id) AS id, lat, lon FROM venues GROUP BY lat, lon) SELECT a.id AS a, b.id AS b, round({_KM},6) AS km FROM p a JOIN p b ON a.id<b.id WHERE {_KM}<=1", "venues"))
def near_venue_pairs(spark, d):
    """Pairs of places of venues at most a kilometre apart; venues at one place are one place, with the smallest id."""
    return P.near_pairs(P.places(_points(spark, d)), 1.0).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round("km", 6).alias("km"))


@query(sql(f", e AS (SELECT venue_id, lat, lon, count(*) AS n FROM catalog JOIN venues USING (venue_id) WHERE status='active' AND date_time>timestamp '2024-01-15' GROUP BY ALL) SELECT a.venue_id, sum(b.n)::bigint AS n_events FROM venues a JOIN e b ON {_KM}<=2 GROUP BY ALL", "catalog", "venues"))
def events_near_venues(spark, d):
    """Coming active events at most two kilometres from each venue that has any there: two tables joined by radius."""
    e = catalog(spark, d).where((F.col("status") == "active") & (F.col("date_time") > as_of())).groupBy(F.col("venue_id").alias("id")).agg(F.count("*").alias("n"))
    v = _points(spark, d)
    pairs = P.near_points(v.withColumn("n", F.lit(1)), v.join(e, "id"), 2.0)
    return pairs.groupBy(F.col("l.id").alias("venue_id")).agg(F.sum("r.n").alias("n_events"))


_HEX = "u AS (SELECT venue_id, (radians(lon-12.5683::double)*6371.0::double*cos(radians(55.6761::double))*(sqrt(3::double)/3) - radians(lat-55.6761::double)*6371.0::double/3)/0.5::double AS fq, radians(lat-55.6761::double)*6371.0::double*(2::double/3)/0.5::double AS fr FROM venues), c AS (SELECT *, floor(fq+0.5::double)::bigint AS a, floor(fr+0.5::double)::bigint AS b, floor(-fq-fr+0.5::double)::bigint AS c FROM u), o AS (SELECT *, abs(a-fq) AS oa, abs(b-fr) AS ob, abs(c+fq+fr) AS oc FROM c), h AS (SELECT venue_id, CASE WHEN oa>ob AND oa>oc THEN -b-c ELSE a END AS q, CASE WHEN NOT (oa>ob AND oa>oc) AND ob>oc THEN -a-c ELSE b END AS r FROM o)"
_RING = "greatest(abs(x.q-y.q),abs(x.r-y.r),abs(x.q+x.r-y.q-y.r))"


@query(sql(f", {_HEX}, k AS (SELECT q, r, count(*) AS n FROM h GROUP BY ALL) SELECT x.q, x.r, max(x.n) AS n, sum(CASE WHEN {_RING}=1 THEN y.n ELSE 0 END)::bigint AS ring_1, sum(CASE WHEN {_RING}=2 THEN y.n ELSE 0 END)::bigint AS ring_2 FROM k x JOIN k y ON {_RING}<=2 GROUP BY x.q, x.r", "venues"))
def hexagon_venues(spark, d):
    """Venues in each hexagon and in the two rings around it."""
    return P.hexagon_counts(_points(spark, d))


@query(sql(f", {_HEX} SELECT x.venue_id AS a, y.venue_id AS b, CASE {_RING} WHEN 0 THEN 1.0::double WHEN 1 THEN 0.8::double ELSE 0.5::double END AS likeness FROM h x JOIN h y ON x.venue_id%50=0 AND x.venue_id<>y.venue_id AND {_RING}<=2", "venues"))
def hexagon_likeness(spark, d):
    """How near all venues are, by hexagons, to the venues whose id is divisible by 50."""
    q, r = geo.hexagon(F.col("lat"), F.col("lon"))
    h = _points(spark, d).select("id", q.alias("q"), r.alias("r"))
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("q"), F.lit(y).alias("r"), F.lit(k).alias("ring")) for x, y, k in geo.hexagon_disk(2)]))
    asked = h.where("id % 50 = 0").select(F.col("id").alias("a"), "q", "r", step.alias("d"))
    asked = asked.select("a", (F.col("q") + F.col("d.q")).alias("q"), (F.col("r") + F.col("d.r")).alias("r"), F.col("d.ring").alias("ring"))
    return asked.join(h.withColumnRenamed("id", "b"), ["q", "r"]).where("a <> b").select("a", "b", P.ring_likeness(F.col("ring")).alias("likeness"))
