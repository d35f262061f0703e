"""Registered queries of client filters and request rules."""

from pyspark.sql import functions as F

from lumenfare.operators import catalog as C
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, interactions, read, sql, venues

NOW = "timestamp '2024-01-15 00:00:00'"


@query(sql("SELECT event_id FROM catalog JOIN venues v USING (venue_id) WHERE (lower(title) LIKE '%ring%' OR lower(v.name) LIKE '%ring%' OR lower(neighborhood) LIKE '%ring%' OR len(list_filter(genres, lambda g: lower(g) LIKE '%ring%'))>0) AND len(list_intersect(genres,['small','ring','gear']))>0 AND neighborhood IN (SELECT n_name FROM nation WHERE n_nationkey%2=0) AND COALESCE(price_min,0)>=0 AND COALESCE(price_max,0)<=1500", "catalog", "venues"))
def client_filter(spark, d):
    """What a client shows: a search over title, venue, quarter and genres, genres of a list, quarters, prices with
    missing ones as 0. The quarters are a table, met by a semi join."""
    quarters = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("neighborhood"))
    e = C.with_venue(catalog(spark, d), venues(spark, d), "inner")
    return C.shown(e, query="RING", genres=["small", "ring", "gear"], prices=(0.0, 1500.0)).join(quarters, "neighborhood", "left_semi").select("event_id")


_BOUND = {"default": f"{NOW}+to_days(30)", "today": f"{NOW}+to_hours(23)+to_minutes(59)", "this_week": f"{NOW}+to_days(7)", "this_month": f"{NOW}+to_days(30)", "this_weekend": None}


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS preset, event_id FROM catalog WHERE status='active' AND date_time>={NOW}" + (f" AND date_time<={v}" if v else "") + " AND price_max<=1500" for k, v in _BOUND.items()), "catalog"))
def request_bounds(spark, d):
    """The upper bound of each preset: 30 days without one, none for presets that are not known; prices of 0 are ignored."""
    out = None
    for k in _BOUND:
        e = catalog(spark, d).where(C.request_filter(as_of(), preset=None if k == "default" else k, price_min=0.0, price_max=1500.0)).select(F.lit(k).alias("preset"), "event_id")
        out = e if out is None else out.unionByName(e)
    return out


@query(sql("SELECT venue_id, lat BETWEEN 55.615 AND 55.735 AND lon BETWEEN 12.45 AND 12.65 AS in_city, lat BETWEEN 55.65 AND 55.70 AND lon BETWEEN 12.50 AND 12.60 AS in_centre FROM venues", "venues"))
def bounding_boxes(spark, d):
    lat, lon = F.col("lat"), F.col("lon")
    return venues(spark, d).select("venue_id", C.within(lat, lon, C.CITY).alias("in_city"), C.within(lat, lon, (55.65, 55.70, 12.50, 12.60)).alias("in_centre"))


_RULES = {"hours": "NOT (h<0 OR h>23)", "days": "NOT (w<0 OR w>6)", "price_range": "NOT (low<0 OR high<low)", "rating": "rating IS NULL OR rating BETWEEN 1 AND 5", "rating_missing": "kind<>'went' OR rating IS NOT NULL", "kind": "kind IN ('like','dislike','going','went','save')", "location": "(lat IS NULL)=(lon IS NULL) AND COALESCE(lat BETWEEN -90 AND 90,true) AND COALESCE(lon BETWEEN -180 AND 180,true)", "page": "page>=1 AND size BETWEEN 1 AND 100"}


@query(sql("SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT COALESCE({r},false) THEN '{n}' END" for n, r in _RULES.items()) + "], lambda x: x IS NOT NULL),',') AS issues FROM (SELECT id, id%27-1 AS h, id%8 AS w, id%50-2.0 AS low, id%40 AS high, CASE WHEN id%6=0 THEN id%7 END AS rating, CASE WHEN id%11=0 THEN 'upvote' ELSE kind END AS kind, CASE WHEN id%5>0 THEN id%100-5.0 END AS lat, CASE WHEN id%5<>1 THEN id%200-10.0 END AS lon, id%9 AS page, id%130 AS size FROM interactions)", "interactions"))
def request_issues(spark, d):
    """Requests made of interactions by rule, and the rules that they break."""
    k = F.col("id")
    r = interactions(spark, d).select("id", (k % 27 - 1).alias("hour"), (k % 8).alias("day"), (k % 50 - 2.0).alias("low"), (k % 40).alias("high"), F.when(k % 6 == 0, k % 7).alias("rating"), F.when(k % 11 == 0, "upvote").otherwise(F.col("kind")).alias("kind"), F.when(k % 5 > 0, k % 100 - 5.0).alias("lat"), F.when(k % 5 != 1, k % 200 - 10.0).alias("lon"), (k % 9).alias("page"), (k % 130).alias("size"))
    return C.validated(r, C.request_rules()).select("id", F.array_join("issues", ",").alias("issues"))


@query(sql("SELECT user_id, kind, count(*) AS n FROM (SELECT c_custkey AS user_id, c_name FROM customer WHERE c_custkey%10=0 AND c_name LIKE 'Customer%') JOIN interactions USING (user_id) GROUP BY ALL", "interactions"))
def user_lookup(spark, d):
    """Users by a rule on id and name, with their interactions by kind."""
    u = read(spark, d, "customer").where((F.col("c_custkey") % 10 == 0) & F.col("c_name").like("Customer%")).select(F.col("c_custkey").alias("user_id"))
    return interactions(spark, d).join(u, "user_id", "left_semi").groupBy("user_id", "kind").agg(F.count("*").alias("n"))


@query(sql("SELECT event_id, to_json(genres)::varchar AS genres_json, len(genres) AS n_back, COALESCE(CASE WHEN event_id%4=0 THEN NULL WHEN event_id%4=1 THEN [] ELSE ['a','b'] END,[])::varchar AS tags, (event_id%10)/10.0::double AS best_score FROM catalog", "catalog"))
def json_columns(spark, d):
    """Arrays to JSON text and back, missing and malformed tags as no tags, scores out of a map from a JSON text."""
    k = F.col("event_id")
    tags = F.when(k % 4 == 1, "oops").when(k % 4 > 1, '["a","b"]')
    scores = F.concat(F.lit('{"x":'), ((k % 10) / 10.0).cast("string"), F.lit(',"y":-1.0}'))
    best = F.array_max(F.map_values(F.from_json(scores, "map<string,double>")))
    j = F.to_json("genres")
    parsed = F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))
    return catalog(spark, d).select("event_id", j.alias("genres_json"), F.size(F.from_json(j, "array<string>")).cast("long").alias("n_back"), F.concat(F.lit("["), F.array_join(parsed, ", "), F.lit("]")).alias("tags"), best.alias("best_score"))


@query(sql("SELECT event_id FROM catalog JOIN venues USING (venue_id) WHERE COALESCE(topic,'music') IN ('music','tech') AND (event_id%3=0 OR event_id%3=1 AND event_id%2=0) AND 2*6371.0::double*asin(sqrt(least(1.0,pow(sin(radians(lat-55.6761::double)/2),2)+cos(radians(55.6761::double))*cos(radians(lat))*pow(sin(radians(lon-12.5683::double)/2),2))))<=10", "catalog", "venues"))
def listing_by_tags(spark, d):
    """Several topics, several tags, and venues within ten kilometres."""
    from lumenfare.functions import geo

    k = F.col("event_id")
    e = C.with_venue(catalog(spark, d), venues(spark, d), "inner").withColumn("tags", F.when(k % 3 == 0, F.array(F.lit("free"))).when((k % 3 == 1) & (k % 2 == 0), F.array(F.lit("x"), F.lit("outdoor"))))
    return e.where(C.listing_filter(topics=["music", "tech"], tags=["free", "outdoor"])).where(geo.haversine_km(F.lit(55.6761), F.lit(12.5683), F.col("lat"), F.col("lon")) <= 10).select("event_id")
