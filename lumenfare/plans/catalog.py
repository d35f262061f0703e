"""Registered queries over the catalogue and the dashboard."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.functions import dates, geo
from lumenfare.operators import catalog as C
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, interactions, read, sql, venues

NOW = "timestamp '2024-01-15 00:00:00'"
DTO = ["event_id", "title", "topic", "date_time", "price_min", "price_max", "venue_name", "neighborhood", "popularity"]
DTO_SQL = "event_id, title, COALESCE(topic,'music') AS topic, date_time, price_min, price_max, v.name AS venue_name, neighborhood, popularity"


def dto(df):
    return df.withColumn("topic", F.coalesce("topic", F.lit("music"))).select(*DTO)


@query(sql(f"SELECT {DTO_SQL} FROM catalog LEFT JOIN venues v USING (venue_id) WHERE status='active' AND date_time>{NOW} AND COALESCE(topic,'music')='music' AND price_min>=0 AND price_max<=2000 ORDER BY date_time, event_id LIMIT 50", "catalog", "venues"))
def list_events(spark, d):
    e = C.upcoming(catalog(spark, d), as_of()).where(C.listing_filter(topic="music", price_min=0.0, price_max=2000.0))
    return C.page(dto(C.with_venue(e, venues(spark, d))), ["date_time", "event_id"], 50)


@query(sql(f"SELECT {DTO_SQL} FROM catalog LEFT JOIN venues v USING (venue_id) WHERE status='active' AND date_time>{NOW} AND (is_free OR price_min IS NULL OR price_min=0)", "catalog", "venues"))
def list_events_free(spark, d):
    return dto(C.with_venue(C.upcoming(catalog(spark, d), as_of()).where(C.listing_filter(free=True)), venues(spark, d)))


@query(sql(f"SELECT {DTO_SQL} FROM catalog LEFT JOIN venues v USING (venue_id) WHERE status='active' AND date_time>{NOW} AND NOT is_free AND price_min>0 ORDER BY date_time, event_id LIMIT 20 OFFSET 40", "catalog", "venues"))
def list_events_paged(spark, d):
    return C.page(dto(C.with_venue(C.upcoming(catalog(spark, d), as_of()).where(C.listing_filter(free=False)), venues(spark, d))), ["date_time", "event_id"], 20, 40)


@query(sql(f"SELECT {DTO_SQL} FROM catalog LEFT JOIN venues v USING (venue_id) WHERE event_id=42 AND status='active'", "catalog", "venues"))
def event_by_id(spark, d):
    return dto(C.with_venue(catalog(spark, d).where("event_id = 42 and status = 'active'"), venues(spark, d)))


@query(sql(f"SELECT event_id, title, date_time FROM catalog WHERE status='active' AND date_time>{NOW}", "catalog"))
def active_events(spark, d):
    return C.upcoming(catalog(spark, d), as_of()).select("event_id", "title", "date_time")


_BOUNDS = {"today": ("0", "1"), "tomorrow": ("1", "2"), "this_week": ("0", "7"), "this_weekend": ("5", "7"), "next_week": ("7", "14"), "this_month": ("0", "17")}


@query(sql(" UNION ALL ".join(f"SELECT '{p}' AS preset, event_id FROM catalog WHERE date_time >= {NOW} + to_days({a}) AND date_time < {NOW} + to_days({b})" for p, (a, b) in _BOUNDS.items()), "catalog"))
def date_presets(spark, d):
    """The reference time is a Monday and the month has 31 days, so the statement's bounds are plain day counts."""
    out = None
    for p in dates.PRESETS:
        low, high = dates.preset_bounds(p, as_of())
        part = catalog(spark, d).where((F.col("date_time") >= low) & (F.col("date_time") < high)).select(F.lit(p).alias("preset"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(sql(f"SELECT event_id, date_time FROM catalog WHERE status='active' AND date_time>={NOW} AND date_time<={NOW}+to_days(30) AND price_max<=1500 ORDER BY date_time, event_id LIMIT 100", "catalog"))
def candidate_pool(spark, d):
    e = catalog(spark, d).where(F.col("status") == "active").where(C.listing_filter(price_max=1500.0, start=as_of(), end=as_of() + F.expr("interval 30 days")))
    return C.page(e.select("event_id", "date_time"), ["date_time", "event_id"], 100)


@query(sql(f"SELECT {DTO_SQL} FROM catalog LEFT JOIN venues v USING (venue_id) WHERE status='active' AND date_time>{NOW} AND (lower(title) LIKE '%ring%' OR lower(v.name) LIKE '%ring%') ORDER BY popularity DESC, date_time, event_id LIMIT 50", "catalog", "venues"))
def search_keyword(spark, d):
    e = C.search(C.with_venue(C.upcoming(catalog(spark, d), as_of()), venues(spark, d)), "RING", ["title", "venue_name"])
    return C.page(dto(e), [F.desc("popularity"), "date_time", "event_id"], 50)


@query("SELECT DISTINCT o_orderkey, o_orderstatus FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE p_name LIKE '%small ring%'")
def search_case_sensitive(spark, d):
    """Order, line and part stand for event, bridge and artist; the matching side is small, and existence is a semi join."""
    p = C.search(read(spark, d, "part"), "small ring", ["p_name"], case=True)
    keys = read(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return read(spark, d, "orders").join(keys, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus")


@query(sql("SELECT event_id, title FROM catalog WHERE EXISTS (SELECT 1 FROM (SELECT unnest(genres) g) x WHERE g IN ('red','gear'))", "catalog"))
def genre_semi_join(spark, d):
    return catalog(spark, d).where(F.arrays_overlap("genres", F.array(F.lit("red"), F.lit("gear")))).select("event_id", "title")


@query(sql("SELECT event_id FROM catalog c WHERE NOT EXISTS (SELECT 1 FROM interactions i WHERE i.event_id=c.event_id)", "catalog", "interactions"))
def events_without_interactions(spark, d):
    return catalog(spark, d).join(interactions(spark, d), "event_id", "left_anti").select("event_id")


@query(sql("SELECT c.event_id, v.name AS venue_name, v.city, count(i.id) AS interaction_count, round(avg(CASE kind WHEN 'like' THEN 1.0 WHEN 'dislike' THEN 0.0 END),6) AS like_ratio FROM catalog c JOIN venues v USING (venue_id) LEFT JOIN interactions i ON i.event_id=c.event_id GROUP BY ALL", "catalog", "venues", "interactions"))
def event_details(spark, d):
    return C.details(catalog(spark, d), venues(spark, d), interactions(spark, d)).select("event_id", "venue_name", "city", "interaction_count", F.round("like_ratio", 6).alias("like_ratio"))


@query(sql(f"SELECT topic, count(*) AS event_count, count(CASE WHEN date_time>{NOW} THEN 1 END) AS upcoming_count, count(CASE WHEN is_free THEN 1 END) AS free_count, round(avg(COALESCE(price_min,0)),4) AS avg_price FROM catalog GROUP BY topic", "catalog"))
def topic_stats(spark, d):
    return C.topic_stats(catalog(spark, d), as_of()).withColumn("avg_price", F.round("avg_price", 4))


@query(sql("SELECT COALESCE(c.topic,'music') AS name, count(*) AS n FROM catalog c GROUP BY c.topic", "catalog"))
def topic_counts(spark, d):
    """Groups by the raw topic, so that missing topics and music are two rows of one name."""
    return catalog(spark, d).groupBy("topic").agg(F.count("*").alias("n")).select(F.coalesce("topic", F.lit("music")).alias("name"), "n")


@query(sql(f"SELECT v.venue_id, v.name, count(*) AS n FROM catalog c JOIN venues v USING (venue_id) WHERE date_time>{NOW} AND status='active' GROUP BY ALL ORDER BY n DESC, v.venue_id LIMIT 10", "catalog", "venues"))
def top_venues(spark, d):
    n = C.upcoming(catalog(spark, d), as_of()).groupBy("venue_id").agg(F.count("*").alias("n"))
    return n.join(venues(spark, d), "venue_id").select("venue_id", "name", "n").orderBy(F.desc("n"), "venue_id").limit(10)


@query(sql("SELECT CASE WHEN price_min<100 THEN 'under 100' WHEN price_min<1000 THEN '100-1000' WHEN price_min<2000 THEN '1000-2000' ELSE '2000 and more' END AS band, count(*) AS n FROM catalog GROUP BY 1", "catalog"))
def price_histogram(spark, d):
    return catalog(spark, d).groupBy(C.price_band(F.col("price_min")).alias("band")).agg(F.count("*").alias("n"))


@query(sql(f"SELECT source, count(*) AS n FROM catalog WHERE status='active' AND date_time>{NOW} GROUP BY source", "catalog"))
def source_breakdown(spark, d):
    return C.upcoming(catalog(spark, d), as_of()).groupBy("source").agg(F.count("*").alias("n"))


@query(sql("SELECT c.event_id, COALESCE(sum(CASE kind WHEN 'like' THEN 1 WHEN 'dislike' THEN -1 ELSE 0 END),0)::bigint AS score, date_time FROM catalog c LEFT JOIN interactions i ON i.event_id=c.event_id GROUP BY c.event_id, date_time ORDER BY score DESC, date_time DESC, c.event_id LIMIT 100", "catalog", "interactions"))
def vote_order(spark, d):
    e = catalog(spark, d).join(C.vote_score(interactions(spark, d)), "event_id", "left").select("event_id", F.coalesce("score", F.lit(0)).alias("score"), "date_time")
    return C.page(e, [F.desc("score"), F.desc("date_time"), "event_id"], 100)


@query(sql("SELECT event_id, date_time FROM catalog WHERE venue_id=7", "catalog"))
def events_by_venue(spark, d):
    return catalog(spark, d).where("venue_id = 7").select("event_id", "date_time").orderBy(F.desc("date_time"), "event_id")


@query(sql("SELECT event_id, date_time FROM catalog WHERE date_time BETWEEN timestamp '2024-01-20' AND timestamp '2024-01-25'", "catalog"))
def events_in_range(spark, d):
    return catalog(spark, d).where("date_time between timestamp_ntz'2024-01-20' and timestamp_ntz'2024-01-25'").select("event_id", "date_time")


@query(sql("SELECT venue_id, name, neighborhood, city, lat, lon FROM venues", "venues"))
def venues_by_name(spark, d):
    return venues(spark, d).orderBy("name")


@query("SELECT p_partkey AS artist_id, p_name AS name FROM part WHERE p_name LIKE '%bolt%'")
def artists_like(spark, d):
    return read(spark, d, "part").where(F.col("p_name").like("%bolt%")).select(F.col("p_partkey").alias("artist_id"), F.col("p_name").alias("name")).orderBy("name", "artist_id")


@query(sql("SELECT c_custkey AS user_id, c_name AS name, count(i.id) AS interaction_count FROM customer LEFT JOIN interactions i ON i.user_id=c_custkey GROUP BY ALL", "interactions"))
def user_profiles(spark, d):
    n = interactions(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return read(spark, d, "customer").join(n, F.col("c_custkey") == F.col("user_id"), "left").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.coalesce("n", F.lit(0)).alias("interaction_count"))


@query(sql("SELECT id, event_id, kind, ts FROM interactions WHERE user_id=8 AND kind='like' ORDER BY ts DESC, id LIMIT 20", "interactions"))
def user_interactions(spark, d):
    return interactions(spark, d).where("user_id = 8 and kind = 'like'").select("id", "event_id", "kind", "ts").orderBy(F.desc("ts"), "id").limit(20)


@query("SELECT o_orderkey AS event_id, string_agg(p_name, ', ' ORDER BY p_name) AS artists, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name,' '))))), ',') AS genres FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN part ON p_partkey=l_partkey WHERE o_orderstatus='F' GROUP BY o_orderkey")
def events_with_artists(spark, d):
    """Artist names in order, and the distinct genres of all of them, per event."""
    j = read(spark, d, "orders").where("o_orderstatus = 'F'").join(read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(F.col("o_orderkey").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_list("p_name")), ", ").alias("artists"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("p_name", " "))))), ",").alias("genres"))


@query(sql(f"SELECT (SELECT count(*) FROM catalog) AS events, (SELECT count(*) FROM catalog WHERE status='active' AND date_time>{NOW}) AS upcoming, (SELECT count(DISTINCT user_id) FROM interactions WHERE ts >= {NOW} - to_days(7)) AS active_users, (SELECT count(*) FROM interactions WHERE ts >= {NOW} - to_days(7)) AS interactions, (SELECT count(DISTINCT venue_id) FROM catalog) AS venues", "catalog", "interactions"))
def dashboard_overview(spark, d):
    e, since = catalog(spark, d), as_of() - F.expr("interval 7 days")
    a = e.agg(F.count("*").alias("events"), F.count_if((F.col("status") == "active") & (F.col("date_time") > as_of())).alias("upcoming"), F.count_distinct("venue_id").alias("venues"))
    b = interactions(spark, d).where(F.col("ts") >= since).agg(F.count_distinct("user_id").alias("active_users"), F.count("*").alias("interactions"))
    return a.join(F.broadcast(b)).select("events", "upcoming", "active_users", "interactions", "venues")


@query(sql("SELECT g AS genre, count(*) AS n FROM (SELECT unnest(genres) AS g FROM catalog c JOIN interactions i ON i.event_id=c.event_id) GROUP BY g", "catalog", "interactions"))
def genre_breakdown(spark, d):
    n = interactions(spark, d).groupBy("event_id").agg(F.count("*").alias("k"))
    return catalog(spark, d).join(n, "event_id").select(F.explode("genres").alias("genre"), "k").groupBy("genre").agg(F.sum("k").alias("n"))


@query(sql("SELECT neighborhood, count(*) AS n FROM catalog JOIN venues USING (venue_id) WHERE neighborhood IS NOT NULL GROUP BY neighborhood", "catalog", "venues"))
def neighborhood_breakdown(spark, d):
    return C.with_venue(catalog(spark, d), venues(spark, d), "inner").where("neighborhood is not null").groupBy("neighborhood").agg(F.count("*").alias("n"))


@query(sql("SELECT kind, count(*) AS n, count(DISTINCT user_id) AS users FROM interactions GROUP BY kind", "interactions"))
def interaction_breakdown(spark, d):
    return interactions(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(sql("SELECT event_id, sum(n)::bigint AS total, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT event_id, kind, count(*) AS n FROM interactions GROUP BY ALL) GROUP BY event_id", "interactions"))
def per_event_analytics(spark, d):
    n = interactions(spark, d).groupBy("event_id", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("event_id").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", "n"))), ",").alias("kinds"))


@query(sql("SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id HAVING count(*)>=60", "interactions"))
def users_min_interactions(spark, d):
    return interactions(spark, d).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 60")


@query(sql("(SELECT event_id FROM interactions WHERE kind='like' INTERSECT SELECT event_id FROM interactions WHERE kind='going')", "interactions"))
def items_liked_and_visited(spark, d):
    i = interactions(spark, d)
    return i.where("kind = 'like'").select("event_id").intersect(i.where("kind = 'going'").select("event_id"))


@query(sql("SELECT event_id FROM catalog WHERE event_id<200 EXCEPT SELECT event_id FROM interactions WHERE user_id=8", "catalog", "interactions"))
def items_not_seen(spark, d):
    return catalog(spark, d).where("event_id < 200").select("event_id").subtract(interactions(spark, d).where("user_id = 8").select("event_id"))


@query(sql("SELECT event_id FROM catalog EXCEPT SELECT event_id FROM interactions WHERE user_id=8", "catalog", "interactions"))
def items_not_seen_all(spark, d):
    """items_not_seen over the whole catalogue."""
    return catalog(spark, d).select("event_id").subtract(interactions(spark, d).where("user_id = 8").select("event_id"))


@query("SELECT source, lang, count(*) AS n FROM (SELECT source, lang FROM documents UNION ALL SELECT 'chat' AS source, role AS lang FROM conversations) GROUP BY ALL")
def union_sources(spark, d):
    a, b = read(spark, d, "documents").select("source", "lang"), read(spark, d, "conversations").select(F.lit("chat").alias("source"), F.col("role").alias("lang"))
    return a.unionByName(b).groupBy("source", "lang").agg(F.count("*").alias("n"))


_KM = "6371.0*acos(least(1.0,greatest(-1.0,cos(radians(55.6761::double))*cos(radians(lat))*cos(radians(lon)-radians(12.5683::double))+sin(radians(55.6761::double))*sin(radians(lat)))))"


def _with_km(spark, d):
    return venues(spark, d).withColumn("km", geo.cosine_law_km(F.lit(55.6761), F.lit(12.5683), F.col("lat"), F.col("lon")))


@query(sql(f"SELECT venue_id, round({_KM},6) AS km FROM venues WHERE {_KM} <= 5", "venues"))
def venues_radius(spark, d):
    return _with_km(spark, d).where("km <= 5").select("venue_id", F.round("km", 6).alias("km"))


@query(sql(f"SELECT venue_id, round({_KM},6) AS km, row_number() OVER (ORDER BY {_KM}, venue_id) AS rank FROM venues QUALIFY rank<=10", "venues"))
def venues_nearest(spark, d):
    return _with_km(spark, d).orderBy("km", "venue_id").limit(10).select("venue_id", F.round("km", 6).alias("km"), F.row_number().over(W.orderBy("km", "venue_id")).cast("long").alias("rank"))


@query(sql("SELECT a.venue_id AS a, b.venue_id AS b, greatest(abs(floor(a.lat/0.01::double)-floor(b.lat/0.01::double)),abs(floor(a.lon/0.01::double)-floor(b.lon/0.01::double)))::bigint AS ring FROM venues a JOIN venues b ON a.venue_id<b.venue_id WHERE greatest(abs(floor(a.lat/0.01::double)-floor(b.lat/0.01::double)),abs(floor(a.lon/0.01::double)-floor(b.lon/0.01::double)))<=2", "venues"))
def cell_ring_match(spark, d):
    """Venues within two rings of cells: each cell meets the 25 around it by equality, never all pairs."""
    x, y = geo.cell(F.col("lat"), F.col("lon"))
    v = venues(spark, d).select("venue_id", x.alias("x"), y.alias("y"))
    around = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    a = v.select(F.col("venue_id").alias("a"), F.col("x").alias("x0"), F.col("y").alias("y0")).withColumn("dx", around).withColumn("dy", around).withColumns({"x": F.col("x0") + F.col("dx"), "y": F.col("y0") + F.col("dy")})
    return a.join(v.withColumnRenamed("venue_id", "b"), ["x", "y"]).where("a < b").select("a", "b", F.greatest(F.abs("dx"), F.abs("dy")).cast("long").alias("ring"))
