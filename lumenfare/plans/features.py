"""Registered queries of feature functions over the catalogue."""

import math

from pyspark.sql import functions as F

from lumenfare.functions import dates
from lumenfare.functions import scores as S
from lumenfare.operators import hybrid as H
from lumenfare.operators import recommend as R
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, interactions, sql

NOW = "timestamp '2024-01-15 00:00:00'"
_DAYS = f"floor((epoch_us(date_time)-epoch_us({NOW}))/86400000000.0)"


@query(sql(f"SELECT event_id, {_DAYS}::bigint AS days, CASE WHEN {_DAYS}<0 THEN 0.0 WHEN {_DAYS}<=7 THEN 1.0 WHEN {_DAYS}<=30 THEN 0.8 WHEN {_DAYS}<=90 THEN 0.6 ELSE 0.3 END::double AS recency, round(sin(2*pi()*hour(date_time)/24),6) AS hour_sin, round(cos(2*pi()*(isodow(date_time)-1)/7),6) AS day_cos, hour(date_time) BETWEEN 19 AND 23 AS is_peak, isodow(date_time)>=5 AS is_weekend, round(ln(greatest(1,{_DAYS})),6) AS days_log, round(hour(date_time)/23.0::double,6) AS hour_share FROM catalog", "catalog"))
def time_features(spark, d):
    n, h, w = dates.days_until(F.col("date_time"), as_of()), F.hour("date_time"), F.weekday("date_time")
    return catalog(spark, d).select("event_id", n.alias("days"), S.recency(n).alias("recency"), F.round(F.sin(2 * math.pi * h / 24), 6).alias("hour_sin"), F.round(F.cos(2 * math.pi * w / 7), 6).alias("day_cos"), h.between(19, 23).alias("is_peak"), (w >= 4).alias("is_weekend"), F.round(F.log(F.greatest(F.lit(1.0), n.cast("double"))), 6).alias("days_log"), F.round(h / 23.0, 6).alias("hour_share"))


@query(sql("SELECT event_id, (price_min+price_max)/2 AS price_avg, price_max-price_min AS price_range, COALESCE(price_min,0)=0 AS free, COALESCE(price_min,0)<200 AS cheap, COALESCE(price_max,0)>=1500 AS premium FROM catalog", "catalog"))
def price_features(spark, d):
    low, high = F.col("price_min"), F.col("price_max")
    return catalog(spark, d).select("event_id", ((low + high) / 2).alias("price_avg"), (high - low).alias("price_range"), (F.coalesce(low, F.lit(0.0)) == 0).alias("free"), (F.coalesce(low, F.lit(0.0)) < 200).alias("cheap"), (F.coalesce(high, F.lit(0.0)) >= 1500).alias("premium"))


@query(sql("SELECT event_id, round(CASE WHEN COALESCE(price_min,0)=0 THEN 1.0 WHEN least(price_max,1200.0)-greatest(price_min,1000.0)<0 THEN 0.0 ELSE least(1.0,(least(price_max,1200.0)-greatest(price_min,1000.0))/least(price_max-price_min,200.0)) END::double,6) AS score FROM catalog", "catalog"))
def price_overlap(spark, d):
    return catalog(spark, d).select("event_id", F.round(S.price_overlap(F.col("price_min"), F.col("price_max"), 1000.0, 1200.0), 6).alias("score"))


@query(sql("SELECT event_id, round(greatest(0.0,1-least(abs(20-hour(date_time)),abs(21-hour(date_time)),abs(22-hour(date_time)))/12.0::double)*0.5::double + CASE WHEN isodow(date_time)-1 IN (4,5,6) THEN 0.5 ELSE 0.0 END::double,6) AS score FROM catalog", "catalog"))
def time_match(spark, d):
    return catalog(spark, d).select("event_id", F.round(S.time_match(F.col("date_time"), [20, 21, 22], [4, 5, 6]), 6).alias("score"))


@query(sql("SELECT c.event_id, round(ln(greatest(1,count(i.id))),6) AS log_interactions, round(count(CASE WHEN kind='like' THEN 1 END)/greatest(1,count(i.id))::double,6) AS like_rate, popularity>0.8 AS trending, popularity<0.3 AS niche FROM catalog c LEFT JOIN interactions i ON i.event_id=c.event_id GROUP BY c.event_id, popularity", "catalog", "interactions"))
def popularity_features(spark, d):
    n = interactions(spark, d).groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "like").alias("likes"))
    e = catalog(spark, d).join(n, "event_id", "left").fillna(0, ["n", "likes"])
    top = F.greatest(F.lit(1), F.col("n")).cast("double")
    return e.select("event_id", F.round(F.log(top), 6).alias("log_interactions"), F.round(F.col("likes") / top, 6).alias("like_rate"), (F.col("popularity") > 0.8).alias("trending"), (F.col("popularity") < 0.3).alias("niche"))


@query(sql("SELECT event_id, length(title) AS title_length, len(genres) AS n_genres, list_contains(genres,'red') AS is_red, list_contains(genres,'gear') AS is_gear FROM catalog", "catalog"))
def content_features(spark, d):
    return catalog(spark, d).select("event_id", F.length("title").cast("long").alias("title_length"), F.size("genres").cast("long").alias("n_genres"), F.array_contains("genres", "red").alias("is_red"), F.array_contains("genres", "gear").alias("is_gear"))


@query(sql(f"SELECT user_id, count(*) AS n, count(CASE WHEN hour(ts)>=18 THEN 1 END) AS evenings, count(CASE WHEN isodow(ts)>=6 THEN 1 END) AS weekends, count(*)>=10 AS is_active, count(CASE WHEN ts>{NOW}-to_days(30) THEN 1 END) AS n_recent, count(CASE WHEN ts>{NOW}-to_days(30) THEN 1 END)>=3 AS is_recent FROM interactions GROUP BY user_id", "interactions"))
def user_context_features(spark, d):
    """A user's activity; recent is what came later than 30 days before now."""
    recent = F.count_if(F.col("ts") > as_of() - F.expr("interval 30 days"))
    return interactions(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.hour("ts") >= 18).alias("evenings"), F.count_if(F.weekday("ts") >= 5).alias("weekends"), (F.count("*") >= 10).alias("is_active"), recent.alias("n_recent"), (recent >= 3).alias("is_recent"))


@query(sql("SELECT event_id, round(least(1.0,COALESCE(price_max,0)/2000.0),6)::double AS price_share, round(ln(1+popularity*100)/10,6) AS popularity_log FROM catalog", "catalog"))
def normalized_features(spark, d):
    return catalog(spark, d).select("event_id", F.round(F.least(F.lit(1.0), F.coalesce("price_max", F.lit(0.0)) / 2000.0), 6).alias("price_share"), F.round(F.log(1 + F.col("popularity") * 100) / 10, 6).alias("popularity_log"))


@query(sql("SELECT event_id, round(1/(1+exp(-(0.5*greatest(0.0,popularity-0.2)+(-0.25)*greatest(0.0,1-popularity)+0.1)::double)),6) AS score FROM catalog", "catalog"))
def mlp_scores(spark, d):
    layers = [([[1.0], [-1.0]], [-0.2, 1.0]), ([[0.5, -0.25]], [0.1])]
    return catalog(spark, d).select("event_id", F.round(S.mlp(F.array("popularity"), layers), 6).alias("score"))


@query(sql(", l AS (SELECT user_id, c.* FROM interactions i JOIN catalog c USING (event_id) WHERE kind='like'), p AS (SELECT user_id, len(list_distinct(flatten(list(genres)))) AS g, min(price_min) AS lo, max(price_max) AS hi, list(DISTINCT hour(date_time)) AS h, list(DISTINCT isodow(date_time)-1) AS w, count(DISTINCT source) AS a FROM l GROUP BY user_id) SELECT user_id, COALESCE(g,0) AS n_genres, COALESCE(a,0) AS n_artists, COALESCE(g,0)>0 AS has_genres, COALESCE(a,0)>0 AS has_artists, COALESCE(lo,0)::double AS budget_min, COALESCE(hi,1000)::double AS budget_max, COALESCE(hi,1000)::double-COALESCE(lo,0)::double AS budget_range, COALESCE(hi,1000)<300 AS is_budget_conscious, COALESCE(len(h),0) AS n_hours, COALESCE(len(w),0) AS n_days, COALESCE(len(list_filter(h, lambda x: x>=18))>0,false) AS prefers_evenings, COALESCE(len(list_filter(w, lambda x: x IN (5,6)))>0,false) AS prefers_weekends FROM (SELECT DISTINCT user_id FROM interactions) LEFT JOIN p USING (user_id)", "catalog", "interactions"))
def user_preference_features(spark, d):
    """What every user's likes say of their wishes: genres, sources in place of artists, prices, hours and weekdays. Each
    kind of wish is made distinct before it is gathered, so a user's array has at most as many places as there are
    genres, sources, hours or weekdays."""
    i = interactions(spark, d)
    liked = i.where("kind = 'like'").select("user_id", "event_id").distinct().join(catalog(spark, d), "event_id")
    sets = liked.groupBy("user_id").agg(F.collect_set("source").alias("sources"), F.min("price_min").alias("low"), F.max("price_max").alias("high"), F.collect_set(F.hour("date_time")).alias("hours"), F.collect_set(F.weekday("date_time")).alias("days"))
    genres = liked.select("user_id", F.explode("genres").alias("g")).groupBy("user_id").agg(F.collect_set("g").alias("genres"))
    u = i.select("user_id").distinct().join(sets, "user_id", "left").join(genres, "user_id", "left")
    return u.select("user_id", *H.preference_features(F.col("genres"), F.col("sources"), F.col("low"), F.col("high"), F.col("hours"), F.col("days")))


@query(sql(", n AS (SELECT event_id, count(*) AS n FROM interactions GROUP BY event_id), e AS (SELECT c.event_id, popularity, price_min, COALESCE(n,0)::double AS seen FROM catalog c LEFT JOIN n USING (event_id)) SELECT event_id, " + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN COALESCE(({c}-avg({c}) OVER ())/NULLIF(stddev_pop({c}) OVER (),0),0) END,6)+0.0 AS z_{c}" for c in ("popularity", "price_min", "seen")) + " FROM e", "catalog", "interactions"))
def standard_scores(spark, d):
    """Popularity, price and interactions of every event as standard scores over the whole catalogue."""
    n = interactions(spark, d).groupBy("event_id").agg(F.count("*").cast("double").alias("seen"))
    e = catalog(spark, d).join(n, "event_id", "left").select("event_id", "popularity", "price_min", F.coalesce("seen", F.lit(0.0)).alias("seen"))
    names = ["popularity", "price_min", "seen"]
    return H.standardised(e, names).select("event_id", *[(F.round(f"z_{c}", 6) + F.lit(0.0)).alias(f"z_{c}") for c in names])


@query(sql("SELECT c.event_id, round(ln(greatest(1,count(i.id))),6) AS views_log, round(ln(greatest(1,count(CASE WHEN kind='like' THEN 1 END))),6) AS likes_log, round(ln(greatest(1,count(CASE WHEN kind='going' THEN 1 END))),6) AS going_log, round(count(CASE WHEN kind='like' THEN 1 END)/greatest(1,count(i.id))::double,6) AS like_rate, round(count(CASE WHEN kind='going' THEN 1 END)/greatest(1,count(i.id))::double,6) AS going_rate, round(count(CASE WHEN kind IN ('like','going') THEN 1 END)/greatest(1,count(i.id))::double,6) AS engagement_rate FROM catalog c LEFT JOIN interactions i ON i.event_id=c.event_id GROUP BY c.event_id", "catalog", "interactions"))
def engagement_features(spark, d):
    """Logarithms of an event's interactions, likes and goings, and their rates; events without any have zeros."""
    has = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    n = interactions(spark, d).groupBy("event_id").agg(F.count("*").alias("n"), has("like").alias("likes"), has("going").alias("going"))
    e = catalog(spark, d).select("event_id").join(n, "event_id", "left").fillna(0)
    log = lambda c: F.round(F.log(F.greatest(F.lit(1), F.col(c)).cast("double")), 6)
    rate = lambda c: F.round(c / F.greatest(F.lit(1), F.col("n")), 6)
    return e.select("event_id", log("n").alias("views_log"), log("likes").alias("likes_log"), log("going").alias("going_log"), rate(F.col("likes")).alias("like_rate"), rate(F.col("going")).alias("going_rate"), rate(F.col("likes") + F.col("going")).alias("engagement_rate"))


@query(sql("SELECT event_id, round(greatest(0.0,least(1.0,popularity+(((event_id%1000003)*7919+7*104729)%2001-1000)/1000.0::double*0.1::double)),6)::double AS score FROM catalog", "catalog"))
def popularity_fallback(spark, d):
    return R.popularity_fallback(catalog(spark, d), seed=7).withColumn("score", F.round("score", 6))
