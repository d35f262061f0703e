"""Registered queries of recommendation."""

from pyspark.sql import functions as F

from lumenfare.functions import dates, geo
from lumenfare.functions import scores as S
from lumenfare.operators import catalog as C
from lumenfare.operators import recommend as R
from lumenfare.plans.catalog import candidate_pool
from lumenfare.plans.query import ORACLE, query
from lumenfare.sources.tables import as_of, catalog, interactions, read, sql, venues

NOW = "timestamp '2024-01-15 00:00:00'"
_W = "CASE kind WHEN 'like' THEN 1.0 WHEN 'going' THEN 2.0 WHEN 'went' THEN 1.5 WHEN 'save' THEN 0.8 ELSE -0.5 END"


@query(sql(f"SELECT genre, round((w/sum(w) OVER ())::double,6) AS share FROM (SELECT g AS genre, sum(1+COALESCE(w,0))::double AS w FROM (SELECT unnest(genres) AS g, w FROM catalog LEFT JOIN (SELECT event_id, sum({_W}) AS w FROM interactions GROUP BY event_id) USING (event_id)) GROUP BY g)", "catalog", "interactions"))
def popularity_distribution(spark, d):
    return R.genre_popularity(catalog(spark, d), interactions(spark, d)).withColumn("share", F.round("share", 6))


@query(sql(f"SELECT event_id, popularity, row_number() OVER (ORDER BY popularity DESC, date_time, event_id) AS rank FROM catalog WHERE status='active' AND date_time>{NOW} QUALIFY rank<=20", "catalog"))
def popular_events(spark, d):
    from pyspark.sql import Window as W

    order = [F.desc("popularity"), "date_time", "event_id"]
    e = C.upcoming(catalog(spark, d), as_of()).orderBy(*order).limit(20)
    return e.select("event_id", "popularity", F.row_number().over(W.orderBy(*order)).cast("long").alias("rank"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id%50=0) SELECT query_id, vec_id, round(list_cosine_similarity(embedding::double[],q::double[]),6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::double[],q::double[]),6) DESC, vec_id) AS rank FROM embeddings, q WHERE vec_id<>query_id QUALIFY rank<=5")
def cosine_topk(spark, d):
    """Every fiftieth vector is a stated query; the others meet all of them in blocks."""
    v = read(spark, d, "embeddings")
    return R.nearest(v, v.where("vec_id % 50 = 0"), 5).withColumn("rank", F.col("rank").cast("long"))


@query("WITH c AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::double[]) AS x FROM embeddings) GROUP BY ALL) GROUP BY label), s AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::double[],p) AS s FROM embeddings, c) SELECT vec_id, label, round(s,5) AS score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label)=1")
def nearest_prototype(spark, d):
    """The label whose mean vector is nearest; there are as many prototypes as labels."""
    v = read(spark, d, "embeddings")
    m = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    p = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
    p = p.select(F.col("label").alias("vec_id"), F.col("p").alias("embedding"))
    best = R.assigned(v.select("vec_id", "embedding"), p)
    return best.select("vec_id", F.col("query_id").alias("label"), F.round("score", 5).alias("score"))


@query(sql("WITH o AS (SELECT * FROM catalog JOIN venues USING (venue_id) WHERE event_id=42), s AS (SELECT c.event_id, 0.5::double*len(list_intersect(c.genres,o.genres))/greatest(len(list_distinct(c.genres)),len(o.genres)) + CASE WHEN c.venue_id=o.venue_id THEN 0.3 ELSE 0 END::double + CASE WHEN v.neighborhood=o.neighborhood THEN 0.2 ELSE 0 END::double AS score FROM catalog c JOIN venues v USING (venue_id), o WHERE c.event_id<>42) SELECT event_id, round(score,6) AS score, row_number() OVER (ORDER BY round(score,6) DESC, event_id) AS rank FROM s WHERE score>0 QUALIFY rank<=20", "catalog", "venues"))
def similar_events(spark, d):
    e = C.with_venue(catalog(spark, d), venues(spark, d), "inner")
    s = R.similar_events(e, 42).withColumn("score", F.round("score", 6))
    return R.top(s, "score", 20, "event_id").select("event_id", "score", F.col("rank").cast("long").alias("rank"))


_JAC = "len(list_intersect(list_distinct(genres),['small','ring']))/len(list_distinct(list_concat(genres,['small','ring'])))::double"
_CONTENT = f"0.6::double*({_JAC}) + 0.2::double*CASE WHEN COALESCE(price_min,0)+COALESCE(price_max,0)>0 THEN exp(-2*abs(COALESCE(price_min,0)+COALESCE(price_max,0)-2200)/greatest(COALESCE(price_min,0)+COALESCE(price_max,0),2200)) ELSE 0 END + 0.2::double*(1-least(abs(hour(date_time)/23.0::double-20/23.0::double),1-abs(hour(date_time)/23.0::double-20/23.0::double)))"


def _content(df):
    like = S.jaccard(F.col("genres"), F.array(F.lit("small"), F.lit("ring")))
    price = S.price_similarity(F.col("price_min"), F.col("price_max"), F.lit(1100.0), F.lit(1100.0))
    return 0.6 * like + 0.2 * price + 0.2 * S.hour_similarity(F.hour("date_time") / 23.0, F.lit(20 / 23.0))


@query(sql(f"SELECT event_id, round(0.8::double*({_CONTENT})+0.2::double*popularity,6) AS score FROM catalog", "catalog"))
def content_score(spark, d):
    e = catalog(spark, d)
    return e.select("event_id", F.round(0.8 * _content(e) + 0.2 * F.col("popularity"), 6).alias("score"))


@query(sql("WITH c AS (SELECT event_id, genres, popularity AS score FROM catalog WHERE event_id<100), p AS (SELECT b.event_id, sum(len(list_intersect(a.genres,b.genres))/len(list_distinct(list_concat(a.genres,b.genres)))::double) AS j FROM c a JOIN c b ON a.event_id<>b.event_id AND (a.score>b.score OR (a.score=b.score AND a.event_id<b.event_id)) GROUP BY b.event_id) SELECT event_id, round(greatest(0,least(1,score-0.05::double*COALESCE(j,0))),6)::double AS score FROM c LEFT JOIN p USING (event_id)", "catalog"))
def diversity_penalty(spark, d):
    """The hundred candidates of one request."""
    c = catalog(spark, d).where("event_id < 100").select("event_id", "genres", F.col("popularity").alias("score"))
    return R.diversity_penalty(c, 0.05).select("event_id", F.round("score", 6).alias("score"))


@query(ORACLE["diversity_penalty"].replace("FROM catalog WHERE event_id<100)", f"FROM catalog WHERE event_id IN (SELECT event_id FROM ({ORACLE['candidate_pool']})))"))
def diversity_penalty_pool(spark, d):
    """diversity_penalty of the candidates of one request, as candidate_pool gives them."""
    c = catalog(spark, d).join(candidate_pool(spark, d).select("event_id"), "event_id", "left_semi").select("event_id", "genres", F.col("popularity").alias("score"))
    return R.diversity_penalty(c, 0.05).select("event_id", F.round("score", 6).alias("score"))


@query(sql(f"SELECT event_id, round(s,6) AS score, row_number() OVER (ORDER BY round(s,6) DESC, event_id) AS rank FROM (SELECT event_id, 0.7::double*({_CONTENT})+0.3::double*popularity AS s FROM catalog) QUALIFY rank<=50", "catalog"))
def hybrid_rerank(spark, d):
    e = catalog(spark, d)
    s = e.select("event_id", F.round(0.7 * _content(e) + 0.3 * F.col("popularity"), 6).alias("score"))
    return R.top(s, "score", 50, "event_id").withColumn("rank", F.col("rank").cast("long"))


_KM = "6371.0*acos(least(1.0,greatest(-1.0,cos(radians(55.6761::double))*cos(radians(lat))*cos(radians(lon)-radians(12.5683::double))+sin(radians(55.6761::double))*sin(radians(lat)))))"
_DAYS = f"floor((epoch_us(date_time)-epoch_us({NOW}))/86400000000.0)"


@query(sql(f"SELECT event_id, round(0.5::double*({_JAC})+0.2::double/(1+{_KM}/5)+0.15::double*CASE WHEN {_DAYS}<0 THEN 0.0 WHEN {_DAYS}<=7 THEN 1.0 WHEN {_DAYS}<=30 THEN 0.8 WHEN {_DAYS}<=90 THEN 0.6 ELSE 0.3 END+0.15::double*popularity,6) AS score FROM catalog JOIN venues USING (venue_id)", "catalog", "venues"))
def hybrid_weighted(spark, d):
    """Nearer is better."""
    e = C.with_venue(catalog(spark, d), venues(spark, d), "inner")
    km = geo.cosine_law_km(F.lit(55.6761), F.lit(12.5683), F.col("lat"), F.col("lon"))
    like = S.jaccard(F.col("genres"), F.array(F.lit("small"), F.lit("ring")))
    score = 0.5 * like + 0.2 * geo.nearness(km) + 0.15 * S.recency(dates.days_until(F.col("date_time"), as_of())) + 0.15 * F.col("popularity")
    return e.select("event_id", F.round(score, 6).alias("score"))


@query(sql(f"SELECT event_id, array_to_string(list_filter([CASE WHEN len(list_intersect(genres,['small','ring']))>0 THEN 'genres ' || array_to_string(list_sort(list_filter(list_distinct(genres), lambda g: list_contains(['small','ring'],g))),'+') END, CASE WHEN {_KM}<=5 THEN 'near' END, CASE WHEN price_min<=1000 THEN 'price' END], lambda x: x IS NOT NULL),'; ') AS reasons FROM catalog JOIN venues USING (venue_id)", "catalog", "venues"))
def explanations(spark, d):
    e = C.with_venue(catalog(spark, d), venues(spark, d), "inner")
    km = geo.cosine_law_km(F.lit(55.6761), F.lit(12.5683), F.col("lat"), F.col("lon"))
    both = F.array_sort(F.array_intersect("genres", F.array(F.lit("small"), F.lit("ring"))))
    why = F.array(F.when(F.size(both) > 0, F.concat(F.lit("genres "), F.array_join(both, "+"))), F.when(km <= 5, "near"), F.when(F.col("price_min") <= 1000, "price"))
    return e.select("event_id", F.array_join(F.array_compact(why), "; ").alias("reasons"))


@query(sql(f"SELECT event_id, round(100*(0.3::double*CASE WHEN venue_id<10 THEN 1.0 ELSE 0.5 END+0.2::double*CASE WHEN COALESCE(price_min,0)<=1000 THEN 1.0 ELSE 0.6 END+0.15::double*CASE WHEN {_DAYS}<1 THEN 1.0 WHEN {_DAYS}<=7 THEN 0.9 WHEN {_DAYS}<=30 THEN 0.8 ELSE 0.6 END+0.2::double*0.5+0.15::double*0.7))::bigint AS match_percent FROM catalog", "catalog"))
def match_percent(spark, d):
    days = dates.days_until(F.col("date_time"), as_of())
    time = F.when(days < 1, 1.0).when(days <= 7, 0.9).when(days <= 30, 0.8).otherwise(0.6)
    venue, price = F.when(F.col("venue_id") < 10, 1.0).otherwise(0.5), F.when(F.coalesce("price_min", F.lit(0.0)) <= 1000, 1.0).otherwise(0.6)
    return catalog(spark, d).select("event_id", F.round(100 * (0.3 * venue + 0.2 * price + 0.15 * time + 0.2 * 0.5 + 0.15 * 0.7)).cast("long").alias("match_percent"))


_WIN = "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM interactions), w AS (SELECT id, user_id, event_id, ts, n, ts AS win FROM r WHERE n=1 UNION ALL SELECT r.id, r.user_id, r.event_id, r.ts, r.n, CASE WHEN r.ts - w.win <= INTERVAL 24 HOUR THEN w.win ELSE r.ts END FROM w JOIN r ON r.user_id=w.user_id AND r.n=w.n+1)"


def _windows(spark, d):
    return R.anchored_windows(interactions(spark, d).select("id", "user_id", "event_id", "ts"), "user_id", "ts")


def _recursive(body: str) -> str:
    return sql(body, "interactions").replace("WITH ", "WITH RECURSIVE ", 1).replace(" FROM events)", f" FROM events), {_WIN}", 1)


@query(_recursive("SELECT id, user_id, event_id, ts, win FROM w"))
def anchored_windows(spark, d):
    return R.chained_windows(interactions(spark, d).select("id", "user_id", "event_id", "ts"), "user_id", "ts")


@query(_recursive(", p AS (SELECT DISTINCT user_id, win, event_id AS e FROM w), c AS (SELECT a.e AS a, b.e AS b, count(*) AS n FROM p a JOIN p b ON a.user_id=b.user_id AND a.win=b.win AND a.e<b.e GROUP BY ALL) SELECT a, b, n, round(n/max(n) OVER (),6) AS weight FROM c"))
def cooccurrence(spark, d):
    return R.cooccurrence(_windows(spark, d), "user_id").withColumn("weight", F.round("weight", 6))


@query(sql("SELECT source, target, count(*) AS n FROM (SELECT kind AS source, lead(kind) OVER (PARTITION BY user_id ORDER BY ts, id) AS target FROM interactions) WHERE target IS NOT NULL GROUP BY ALL", "interactions"))
def kind_transitions(spark, d):
    return R.transitions(interactions(spark, d), "user_id", ["ts", "id"], "kind")


@query(sql("SELECT source, target, count(*) AS n FROM (SELECT g AS source, lead(g) OVER (PARTITION BY user_id ORDER BY ts, id, pos) AS target FROM (SELECT user_id, ts, id, unnest(range(len(genres))) AS pos, unnest(genres) AS g FROM interactions JOIN catalog USING (event_id) WHERE kind='like')) WHERE target IS NOT NULL GROUP BY ALL", "interactions", "catalog"))
def genre_transitions(spark, d):
    i = interactions(spark, d).where("kind = 'like'").join(catalog(spark, d).select("event_id", "genres"), "event_id")
    g = i.select("user_id", "ts", "id", F.posexplode("genres").alias("pos", "genre"))
    return R.transitions(g, "user_id", ["ts", "id", "pos"], "genre")


@query(sql("SELECT context, count(*) AS n, round(count(CASE WHEN kind IN ('like','going') THEN 1 END)/count(*)::double,6) AS positive FROM (SELECT kind, unnest(list_filter([CASE WHEN isodow(ts)>=6 THEN 'weekend' ELSE 'weekday' END, CASE WHEN hour(ts)>=22 THEN 'late' WHEN hour(ts)<=20 THEN 'early' END], lambda x: x IS NOT NULL)) AS context FROM interactions) GROUP BY context", "interactions"))
def context_segments(spark, d):
    tags = F.array_compact(F.array(F.when(F.weekday("ts") >= 5, "weekend").otherwise("weekday"), F.when(F.hour("ts") >= 22, "late").when(F.hour("ts") <= 20, "early")))
    c = interactions(spark, d).select("kind", F.explode(tags).alias("context"))
    return c.groupBy("context").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("kind").isin("like", "going")) / F.count("*"), 6).alias("positive"))


@query(sql("SELECT user_id, event_id FROM interactions GROUP BY ALL HAVING count(*)=1", "interactions"))
def only_visits(spark, d):
    return interactions(spark, d).groupBy("user_id", "event_id").count().where("count = 1").select("user_id", "event_id")


@query()
def als_topk(spark, d):
    """Top five unseen items of every user by implicit alternating least squares with a fixed seed."""
    from pyspark.ml.recommendation import ALS

    i = interactions(spark, d).groupBy(F.col("user_id").cast("int").alias("user_id"), F.col("event_id").cast("int").alias("event_id")).agg(F.sum(R.weight(F.col("kind"), F.col("rating"))).alias("w")).where("w > 0")
    model = ALS(rank=16, maxIter=5, implicitPrefs=True, userCol="user_id", itemCol="event_id", ratingCol="w", seed=3).fit(i)
    return R.unseen_topk(model, i, 5)
