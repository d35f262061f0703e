"""Registered queries of content and hybrid scores over whole feature rows."""

from pyspark.sql import functions as F

from lumenfare.functions import dates
from lumenfare.functions import extract as E
from lumenfare.operators import catalog as C
from lumenfare.operators import hybrid as H
from lumenfare.operators import landing as L
from lumenfare.operators import recommend as R
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, interactions, read, sql, venues

NOW = "timestamp '2024-01-15 00:00:00'"
LIKED = ["small", "ring"]
LAT, LON, HOURS, DAYS, BUDGET = 55.68, 12.55, [20, 21, 22], [4, 5, 6], (1000.0, 1200.0)

#: Events with up to two artists of forty by rule, their venue, and one of the vectors.
_E = "ev AS MATERIALIZED (SELECT c.*, list_transform(range(0,(event_id%3)::bigint), lambda i: 'Artist ' || ((event_id*7+i*11)%40)) AS artists, name AS venue_name, neighborhood, lat, lon, embedding::double[] AS embedding FROM catalog c JOIN venues USING (venue_id) JOIN embeddings ON vec_id=event_id%(SELECT count(*) FROM embeddings))"


def events(spark, d):
    k = F.col("event_id")
    artists = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.concat(F.lit("Artist "), ((k * 7 + i * 11) % 40).cast("string")))
    e = C.with_venue(catalog(spark, d), venues(spark, d), "inner").withColumn("artists", F.slice(artists, F.lit(1), (k % 3).cast("int")))
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(F.broadcast(v.agg(F.count("*").alias("n_vectors")))).withColumn("vec_id", k % F.col("n_vectors")).join(v, "vec_id")


_PER = "per AS MATERIALIZED (SELECT event_id, sum(CASE kind WHEN 'like' THEN 1.0 WHEN 'going' THEN 2.0 WHEN 'went' THEN 1.5 WHEN 'save' THEN 0.5 ELSE 0.0 END)::double AS w FROM interactions GROUP BY event_id)"


def _shares(part: str, names: str) -> str:
    return f"k_{part} AS MATERIALIZED (SELECT event_id, unnest({names}) AS name FROM ev), s_{part} AS MATERIALIZED (SELECT name, w/sum(w) OVER () AS share FROM (SELECT name, sum(1+COALESCE(w,0)) AS w FROM k_{part} LEFT JOIN per USING (event_id) GROUP BY name)), m_{part} AS MATERIALIZED (SELECT event_id, avg(share) AS share FROM k_{part} JOIN s_{part} USING (name) GROUP BY event_id)"


_POP = f"{_E}, {_PER}, {_shares('genre', 'genres')}, {_shares('artist', 'artists')}, {_shares('venue', '[venue_name]')}, pop AS MATERIALIZED (SELECT event_id, (COALESCE(g.share,0)+COALESCE(a.share,0)+COALESCE(v.share,0)+popularity)/4 AS popular FROM ev LEFT JOIN m_genre g USING (event_id) LEFT JOIN m_artist a USING (event_id) LEFT JOIN m_venue v USING (event_id))"
_TABLES = ("catalog", "venues", "interactions")


@query(sql(f", {_POP} SELECT 'genre' AS part, name, round(share,9) AS share FROM s_genre UNION ALL SELECT 'artist', name, round(share,9) FROM s_artist UNION ALL SELECT 'venue', name, round(share,9) FROM s_venue", *_TABLES))
def popularity_shares(spark, d):
    parts = {"genre": F.col("genres"), "artist": F.col("artists"), "venue": F.array("venue_name")}
    return H.shares(events(spark, d), parts, interactions(spark, d)).withColumn("share", F.round("share", 9))


_WISH = f"wish AS MATERIALIZED (SELECT list(m ORDER BY i) AS p FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM ev WHERE len(list_intersect(genres,{LIKED}))>0) GROUP BY i))"
_RING = f"greatest(abs(floor(lat/0.01::double)-floor({LAT}::double/0.01::double)),abs(floor(lon/0.01::double)-floor({LON}::double/0.01::double)))"
_SUM = "(COALESCE(price_min,0)+COALESCE(price_max,0))"
_HOUR, _DAY = sum(HOURS) / len(HOURS) / 23, sum(DAYS) / len(DAYS) / 6
_SIM = f"greatest(0.0,least(1.0,0.6::double*list_cosine_similarity(embedding,p)+0.2::double*len(list_intersect(list_distinct(genres),{LIKED}))/len(list_distinct(list_concat(genres,{LIKED})))::double+0.1::double*CASE {_RING} WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.5 ELSE 0.0 END+0.05::double*CASE WHEN {_SUM}>0 THEN exp(-2*abs({_SUM}-2200.0)/greatest({_SUM},2200.0)) ELSE 0.0 END+0.05::double*(1-least(abs(hour(date_time)/23.0::double-{_HOUR}::double),1-abs(hour(date_time)/23.0::double-{_HOUR}::double))+1-abs((isodow(date_time)-1)/6.0::double-{_DAY}::double))/2))"
_CONTENT = f"{_POP}, {_WISH}, con AS MATERIALIZED (SELECT event_id, 0.8::double*({_SIM})+0.2::double*popular AS content FROM ev JOIN pop USING (event_id), wish)"


def _content(spark, d):
    e = events(spark, d)
    p = H.popularity(e, interactions(spark, d)).join(F.broadcast(H.wish_vector(e, F.array(*map(F.lit, LIKED)))))
    wish = {"embedding": F.col("wish"), "genres": F.array(*map(F.lit, LIKED)), "lat": F.lit(LAT), "lon": F.lit(LON), "price_min": F.lit(BUDGET[0]), "price_max": F.lit(BUDGET[1]), "hour": F.lit(_HOUR), "day": F.lit(_DAY)}
    return p.withColumn("content", 0.8 * H.content_similarity(wish) + 0.2 * F.col("popular"))


@query(sql(f", {_CONTENT} SELECT event_id, round(content,5) AS score FROM con", *_TABLES))
def content_recommend(spark, d):
    """Text, genres, cells, prices and times against one user's wishes, and the popularity of genres, artists and venue."""
    return _content(spark, d).select("event_id", F.round("content", 5).alias("score"))


@query(sql(f", {_CONTENT}, c AS MATERIALIZED (SELECT event_id, genres, round(content,5) AS score FROM con JOIN ev USING (event_id) ORDER BY score DESC, event_id LIMIT 100), p AS (SELECT b.event_id, sum(len(list_intersect(a.genres,b.genres))/len(list_distinct(list_concat(a.genres,b.genres)))::double) AS j FROM c a JOIN c b ON a.score>b.score OR (a.score=b.score AND a.event_id<b.event_id) GROUP BY b.event_id), s AS (SELECT event_id, round(greatest(0,least(1,score-0.1::double*COALESCE(j,0))),5)::double AS score FROM c LEFT JOIN p USING (event_id)) SELECT event_id, score, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM s QUALIFY rank<=20", *_TABLES))
def content_ranked(spark, d):
    """The content recommender to its end: the hundred best by content, each less a tenth of its likeness to better ones,
    and the best twenty of these."""
    c = _content(spark, d).select("event_id", "genres", F.round("content", 5).alias("score"))
    c = R.top(c, "score", 100, "event_id").drop("rank")
    s = R.diversity_penalty(c, 0.1).select("event_id", F.round("score", 5).alias("score"))
    return R.top(s, "score", 20, "event_id").withColumn("rank", F.col("rank").cast("long"))


_KM = f"2*6371.0::double*asin(sqrt(least(1.0,pow(sin(radians(lat-{LAT}::double)/2),2)+cos(radians({LAT}::double))*cos(radians(lat))*pow(sin(radians(lon-{LON}::double)/2),2))))"
_DAYS = f"floor((epoch_us(date_time)-epoch_us({NOW}))/86400000000.0)"
_ROW = f"coll AS (SELECT b.event_id, count(*)/max(count(*)) OVER ()::double AS collaborative FROM interactions a JOIN interactions b ON a.user_id=8 AND a.kind='like' AND b.user_id=a.user_id AND b.kind='save' GROUP BY b.event_id), ft AS (SELECT event_id, content, COALESCE(collaborative,0)::double AS collaborative, {_KM} AS distance_km, CASE WHEN COALESCE(price_min,0)=0 THEN 1.0 WHEN least(price_max,1200.0)-greatest(price_min,1000.0)<0 THEN 0.0 ELSE least(1.0,(least(price_max,1200.0)-greatest(price_min,1000.0))/least(price_max-price_min,200.0)) END::double AS price, CASE WHEN {_DAYS}<0 THEN 0.0 WHEN {_DAYS}<=7 THEN 1.0 WHEN {_DAYS}<=30 THEN 0.8 WHEN {_DAYS}<=90 THEN 0.6 ELSE 0.3 END::double AS recency, popularity, 1/(1+count(*) OVER (PARTITION BY venue_id)*0.1::double) AS diversity, greatest(0.0,1-least(abs(20-hour(date_time)),abs(21-hour(date_time)),abs(22-hour(date_time)))/12.0::double)*0.5::double + CASE WHEN isodow(date_time)-1 IN (4,5,6) THEN 0.5 ELSE 0.0 END::double AS time_match FROM ev JOIN con USING (event_id) LEFT JOIN coll USING (event_id))"


def _features(spark, d):
    i = interactions(spark, d).where("user_id = 8")
    likes = i.where("kind = 'like'").agg(F.count("*").alias("likes"))
    saved = i.where("kind = 'save'").groupBy("event_id").agg(F.count("*").alias("n")).join(F.broadcast(likes)).select("event_id", (F.col("n") * F.col("likes")).alias("n"))
    coll = saved.join(F.broadcast(saved.agg(F.max("n").alias("most")))).select("event_id", (F.col("n") / F.col("most")).alias("collaborative")).where("collaborative is not null")
    return H.feature_row(_content(spark, d).join(coll, "event_id", "left"), as_of(), LAT, LON, BUDGET, HOURS, DAYS)


_EIGHT = ["content", "collaborative", "distance_km", "price", "recency", "popularity", "diversity", "time_match"]


@query(sql(f", {_CONTENT}, {_ROW} SELECT event_id, {', '.join(f'round({c},5) AS {c}' for c in _EIGHT)} FROM ft", *_TABLES))
def ranker_features(spark, d):
    return _features(spark, d).select("event_id", *[F.round(c, 5).alias(c) for c in _EIGHT])


@query(sql(f", {_CONTENT}, {_ROW}, s AS (SELECT event_id, round(0.35::double*content+0.25::double*collaborative+0.15::double/(1+distance_km/5)+0.05::double*(price+recency+popularity+diversity+time_match),5) AS score, round(0.35::double*content+0.25::double*collaborative+0.15::double*(1-1/(1+distance_km/5))+0.05::double*(price+recency+popularity+diversity+time_match),5) AS far_score FROM ft) SELECT event_id, score, far_score, row_number() OVER (ORDER BY score DESC, event_id) AS rank FROM s QUALIFY rank<=50", *_TABLES))
def hybrid_recommend(spark, d):
    """The best fifty by eight weighted features; far_score is the same with distance the wrong way round."""
    s = _features(spark, d).select("event_id", F.round(H.weighted(), 5).alias("score"), F.round(H.weighted(farther_is_better=True), 5).alias("far_score"))
    return R.top(s, "score", 50, "event_id").withColumn("rank", F.col("rank").cast("long"))


_CHOSEN = "ch AS MATERIALIZED (SELECT list_distinct(flatten(list(genres))) AS g, list_distinct(flatten(list(artists))) AS a, list(DISTINCT lower(venue_name)) AS v FROM (SELECT * FROM ev ORDER BY popularity DESC, event_id LIMIT 10))"


@query(sql(f", {_E}, {_CHOSEN}, x AS (SELECT event_id, 1-len(list_intersect(list_distinct(genres),g))/len(g)::double AS gd, CASE WHEN list_contains(v,lower(venue_name)) THEN 0.0 ELSE 1.0 END::double AS vd, 1-len(list_intersect(list_distinct(artists),a))/len(a)::double AS ad FROM ev, ch) SELECT event_id, round(gd,6) AS genre_diversity, vd AS venue_diversity, round(ad,6) AS artist_diversity, round((gd+vd+ad)/3,6) AS diversity FROM x", "catalog", "venues"))
def diversity_features(spark, d):
    """Every event against the ten most popular ones."""
    e = events(spark, d)
    r = H.diversity_from(e.orderBy(F.desc("popularity"), "event_id").limit(10), e)
    return r.select("event_id", *[F.round(c, 6).alias(c) for c in ("genre_diversity", "venue_diversity", "artist_diversity", "diversity")])


def _km(lat: float, lon: float) -> str:
    return _KM.replace(str(LAT), str(lat)).replace(str(LON), str(lon))


@query(sql(f"SELECT venue_id, round({_km(*H.CENTRE)},6) AS from_centre, {_km(*H.CENTRE)}<3 AS is_central, round({_KM},6) AS from_user, {_KM}<5 AS is_nearby, {_KM}<2 AS is_walkable FROM venues", "venues"))
def geo_features(spark, d):
    g = venues(spark, d).select("venue_id", *H.geo_features(F.col("lat"), F.col("lon"), LAT, LON))
    return g.withColumns({c: F.round(c, 6) for c in ("from_centre", "from_user")})


_A, _B = "COALESCE(price_min,0)", "COALESCE(NULLIF(price_max,0),price_min,0)"


@query(sql(f"SELECT event_id, round(({_A}+{_B})/2,6) AS price_avg, round({_B}-{_A},6) AS price_range, {_B}=0 AS is_free, round({_A}/350.0,6) AS low_share, round({_B}/350.0,6) AS high_share, {_B}<200 AS is_budget, {_B} BETWEEN 200 AND 500 AS is_mid_range, {_B}>500 AS is_premium, round(greatest(0.0,least({_B},1200.0)-greatest({_A},1000.0))/least(200.0,COALESCE(NULLIF({_B}-{_A},0),1.0)),6) AS budget_overlap, {_A}<=1200 AS is_affordable, {_B}<=1200 AS is_within_budget, round(({_A}+{_B})/2/1200.0,6) AS budget_ratio FROM catalog", "catalog"))
def price_feature_row(spark, d):
    p = catalog(spark, d).select("event_id", *H.price_features(F.col("price_min"), F.col("price_max"), BUDGET))
    return p.withColumns({c: F.round(c, 6) for c, t in p.dtypes if t == "double"})


@query(sql(f"SELECT event_id, round(sin(2*pi()*hour(date_time)/24),6)+0.0 AS hour_sin, round(cos(2*pi()*hour(date_time)/24),6)+0.0 AS hour_cos, hour(date_time) BETWEEN 19 AND 23 AS is_peak, round(sin(2*pi()*(isodow(date_time)-1)/7),6)+0.0 AS day_sin, round(cos(2*pi()*(isodow(date_time)-1)/7),6)+0.0 AS day_cos, isodow(date_time)>=5 AS is_weekend, round(sin(2*pi()*month(date_time)/12),6)+0.0 AS month_sin, round(cos(2*pi()*month(date_time)/12),6)+0.0 AS month_cos, {_DAYS}::bigint AS days_until, round(ln(greatest(1,{_DAYS})),6) AS days_log, {_DAYS} BETWEEN 0 AND 7 AS is_this_week, {_DAYS} BETWEEN 0 AND 30 AS is_this_month, round((month(date_time)-1)/11.0::double,6) AS month_share, round((isodow(date_time)-1)/6.0::double,6) AS day_share FROM catalog", "catalog"))
def time_feature_row(spark, d):
    t = catalog(spark, d).select("event_id", *H.time_features(F.col("date_time"), as_of()))
    return t.withColumns({c: F.round(c, 6) + F.lit(0.0) for c, kind in t.dtypes if kind == "double"})


@query(sql(f", {_E} SELECT event_id, length(title) AS title_length, CASE WHEN event_id%2=0 THEN 0 ELSE 5 END AS description_length, event_id%2=1 AS has_description, len(genres) AS n_genres, len(artists) AS n_artists, {', '.join(f'list_contains(genres,{chr(39)}{g}{chr(39)}) AS genre_{g}' for g in H.FLAGGED)}, CASE WHEN event_id%2=0 THEN 0 ELSE length(venue_name)+5 END AS venue_length, event_id%2=1 AS is_famous FROM ev", "catalog", "venues"))
def content_feature_row(spark, d):
    """Every second event has a description and a venue with a well-known word in its name."""
    odd = F.col("event_id") % 2 == 1
    c = events(spark, d).select("event_id", *H.content_features(F.col("title"), F.when(odd, "about"), F.col("genres"), F.col("artists"), F.when(odd, F.concat(F.lit("Vega "), "venue_name"))))
    return c.withColumns({k: F.col(k).cast("long") for k, t in c.dtypes if t == "int"})


@query(sql(f"SELECT event_id, CASE WHEN is_liked THEN 1.0 WHEN is_disliked THEN 0.1 ELSE 0.8 END AS history, round(100*(0.3::double*venue+0.2::double*price+0.15::double*timing+0.2::double*CASE WHEN is_liked THEN 1.0 WHEN is_disliked THEN 0.1 ELSE 0.8 END::double+0.15::double*standing))::bigint AS match_percent FROM (SELECT event_id, CASE event_id%3 WHEN 0 THEN 0.85 WHEN 1 THEN 1.0 ELSE 0.7 END::double AS venue, CASE event_id%3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.7 END::double AS standing, CASE WHEN ({_A}+COALESCE(price_max,0))/2=0 THEN 1.0 WHEN ({_A}+COALESCE(price_max,0))/2<=550 THEN 1.0 WHEN ({_A}+COALESCE(price_max,0))/2<=1100 THEN 0.8 WHEN ({_A}+COALESCE(price_max,0))/2<=1650 THEN 0.5 ELSE 0.2 END::double AS price, CASE WHEN epoch_us(date_time)-epoch_us({NOW})<86400000000 THEN 1.0 WHEN epoch_us(date_time)-epoch_us({NOW})<=7*86400000000 THEN 0.9 WHEN epoch_us(date_time)-epoch_us({NOW})<=30*86400000000 THEN 0.8 ELSE 0.6 END::double AS timing, event_id IN (SELECT event_id FROM interactions WHERE user_id=8 AND kind='like') AS is_liked, event_id IN (SELECT event_id FROM interactions WHERE user_id=8 AND kind='dislike') AS is_disliked FROM catalog)", "catalog", "interactions").replace("CASE WHEN is_liked THEN 1.0 WHEN is_disliked THEN 0.1 ELSE 0.8 END AS history", "CASE WHEN is_liked THEN 1.0 WHEN is_disliked THEN 0.1 ELSE 0.8 END::double AS history"))
def match_percent_of_user(spark, d):
    """A card's match: standing of venue and source, price against the user's cap, days until, and the user's votes."""
    i = interactions(spark, d).where("user_id = 8")
    voted = i.groupBy("event_id").agg(F.max((F.col("kind") == "like").cast("int")).alias("liked"), F.max((F.col("kind") == "dislike").cast("int")).alias("disliked"))
    e = catalog(spark, d).join(voted, "event_id", "left")
    pick = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 3 + 1).cast("int"))
    venue, standing = E.looked_up(pick("Culture Box", "Noma", "Elsewhere"), E.VENUE_STANDING, 0.7), E.looked_up(pick("store_vega", "nordic_techkomm", "elsewhere"), E.SOURCE_STANDING, 0.7)
    mean = (F.coalesce("price_min", F.lit(0.0)) + F.coalesce("price_max", F.lit(0.0))) / 2
    price = F.when(mean <= 550, 1.0).when(mean <= 1100, 0.8).when(mean <= 1650, 0.5).otherwise(0.2)
    days = (dates.micros(F.col("date_time")) - dates.micros(as_of())) / 86400e6
    timing = F.when(days < 1, 1.0).when(days <= 7, 0.9).when(days <= 30, 0.8).otherwise(0.6)
    history = F.when(F.col("liked") == 1, 1.0).when(F.col("disliked") == 1, 0.1).otherwise(0.8)
    return e.select("event_id", history.alias("history"), F.round(100 * (0.3 * venue + 0.2 * price + 0.15 * timing + 0.2 * history + 0.15 * standing)).cast("long").alias("match_percent"))


@query(sql(f", {_E}, old AS (SELECT * FROM ev WHERE event_id%2=0), known AS (SELECT name, row_number() OVER (ORDER BY name) AS n FROM (SELECT DISTINCT unnest(artists) AS name FROM old WHERE event_id%4=0)), new AS (SELECT * FROM ev WHERE event_id%2=1 AND (venue_id, date_time::date) NOT IN (SELECT (venue_id, date_time::date) FROM old WHERE status<>'cancelled') QUALIFY row_number() OVER (PARTITION BY venue_id, date_time::date ORDER BY event_id)=1) SELECT DISTINCT event_id, name, COALESCE('known ' || name, sha256(name)) AS artist_id FROM (SELECT event_id, unnest(artists) AS name FROM new) LEFT JOIN known USING (name)".replace("COALESCE('known ' || name, sha256(name))", "CASE WHEN n IS NULL THEN sha256(name) ELSE 'known ' || name END"), "catalog", "venues"))
def stored_artist_links(spark, d):
    """Odd events are stored after the even ones, one a venue and day, and linked with their artists; those of every
    fourth event are known before."""
    e = events(spark, d)
    old = e.where("event_id % 2 = 0")
    known = old.where("event_id % 4 = 0").select(F.explode("artists").alias("name")).distinct().select(F.concat(F.lit("known "), "name").alias("artist_id"), "name")
    stored = L.one_a_day(e.where("event_id % 2 = 1"), old, "event_id")
    links, artists = L.artist_links(stored, known)
    return links.join(artists, "artist_id").select("event_id", "name", "artist_id")
