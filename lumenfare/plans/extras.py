"""Registered queries of distances on the ellipsoid, whole catalogue rows, explanations, networks and dashboards."""

from functools import reduce

from pyspark.sql import functions as F

from lumenfare.functions import geo
from lumenfare.functions import scores as S
from lumenfare.functions import text as X
from lumenfare.operators import catalog as C
from lumenfare.operators import ingest as I
from lumenfare.operators import recommend as R
from lumenfare.plans.hybrid import _E, LAT, LIKED, LON, events
from lumenfare.plans.notices import _N, _forms, _k, _numbers
from lumenfare.plans.query import query
from lumenfare.sources import listings as S_
from lumenfare.sources.tables import as_of, catalog, interactions, read, sql, venues

_F = 1 / 298.257223563


def _lambert() -> str:
    b1, b2 = f"atan((1-{_F}::double)*tan(radians({LAT}::double)))", f"atan((1-{_F}::double)*tan(radians(lat)))"
    return f"(SELECT CASE WHEN s=0 THEN 0.0 ELSE 6378.137::double*(s-{_F}::double/2*((s-sin(s))*pow(sin(p)*cos(q)/cos(s/2),2)+(s+sin(s))*pow(cos(p)*sin(q)/sin(s/2),2))) END FROM (SELECT 2*asin(sqrt(least(1.0,pow(sin((b2-b1)/2),2)+cos(b1)*cos(b2)*pow(sin(radians(lon-{LON}::double)/2),2)))) AS s, (b1+b2)/2 AS p, (b2-b1)/2 AS q FROM (SELECT {b1} AS b1, {b2} AS b2)))"


@query(sql(f"SELECT venue_id, round({_lambert()},6) AS km FROM venues", "venues"))
def venues_geodesic(spark, d):
    return venues(spark, d).select("venue_id", F.round(geo.geodesic_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon")), 6).alias("km"))


@query(sql("SELECT CASE WHEN p<100 THEN '<100' WHEN p<200 THEN '<200' WHEN p<300 THEN '<300' ELSE '>=300' END AS band, count(*) AS n FROM (SELECT price_min/8-50 AS p FROM catalog) GROUP BY 1", "catalog"))
def price_bands(spark, d):
    return catalog(spark, d).groupBy(C.banded(F.col("price_min") / 8 - 50, [100, 200, 300]).alias("band")).agg(F.count("*").alias("n"))


@query(sql(f", {_E} SELECT event_id, title, COALESCE(topic,'music') AS topic, venue_name, neighborhood, COALESCE(price_min,0) AS price_min, array_to_string(list_sort(artists),', ') AS artists, array_to_string(list_sort(list_distinct(list_concat(genres, list_transform(artists, lambda a: 'by ' || a)))),',') AS genres FROM ev WHERE status='active' AND date_time>timestamp '2024-01-15' ORDER BY date_time, event_id LIMIT 100", "catalog", "venues"))
def catalog_rows(spark, d):
    """Whole rows of the next hundred events: venue, artists in order, and the union of the event's and artists' genres."""
    e = C.page(C.upcoming(events(spark, d), as_of()), ["date_time", "event_id"], 100)
    union = F.array_sort(F.array_union("genres", F.transform("artists", lambda a: F.concat(F.lit("by "), a))))
    return e.select("event_id", "title", F.coalesce("topic", F.lit("music")).alias("topic"), "venue_name", "neighborhood", F.coalesce("price_min", F.lit(0.0)).alias("price_min"), F.array_join(F.array_sort("artists"), ", ").alias("artists"), F.array_join(union, ",").alias("genres"))


_KM = f"2*6371.0::double*asin(sqrt(least(1.0,pow(sin(radians(lat-{LAT}::double)/2),2)+cos(radians({LAT}::double))*cos(radians(lat))*pow(sin(radians(lon-{LON}::double)/2),2))))"


@query(sql(f", {_E} SELECT event_id, array_to_string(list_sort(list_filter(list_distinct(genres), lambda g: list_contains({LIKED},g))),'+') AS genres, array_to_string(list_sort(list_filter(artists, lambda a: list_contains(['Artist 1','Artist 7'],a))),'+') AS artists, round({_KM},1) AS km, COALESCE(price_min<=1000,true) AS affordable, round(popularity,3) AS popularity FROM ev", "catalog", "venues"))
def explanation_rows(spark, d):
    """Why an event is shown: matched genres and artists, distance to one place, whether its price is in reach."""
    e = events(spark, d)
    both = lambda own, liked: F.array_join(F.array_sort(F.array_intersect(own, F.array(*map(F.lit, liked)))), "+")
    km = geo.haversine_km(F.lit(LAT), F.lit(LON), F.col("lat"), F.col("lon"))
    return e.select("event_id", both("genres", LIKED).alias("genres"), both("artists", ["Artist 1", "Artist 7"]).alias("artists"), F.round(km, 1).alias("km"), F.coalesce(F.col("price_min") <= 1000, F.lit(True)).alias("affordable"), F.round("popularity", 3).alias("popularity"))


_IN = ["popularity", "hour(date_time)/23.0::double", "(isodow(date_time)-1)/6.0::double", "COALESCE(price_min,0)/2000.0::double", "COALESCE(price_max,0)/2000.0::double", "len(genres)/5.0::double", "CASE WHEN is_free THEN 1.0 ELSE 0.0 END::double", "CASE WHEN topic IS NULL THEN 0.5 ELSE 1.0 END::double"]
_WEIGHT = lambda i, j: ((i * 7 + j * 3) % 11 - 5) / 10
_LAYERS = [([[_WEIGHT(i, j) for j in range(8)] for i in range(4)], [0.1, 0.0, -0.1, 0.2]), ([[_WEIGHT(i + 3, j) for j in range(4)] for i in range(2)], [0.05, 0.1]), ([[0.8, -0.6]], [0.1])]


def _network() -> str:
    steps, cols = [], [f"x{j}" for j in range(8)]
    out = f"SELECT event_id, {', '.join(f'{e} AS x{j}' for j, e in enumerate(_IN))} FROM catalog"
    for k, (rows, bias) in enumerate(_LAYERS):
        sums = ["+".join(f"({w}::double)*{c}" for w, c in zip(row, cols)) + f"+({b}::double)" for row, b in zip(rows, bias)]
        cols = [f"h{k}_{i}" for i in range(len(rows))]
        out = f"SELECT event_id, {', '.join((f'greatest(0.0,{s})' if k < len(_LAYERS) - 1 else s) + f' AS {c}' for s, c in zip(sums, cols))} FROM ({out})"
    return f"SELECT event_id, round(1/(1+exp(-{cols[0]})),6) AS score FROM ({out})"


@query(sql(_network(), "catalog"))
def network_scores(spark, d):
    """A network of eight inputs, four and two hidden units, with weights by rule."""
    x = F.array(F.col("popularity"), F.hour("date_time") / 23.0, F.weekday("date_time") / 6.0, F.coalesce("price_min", F.lit(0.0)) / 2000.0, F.coalesce("price_max", F.lit(0.0)) / 2000.0, F.size("genres") / 5.0, F.col("is_free").cast("double"), F.when(F.col("topic").isNull(), 0.5).otherwise(1.0))
    return catalog(spark, d).select("event_id", F.round(S.mlp(x, _LAYERS), 6).alias("score"))


@query(sql("SELECT user_id, event_id, round(sum(CASE kind WHEN 'like' THEN 1.0 WHEN 'going' THEN 2.0 WHEN 'went' THEN 1.5*COALESCE(rating/5,1) WHEN 'save' THEN 0.8 ELSE -0.5 END)::double,6) AS w, sum(CASE kind WHEN 'like' THEN 1.0 WHEN 'going' THEN 2.0 WHEN 'went' THEN 1.5*COALESCE(rating/5,1) WHEN 'save' THEN 0.8 ELSE -0.5 END)>0 AS is_positive FROM interactions GROUP BY ALL", "interactions"))
def training_weights(spark, d):
    return R.training_weights(interactions(spark, d)).withColumn("w", F.round("w", 6))


@query(sql("SELECT event_id FROM catalog ORDER BY (event_id*7933+733103)%1000003, event_id LIMIT 20", "catalog"))
def sampled_events(spark, d):
    return R.sampled(catalog(spark, d), "event_id", 20).select("event_id")


@query(sql("SELECT (SELECT count(*) FROM interactions) AS total, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM interactions GROUP BY kind)) AS kinds, (SELECT string_agg(topic || '=' || n, ',' ORDER BY topic) FROM (SELECT COALESCE(topic,'music') AS topic, count(*) AS n FROM catalog GROUP BY 1)) AS topics, (SELECT string_agg(venue_id || '=' || n, ',' ORDER BY n DESC, venue_id) FROM (SELECT venue_id, count(*) AS n FROM catalog GROUP BY venue_id ORDER BY n DESC, venue_id LIMIT 5)) AS venues", "catalog", "interactions"))
def dashboard_record(spark, d):
    """Totals, kinds, topics and the five busiest venues as one row; each part is aggregated before it is joined."""
    i, e = interactions(spark, d), catalog(spark, d)
    said = lambda df, key, name: df.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, "n"))), ",").alias(name))
    kinds = said(i.groupBy("kind").agg(F.count("*").alias("n")), "kind", "kinds")
    topics = said(e.groupBy(F.coalesce("topic", F.lit("music")).alias("topic")).agg(F.count("*").alias("n")), "topic", "topics")
    top = e.groupBy("venue_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue_id").limit(5)
    best = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("n"), "venue_id"))), lambda s: F.concat_ws("=", s["venue_id"], (-s["col1"]).cast("string"))), ",").alias("venues"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), [i.agg(F.count("*").alias("total")), kinds, topics, best])


@query(sql("SELECT action, count(*) AS n FROM (SELECT CASE WHEN o.title IS NULL THEN 'inserted' WHEN n.title IS NULL THEN 'kept' ELSE 'updated' END AS action FROM (SELECT title, venue_id, date_time FROM catalog WHERE event_id%3<2) o FULL JOIN (SELECT title, venue_id, date_time FROM catalog WHERE event_id%3>0) n ON o.title=n.title AND o.venue_id=n.venue_id AND o.date_time=n.date_time) GROUP BY action", "catalog"))
def upsert_counts(spark, d):
    """How many events are inserted, updated and kept by title, venue and time."""
    keys, k = ["title", "venue_id", "date_time"], F.col("event_id")
    c = catalog(spark, d)
    return I.upsert(c.where(k % 3 < 2), c.where(k % 3 > 0), keys, ["price_min"]).groupBy("action").agg(F.count("*").alias("n"))


@query(sql("SELECT id, user_id, event_id, kind, ts FROM interactions WHERE event_id IN (SELECT event_id FROM catalog WHERE topic='tech')", "interactions", "catalog"))
def event_interactions(spark, d):
    """All interactions with the events of a topic, newest first within each event."""
    e = catalog(spark, d).where("topic = 'tech'").select("event_id")
    return interactions(spark, d).join(e, "event_id", "left_semi").select("id", "user_id", "event_id", "kind", "ts").sortWithinPartitions("event_id", F.desc("ts"), "id")


@query(f"WITH {_N} SELECT k, 'café & fine tea ' || k AS cleaned, 'god koncert aften' AS words FROM n")
def clean_announcements(spark, d):
    """Character references and compatibility letters, then addresses, mentions and runs of marks; stop words of two languages."""
    t = F.concat(F.lit("Caf&eacute; &amp; ﬁne #Tea "), _k(), F.lit(" @me http://x.example/a !!!"))
    words = F.lit("En god og koncert the aften at on")
    return _numbers(spark, d).select("k", X.clean(X.unescaped(t)).alias("cleaned"), X.without_stopwords(F.lower(words), X.DANISH_STOP + X.ENGLISH_STOP).alias("words"))


@query(f"WITH {_N} SELECT k AS page_id, CASE WHEN k%3=0 THEN 1 ELSE 0 END AS pos, 'Live koncert at the museum, doors open from 20:00 ' || k AS block FROM n WHERE k%3<2")
def event_blocks(spark, d):
    """Lines of fifty characters or more with words of an event and of a place or time."""
    line = F.concat(F.lit("  Live koncert at the museum, doors open from 20:00 "), _k())
    t = _forms(F.concat(F.lit("News of the week, all of it quite long enough but no more\n"), line), F.concat(line, F.lit("\nParty at 9")), F.lit("Party at nine in the park"))
    return S_.event_blocks(_numbers(spark, d).select(_k().alias("page_id"), t.alias("text")))


_RULE = "CASE k%3 WHEN 0 THEN 'tech' WHEN 1 THEN 'music' ELSE 'sports' END"
_LIST = "['tech','nightlife','music','sports']"


@query(f"WITH {_N}, v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), p AS (SELECT t, list(m ORDER BY i) AS p FROM (SELECT label%4 AS t, i, avg(x) AS m FROM (SELECT label, unnest(range(len(e))) AS i, unnest(e) AS x FROM v) GROUP BY ALL) GROUP BY t), s AS (SELECT vec_id, arg_max(t, (list_cosine_similarity(e,p), -t)) AS t, max((list_cosine_similarity(e,p)+1)/2) AS c FROM v, p GROUP BY vec_id), r AS (SELECT k, {_RULE} AS rule, CASE k%3 WHEN 0 THEN 0.6 WHEN 1 THEN 0.3 ELSE 0.2 END::double AS conf, k%(SELECT count(*) FROM v) AS vec_id FROM n) SELECT k, CASE WHEN conf<0.6 AND c>conf THEN {_LIST}[t+1] ELSE rule END AS topic, round(CASE WHEN conf<0.6 AND c>conf THEN c ELSE conf END,5) AS confidence FROM r JOIN s USING (vec_id)")
def topic_cascade(spark, d):
    """Rules first; below a confidence of .6 the nearest of four prototypes, if it is surer."""
    v = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    m = v.select((F.col("label") % 4).alias("t"), F.posexplode("embedding").alias("i", "x")).groupBy("t", "i").agg(F.avg("x").alias("x"))
    p = m.groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("p"))
    s = v.join(F.broadcast(p)).groupBy("vec_id").agg(F.max(F.struct(S.cosine(F.col("embedding"), F.col("p")).alias("c"), (-F.col("t")).alias("t"))).alias("b"))
    t = _forms(F.lit("Python hackathon, a startup workshop on robotics and cloud"), F.lit("Jazz, blues and folk"), F.lit("Football match"))
    r = _numbers(spark, d).select("k", X.classified(t, X.TOPIC_KEYWORDS, X.NEGATIVES).alias("r")).join(F.broadcast(v.agg(F.count("*").alias("n")))).withColumn("vec_id", F.col("k") % F.col("n")).join(s, "vec_id")
    surer = (F.col("r.confidence") < 0.6) & ((F.col("b.c") + 1) / 2 > F.col("r.confidence"))
    topics = F.array(*map(F.lit, X.TOPIC_KEYWORDS))
    return r.select("k", F.when(surer, F.element_at(topics, (1 - F.col("b.t")).cast("int"))).otherwise(F.col("r.topic")).alias("topic"), F.round(F.when(surer, (F.col("b.c") + 1) / 2).otherwise(F.col("r.confidence")), 5).alias("confidence"))
