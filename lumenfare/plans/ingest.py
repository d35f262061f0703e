"""Registered queries of ingestion: duplicates, get-or-create, upserts, retention, quality."""

from pyspark.sql import functions as F

from lumenfare.operators import ingest as I
from lumenfare.operators.catalog import validated
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, interactions, read, sql, venues


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id)=1")
def ingest_dedup(spark, d):
    """The first document of each text, in the order of ids."""
    return I.keep_first(read(spark, d, "documents"), [F.xxhash64("text"), F.length("text")], ["doc_id"]).select("doc_id", "source")


@query(sql("SELECT name, COALESCE(id, sha256(name)) AS id, id IS NULL AS created FROM (SELECT DISTINCT 'Supplier#' || lpad((event_id%150)::varchar,9,'0') AS name FROM catalog) LEFT JOIN (SELECT name, 'v' || venue_id AS id FROM venues) USING (name)", "catalog", "venues"))
def venue_get_or_create(spark, d):
    names = catalog(spark, d).select(F.concat(F.lit("Supplier#"), F.lpad((F.col("event_id") % 150).cast("string"), 9, "0")).alias("name"))
    known = venues(spark, d).select("name", F.concat(F.lit("v"), "venue_id").alias("id"))
    return I.get_or_create(names, known)


@query(sql("SELECT user_id, event_id, kind, id, rating, ts FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id, event_id, kind ORDER BY ts DESC, id DESC)=1", "interactions"))
def upsert_interactions(spark, d):
    return I.latest(interactions(spark, d), ["user_id", "event_id", "kind"], "ts", "id").select("user_id", "event_id", "kind", "id", "rating", "ts")


@query(sql("SELECT event_id, title, date_time FROM catalog n WHERE event_id%2=1 AND NOT EXISTS (SELECT 1 FROM catalog o WHERE o.event_id%2=0 AND (o.source||o.title=n.source||n.title OR (o.title=n.title AND o.date_time=n.date_time))) QUALIFY row_number() OVER (PARTITION BY title, date_time ORDER BY event_id)=1", "catalog"))
def insert_if_absent(spark, d):
    """Odd events are new, even ones exist; a row is absent if neither its url nor its title and time exist."""
    c = catalog(spark, d).withColumn("url", F.concat("source", "title"))
    return I.insert_absent(c.where("event_id % 2 = 1"), c.where("event_id % 2 = 0"), [["url"], ["title", "date_time"]], ["event_id"]).select("event_id", "title", "date_time")


@query(sql("SELECT COALESCE(o.title,n.title) AS title, COALESCE(o.venue_id,n.venue_id) AS venue_id, COALESCE(n.price,o.price) AS price, CASE WHEN o.title IS NULL THEN 'inserted' WHEN n.title IS NULL THEN 'kept' ELSE 'updated' END AS action FROM (SELECT title, venue_id, max(event_id) AS price FROM catalog WHERE event_id%2=0 GROUP BY ALL) o FULL JOIN (SELECT title, venue_id%50*2 AS venue_id, max(event_id) AS price FROM catalog WHERE event_id%2=1 GROUP BY ALL) n ON o.title=n.title AND o.venue_id=n.venue_id", "catalog"))
def upsert_events(spark, d):
    c = catalog(spark, d)
    old = c.where("event_id % 2 = 0").groupBy("title", "venue_id").agg(F.max("event_id").alias("price"))
    new = c.where("event_id % 2 = 1").groupBy("title", (F.col("venue_id") % 50 * 2).alias("venue_id")).agg(F.max("event_id").alias("price"))
    return I.upsert(old, new, ["title", "venue_id"], ["price"])


@query(sql("SELECT event_id FROM catalog WHERE NOT (status='active' AND date_time < timestamp '2024-01-15' - to_days(7))", "catalog"))
def retention_delete(spark, d):
    return I.retained(catalog(spark, d), as_of()).select("event_id")


@query(sql("SELECT a.event_id AS a, b.event_id AS b, round(1-levenshtein(a.title,b.title)/greatest(length(a.title),length(b.title))::double,6) AS ratio, 1-levenshtein(a.title,b.title)/greatest(length(a.title),length(b.title))::double>0.9 AS exact FROM catalog a JOIN catalog b ON a.event_id<b.event_id AND a.venue_id=b.venue_id AND a.date_time::date=b.date_time::date WHERE 1-levenshtein(a.title,b.title)/greatest(length(a.title),length(b.title))::double >= 0.7", "catalog"))
def fuzzy_duplicates(spark, d):
    c = catalog(spark, d).select(F.col("event_id").alias("id"), "title", "venue_id", F.to_date("date_time").alias("day"))
    return I.fuzzy_pairs(c, ["venue_id", "day"], "title")


@query(sql("SELECT source, count(*) AS n, count(CASE WHEN price_min IS NOT NULL AND topic IS NOT NULL AND status='active' THEN 1 END) AS valid, round(count(CASE WHEN price_min IS NOT NULL AND topic IS NOT NULL AND status='active' THEN 1 END)/count(*)::double,6) AS validation_rate FROM catalog GROUP BY source", "catalog"))
def quality_metrics(spark, d):
    v = validated(catalog(spark, d), {"price": F.col("price_min").isNotNull(), "topic": F.col("topic").isNotNull(), "status": F.col("status") == "active"})
    return v.groupBy("source").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("valid")).withColumn("validation_rate", F.round(F.col("valid") / F.col("n"), 6))


@query(sql("SELECT (SELECT max(id) FROM interactions) + row_number() OVER (ORDER BY event_id) AS id, event_id FROM catalog WHERE event_id < 25", "interactions", "catalog"))
def next_ids(spark, d):
    """Ids that follow the largest one, for the rows of a small batch."""
    from pyspark.sql import Window as W

    top = interactions(spark, d).agg(F.max("id").alias("top"))
    new = catalog(spark, d).where("event_id < 25").select("event_id", F.row_number().over(W.orderBy("event_id")).alias("n"))
    return new.join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "event_id")


@query(sql("SELECT (SELECT max(id) FROM interactions) + row_number() OVER (ORDER BY event_id) AS id, event_id FROM catalog", "interactions", "catalog"))
def next_ids_all(spark, d):
    """Ids that follow the largest one, for the whole catalogue: rows are numbered within ranges of 4,096 event ids, after
    the rows of the ranges before."""
    from pyspark.sql import Window as W

    top = interactions(spark, d).agg(F.max("id").alias("top"))
    new = catalog(spark, d).select("event_id", F.floor(F.col("event_id") / 4096).alias("range"))
    before = new.groupBy("range").agg(F.count("*").alias("n")).select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("before"))
    n = F.row_number().over(W.partitionBy("range").orderBy("event_id"))
    return new.withColumn("n", n).join(before, "range").join(F.broadcast(top)).select((F.col("top") + F.col("before") + F.col("n")).alias("id"), "event_id")
