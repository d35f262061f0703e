"""The event catalogue's tables, as views of the star-schema tables: venues, catalogue events, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that stands for now in every registered query.
AS_OF = "2024-01-15 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp_ntz")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    place = lambda base, k, width: F.lit(base) + ((F.col("s_suppkey") * k) % 1000) / F.lit(1000.0) * F.lit(width)
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("venue_id"), F.col("s_name").alias("name"), F.col("n_name").alias("neighborhood"), F.col("r_name").alias("city"), place(55.615, 37, 0.12).alias("lat"), place(12.45, 53, 0.20).alias("lon"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per catalogue event; some prices, topics and statuses are null, zero or cancelled by rule."""
    p = read(spark, sf_dir, "part")
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n_venues"))
    k = F.col("p_partkey")
    low = F.when(k % 10 == 0, F.lit(None)).when(k % 10 == 5, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    topic = F.element_at(F.array(*map(F.lit, ("tech", "nightlife", "music", "sports"))), (k % 5 + 1).cast("int"))
    at = F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size") - 10, (k % 24).cast("int"))
    return p.join(F.broadcast(n)).select(k.alias("event_id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("genres"), F.when(k % 5 < 4, topic).alias("topic"), low.alias("price_min"), (low + F.col("p_size")).alias("price_max"), (k % 10 == 5).alias("is_free"), (k % F.col("n_venues")).alias("venue_id"), at.alias("date_time"), ((k % 101) / F.lit(100.0)).alias("popularity"), F.when(k % 17 == 0, "cancelled").otherwise("active").alias("status"), F.col("p_brand").alias("source"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("click", "like", "purchase", "going", "signup", "went", "view", "save", "error", "dislike")])[F.col("event_type")]
    rating = F.when(F.col("event_type") == "signup", 1 + F.floor("value").cast("int") % 5)
    return e.select(F.col("event_id").alias("id"), "user_id", F.get_json_object("props", "$.k").cast("long").alias("event_id"), kind.alias("kind"), rating.cast("double").alias("rating"), "ts", "value")


# The same views as SQL for the statements that state the registered queries' results.
SQL = {
    "venues": "venues AS (SELECT s_suppkey AS venue_id, s_name AS name, n_name AS neighborhood, r_name AS city, 55.615::double + ((s_suppkey*37)%1000)/1000.0::double*0.12::double AS lat, 12.45::double + ((s_suppkey*53)%1000)/1000.0::double*0.20::double AS lon FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)",
    "catalog": "catalog AS (SELECT p_partkey AS event_id, p_name AS title, string_split(p_name,' ') AS genres, CASE p_partkey%5 WHEN 0 THEN 'tech' WHEN 1 THEN 'nightlife' WHEN 2 THEN 'music' WHEN 3 THEN 'sports' END AS topic, CASE WHEN p_partkey%10=0 THEN NULL WHEN p_partkey%10=5 THEN 0.0::double ELSE p_retailprice END AS price_min, CASE WHEN p_partkey%10=0 THEN NULL WHEN p_partkey%10=5 THEN 0.0::double ELSE p_retailprice END + p_size AS price_max, p_partkey%10=5 AS is_free, p_partkey % (SELECT count(*) FROM supplier) AS venue_id, timestamp '2024-01-15 00:00:00' + to_days(p_size-10) + to_hours(p_partkey%24) AS date_time, (p_partkey%101)/100.0::double AS popularity, CASE WHEN p_partkey%17=0 THEN 'cancelled' ELSE 'active' END AS status, p_brand AS source FROM part)",
    "interactions": "interactions AS (SELECT event_id AS id, user_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS event_id, CASE event_type WHEN 'click' THEN 'like' WHEN 'purchase' THEN 'going' WHEN 'signup' THEN 'went' WHEN 'view' THEN 'save' ELSE 'dislike' END AS kind, CASE WHEN event_type='signup' THEN (1 + CAST(floor(value) AS INT)%5)::double END AS rating, ts, value FROM events)",
}


def sql(body: str, *names: str) -> str:
    """body with the named views in front of it."""
    views = "WITH " + ", ".join(SQL[n] for n in names)
    return f"{views}, {body[5:]}" if body.startswith("WITH ") else f"{views} {body}"
