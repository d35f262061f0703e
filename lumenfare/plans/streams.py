"""Registered queries of stream metrics, run over the whole events table as files that arrive in order of time."""

from pyspark.sql import functions as F

from lumenfare.plans.query import query
from lumenfare.sources.shared import shared_folder
from lumenfare.sources.tables import interactions, read, sql
from lumenfare.streaming import buffers as B
from lumenfare.streaming import metrics as M
from lumenfare.streaming import sketches as K

#: Files that the events are laid out in, and files of a batch.
FILES, BATCH = 8, 2


def arrived(spark, d, folder: str, closed: bool = False):
    """The events as a stream of files in order of time, and with `closed` a last file of one row a user without an id. Files are told apart by the time they were written at, so they
    are written one after the other; written at once they would arrive in any order, and a watermark would drop rows."""
    events = read(spark, d, "events")
    events.repartitionByRange(FILES, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/ranges")
    for file in sorted(spark.read.schema(events.schema).parquet(f"{folder}/ranges").inputFiles()):
        spark.read.schema(events.schema).parquet(file).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    if closed:
        marks = events.select("user_id").distinct().join(F.broadcast(events.agg(F.max("ts").alias("ts"))))
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema if f.name not in ("user_id", "ts")]
        marks.select("user_id", "ts", *rest).select(events.columns).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    return M.stream(spark, f"{folder}/events", events.schema, BATCH)


def drained(spark, d, made, keys: list[str]):
    """The result of a streaming aggregation once it has read every event, in several batches."""
    folder = shared_folder(spark)
    return M.flushed(made(arrived(spark, d, folder)), keys, folder)


@query("SELECT date_trunc('day', ts)::timestamp AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    r = drained(spark, d, M.daily_counts, ["day", "event_type"])
    return r.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_running_counts(spark, d):
    return drained(spark, d, M.running_counts, ["event_type"])


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY ALL")
def stream_running_users(spark, d):
    r = drained(spark, d, M.running_users, ["event_type", "user_id"])
    return r.groupBy("event_type").agg(F.count("*").alias("users"), F.sum("n").alias("n"))


@query("SELECT (date_trunc('day', ts)::timestamp - to_days(k::int)) AS start, count(*) AS n FROM events, range(0,7) t(k) GROUP BY ALL")
def stream_sliding_week(spark, d):
    return drained(spark, d, M.sliding_counts, ["start"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


_LOG = "r AS (SELECT id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM interactions), w AS (SELECT id, user_id, ts, n, true AS allowed, [ts] AS log FROM r WHERE n=1 UNION ALL SELECT id, user_id, ts, n, len(kept)<3, CASE WHEN len(kept)<3 THEN list_append(kept, ts) ELSE kept END FROM (SELECT r.*, list_filter(w.log, lambda x: r.ts - x < INTERVAL 24 HOUR) AS kept FROM w JOIN r ON r.user_id=w.user_id AND r.n=w.n+1))"


@query(sql(f", {_LOG} SELECT id, user_id, ts, allowed FROM w", "interactions").replace("WITH ", "WITH RECURSIVE ", 1))
def rate_limiter(spark, d):
    return M.limit_rate(interactions(spark, d), 3, 24 * 3600)


@query(sql("SELECT user_id, round(list_reduce(list(value ORDER BY ts, id), lambda s, x: s*0.9::double + x*0.1::double),6) AS ema FROM interactions GROUP BY user_id", "interactions"))
def ema_latency(spark, d):
    return M.ema(interactions(spark, d), "user_id", "value", ["ts", "id"]).withColumn("ema", F.round("ema", 6))


@query("WITH d AS (SELECT DISTINCT date_trunc('day', ts)::timestamp + to_days(k::int) AS day FROM events, range(0,7) t(k)) SELECT day, count(*) AS n, count(DISTINCT user_id) AS users FROM d JOIN events ON ts >= day - to_days(6) AND ts < day + to_days(1) WHERE day <= (SELECT max(ts) FROM events) GROUP BY day")
def trailing_week_users(spark, d):
    """Distinct users of the seven days that end on each day, by union of the bitmaps of each day's users that a stream
    keeps. They count exactly, as the SQL does."""
    r = K.trailing_users(drained(spark, d, K.daily_users, ["day", "part"]), 7)
    return r.select(F.col("day").cast("timestamp_ntz").alias("day"), "n", "users")


_BATCHES = "r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), w AS (SELECT user_id, ts, n, 1 AS batch, ts AS opened, 1 AS held FROM r WHERE n=1 UNION ALL SELECT r.user_id, r.ts, r.n, CASE WHEN later THEN batch+1 ELSE batch END, CASE WHEN later THEN r.ts ELSE opened END, CASE WHEN later THEN 1 ELSE held+1 END FROM (SELECT r.*, w.batch, w.opened, w.held, w.held=5 OR r.ts - w.opened >= INTERVAL 24 HOUR AS later FROM w JOIN r ON r.user_id=w.user_id AND r.n=w.n+1) r)"


@query(f"WITH RECURSIVE {_BATCHES} SELECT user_id, opened, count(*) AS n FROM w GROUP BY user_id, opened, batch")
def buffered_batches(spark, d):
    """Batches of a user's events, let go of when they hold five or are a day old."""
    folder = shared_folder(spark)
    r = M.appended(B.buffered(arrived(spark, d, folder, True), "user_id", 5, 24 * 3600), folder)
    return r.select("user_id", F.col("opened").cast("timestamp_ntz").alias("opened"), "n")
