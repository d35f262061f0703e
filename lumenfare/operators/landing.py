"""The way of records into the catalogue: classified, tagged, without duplicates, with their venues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.functions import text as X
from lumenfare.operators.ingest import keep_first


def normalised(raw: DataFrame) -> DataFrame:
    """Records under the names that sources use for one thing: title or name, id or source_id, url or source_url, a
    venue's name alone or within a struct, prices alone or within a struct."""
    has = set(raw.columns)
    inner = {f.name: set(f.dataType.names) for f in raw.schema.fields if hasattr(f.dataType, "names")}

    def first(*names: str) -> Column:
        found = [F.col(n) for n in names if n in has or "." in n and n.split(".")[1] in inner.get(n.split(".")[0], ())]
        return F.coalesce(*found) if found else F.lit(None)

    text = {"title": ("title", "name"), "source_id": ("source_id", "id"), "source_url": ("source_url", "url"), "venue_name": ("venue_name", "venue.name"), "venue_address": ("venue_address", "venue.address"), "description": ("description",), "source": ("source",)}
    number = {"price_min": ("price_min", "price.min"), "price_max": ("price_max", "price.max")}
    return raw.select(*[first(*v).cast("string").alias(k) for k, v in text.items()], *[first(*v).cast("double").alias(k) for k, v in number.items()], first("date_time", "start_time").cast("timestamp_ntz").alias("date_time"))


def described(records: DataFrame) -> DataFrame:
    """records with topic, tags and is_free."""
    text = F.concat_ws(" ", "title", "description")
    return records.withColumn("topic", X.classified(text, X.TOPIC_KEYWORDS, X.NEGATIVES)["topic"]).withColumn("tags", X.tags(text, F.col("price_min"))).withColumn("is_free", F.col("price_min").isNull() | (F.col("price_min") == 0))


def without_duplicates(records: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """records with is_duplicate: of a source and source_id that exist or came before in `order`; without a source_id of
    a source, title and time likewise. Records under one key stand in one window, which must be few."""
    keyed = records.withColumn("_key", record_key())
    known = existing.select(record_key().alias("_key"), F.lit(True).alias("_known")).distinct()
    again = F.row_number().over(W.partitionBy("_key").orderBy(order)) > 1
    return keyed.withColumn("_again", again).join(known, "_key", "left").withColumn("is_duplicate", F.col("_again") | F.col("_known").isNotNull()).drop("_key", "_again", "_known")


def record_key() -> Column:
    """Source and id, or source, title and time, as one value."""
    own = F.struct(F.col("source"), F.col("source_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("timestamp_ntz").alias("at"))
    named = F.struct(F.col("source"), F.lit(None).cast("string").alias("source_id"), F.col("title"), F.col("date_time").alias("at"))
    return F.to_json(F.when(F.coalesce("source_id", F.lit("")) != "", own).otherwise(named))


def venue_ids(records: DataFrame, venues: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with venue_id, the venues that had to be made): a venue is known by its keys, of which `name` is one; an
    id is made of the keys. Records without a venue's name have no venue."""
    side = {k: f"venue_{k}" for k in keys}
    named = records.where(F.col("venue_name").isNotNull()).select(*[F.col(v).alias(k) for k, v in side.items()]).distinct()
    known = venues.groupBy(*keys).agg(F.min("id").alias("id"))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    made = F.sha2(F.concat_ws("\x1f", *[F.coalesce(f"n.{k}", F.lit("")) for k in keys]), 256)
    all_ = named.alias("n").join(known.alias("k"), same, "left").select(*[F.col(f"n.{k}").alias(k) for k in keys], F.coalesce("k.id", made).alias("venue_id"), F.col("k.id").isNull().alias("created"))
    a, b = records.alias("a"), all_.alias("b")
    out = a.join(b, [F.col(f"a.{v}").eqNullSafe(F.col(f"b.{k}")) for k, v in side.items()], "left").select("a.*", "b.venue_id")
    return out, all_.where("created").drop("created")


def ingested(raw: DataFrame, events: DataFrame, venues: DataFrame, order: str = "source_id") -> DataFrame:
    """All records, described, with is_duplicate and (those that are none) venue_id."""
    r = without_duplicates(described(normalised(raw)), events, order)
    fresh, _ = venue_ids(r.where("not is_duplicate"), venues, ["name"])
    return fresh.unionByName(r.where("is_duplicate").withColumn("venue_id", F.lit(None).cast("string")))


def counters(ingested_: DataFrame) -> DataFrame:
    """(source, topic, total, duplicates, inserted) of what ingested() gives."""
    return ingested_.groupBy("source", "topic").agg(F.count("*").alias("total"), F.count_if("is_duplicate").alias("duplicates"), F.count_if(~F.col("is_duplicate")).alias("inserted"))


def one_a_day(new: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """New events (venue_id, date_time) of days on which their venue has no event that is not cancelled, one a day."""
    day = F.to_date("date_time").alias("day")
    taken = existing.where("status <> 'cancelled'").select("venue_id", day).distinct()
    return keep_first(new.withColumn("day", F.to_date("date_time")).join(taken, ["venue_id", "day"], "left_anti"), ["venue_id", "day"], [order])


def artist_links(stored: DataFrame, artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, artists) of stored events (event_id, artists) and known artists (artist_id, name): a link (event_id,
    artist_id) for each different name of an event, and the known artists with the new ones, which take their name's
    hash as id. Names are compared as they are; null and empty ones link nothing."""
    named = stored.select("event_id", F.explode("artists").alias("name")).where("name <> ''").distinct()
    new = named.select("name").distinct().join(artists, "name", "left_anti").select(F.sha2("name", 256).alias("artist_id"), "name")
    every = artists.select(F.col("artist_id").cast("string").alias("artist_id"), "name").unionByName(new)
    return named.join(every, "name").select("event_id", "artist_id"), every


def logged(tracked: DataFrame, kind: str = "recommendation_request") -> DataFrame:
    """The rows that a log of requests keeps of all tracked events, with their data as JSON text; for foreachBatch or a batch append."""
    return tracked.where(F.col("event_type") == kind)


def set_counts(examples: DataFrame, by: str) -> DataFrame:
    """(by, n, positives, negatives, users): what stands beside a written training set."""
    return examples.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("positives"), F.sum((1 - F.col("label")).cast("long")).alias("negatives"), F.count_distinct("user_id").alias("users"))
