"""Catalogue queries over events, venues and interactions: filters, lookups, search, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upcoming(events: DataFrame, now: Column) -> DataFrame:
    """Active events after now."""
    return events.where((F.col("status") == "active") & (F.col("date_time") > now))


def listing_filter(topic: str | None = None, free: bool | None = None, price_min: float | None = None, price_max: float | None = None, topics: list[str] | None = None, start=None, end=None, tags: list[str] | None = None) -> Column:
    """The conjunction of those conditions that are given; a missing topic counts as music, a missing price as free."""
    conds = [F.lit(True)]
    if topic is not None:
        conds.append(F.coalesce("topic", F.lit("music")) == topic)
    if topics:
        conds.append(F.coalesce("topic", F.lit("music")).isin(topics))
    if tags:
        conds.append(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    if free is True:
        conds.append(F.col("is_free") | F.col("price_min").isNull() | (F.col("price_min") == 0))
    if free is False:
        conds.append(~F.col("is_free") & (F.col("price_min") > 0))
    if price_min is not None:
        conds.append(F.col("price_min") >= price_min)
    if price_max is not None:
        conds.append(F.col("price_max") <= price_max)
    if start is not None:
        conds.append(F.col("date_time") >= start)
    if end is not None:
        conds.append(F.col("date_time") <= end)
    return reduce(lambda a, b: a & b, conds)


def with_venue(events: DataFrame, venues: DataFrame, how: str = "left") -> DataFrame:
    """events with venue_name, neighborhood and coordinates; the planner broadcasts venues if they are small."""
    return events.join(venues.withColumnRenamed("name", "venue_name"), "venue_id", how)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search(events: DataFrame, words: str, columns: list[str], case: bool = False) -> DataFrame:
    """Rows of which one of the columns contains the words; nulls contain nothing."""
    hits = [F.contains(F.col(c) if case else F.lower(c), F.lit(words if case else words.lower())) for c in columns]
    return events.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))


def details(events: DataFrame, venues: DataFrame, interactions: DataFrame) -> DataFrame:
    """Interaction count and like ratio (like 1, dislike 0, others none) per event, summed before the join."""
    liked = F.when(F.col("kind") == "like", 1.0).when(F.col("kind") == "dislike", 0.0)
    per = interactions.groupBy("event_id").agg(F.count("*").alias("n"), F.avg(liked).alias("like_ratio"))
    return with_venue(events, venues, "inner").join(per, "event_id", "left").withColumn("interaction_count", F.coalesce("n", F.lit(0))).drop("n")


def topic_stats(events: DataFrame, now: Column) -> DataFrame:
    return events.groupBy("topic").agg(F.count("*").alias("event_count"), F.count_if(F.col("date_time") > now).alias("upcoming_count"), F.count_if("is_free").alias("free_count"), F.avg(F.coalesce("price_min", F.lit(0.0))).alias("avg_price"))


def price_band(price: Column) -> Column:
    return F.when(price < 100, "under 100").when(price < 1000, "100-1000").when(price < 2000, "1000-2000").otherwise("2000 and more")


def banded(price: Column, edges: list[float]) -> Column:
    """The first edge that a price is below, as `<edge`, or `>=` the last one; a missing price is in the last band."""
    out = F.lit(f">={edges[-1]:g}")
    for e in reversed(edges):
        out = F.when(price < e, f"<{e:g}").otherwise(out)
    return out


def vote_score(interactions: DataFrame) -> DataFrame:
    return interactions.groupBy("event_id").agg((F.count_if(F.col("kind") == "like") - F.count_if(F.col("kind") == "dislike")).alias("score"))


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with issues, the names of the rules a row breaks, and is_valid; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("issues", broken).withColumn("is_valid", F.size("issues") == 0)


#: Least and greatest latitude and longitude of the city.
CITY = (55.6150, 55.7350, 12.4500, 12.6500)


def within(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in a box (least and greatest latitude, least and greatest longitude), edges included."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def shown(events: DataFrame, query: str = "", genres: list[str] | None = None, neighborhoods: list[str] | None = None, prices: tuple[float, float] | None = None) -> DataFrame:
    """The events that a client shows: those that hold the query in title, description, venue, quarter or a genre, with
    one of the genres, in one of the quarters, and with prices in the range, missing ones as 0."""
    out = events
    if query:
        low = query.lower()
        hits = [F.contains(F.lower(c), F.lit(low)) for c in ("title", "description", "venue_name", "neighborhood") if c in events.columns]
        hits.append(F.exists("genres", lambda g: F.contains(F.lower(g), F.lit(low))))
        out = out.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]))
    if genres:
        out = out.where(F.arrays_overlap("genres", F.array(*map(F.lit, genres))))
    if neighborhoods:
        out = out.where(F.col("neighborhood").isin(neighborhoods))
    if prices:
        out = out.where((F.coalesce("price_min", F.lit(0.0)) >= prices[0]) & (F.coalesce("price_max", F.lit(0.0)) <= prices[1]))
    return out


def request_filter(now: Column, preset: str | None = None, price_min: float | None = None, price_max: float | None = None, neighborhoods: list[str] | None = None, genres: list[str] | None = None) -> Column:
    """The candidates of a request: active ones from now on, for 30 days, or by the preset's own bound, or without one
    for other presets. A price of 0 is no condition, and of several quarters the first counts."""
    later = lambda days, hours=0, minutes=0: now + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes))
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    end = {None: later(30), "today": day + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59)), "this_week": later(7), "this_month": later(30)}.get(preset)
    cond = (F.col("status") == "active") & listing_filter(price_min=price_min or None, price_max=price_max or None, start=now, end=end)
    if neighborhoods:
        cond &= F.col("neighborhood") == neighborhoods[0]
    if genres:
        cond &= F.arrays_overlap("genres", F.array(*map(F.lit, genres)))
    return cond


def request_rules() -> dict[str, Column]:
    """Rules of a request (hour, day, low, high, rating, kind, lat, lon, page, size), for validated()."""
    c = F.col
    both = c("lat").isNull() == c("lon").isNull()
    return {
        "hours": c("hour").between(0, 23),
        "days": c("day").between(0, 6),
        "price_range": (c("low") >= 0) & (c("high") >= c("low")),
        "rating": c("rating").isNull() | c("rating").between(1, 5),
        "rating_missing": (c("kind") != "went") | c("rating").isNotNull(),
        "kind": c("kind").isin("like", "dislike", "going", "went", "save"),
        "location": both & F.coalesce(c("lat").between(-90, 90), F.lit(True)) & F.coalesce(c("lon").between(-180, 180), F.lit(True)),
        "page": (c("page") >= 1) & c("size").between(1, 100),
    }
