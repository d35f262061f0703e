"""Content and hybrid scores of candidates: whole feature rows, their weights, diversity, places and prices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfare.functions import dates, geo
from lumenfare.functions import scores as S

# Weights of a popularity by interactions, of a content similarity and of a hybrid score.
POPULARITY = {"like": 1.0, "going": 2.0, "went": 1.5, "save": 0.5}
CONTENT = {"text": 0.6, "genre": 0.2, "venue": 0.1, "price": 0.05, "time": 0.05}
HYBRID = {"content": 0.35, "collaborative": 0.25, "distance": 0.15, "price": 0.05, "recency": 0.05, "popularity": 0.05, "diversity": 0.05, "time_match": 0.05}
# The city's centre, its usual price, genres that are flagged, and venues that are well known.
CENTRE, USUAL_PRICE = (55.6761, 12.5683), 350.0
FLAGGED = ["techno", "house", "electronic", "indie", "rock", "jazz", "pop"]
FAMOUS = ["vega", "rust", "culture box", "loppen", "kb18", "pumpehuset"]


def _named(events: DataFrame, parts: dict[str, Column], interactions: DataFrame) -> DataFrame:
    """(event_id, part, name, w): a row for each name that an event has, of all parts (arrays) together, with 1 and the
    event's weighted interactions as w."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in POPULARITY.items() for x in kv])[F.col("kind")], F.lit(0.0))
    per = interactions.groupBy("event_id").agg(F.sum(w).alias("w"))
    told = lambda part: lambda x: F.struct(F.lit(part).alias("part"), x.alias("name"))
    names = F.concat(*[F.transform(F.array_compact(a), told(p)) for p, a in parts.items()])
    e = events.select("event_id", names.alias("names")).join(per, "event_id", "left")
    return e.select("event_id", (1 + F.coalesce("w", F.lit(0.0))).alias("w"), F.inline("names"))


def shares(events: DataFrame, parts: dict[str, Column], interactions: DataFrame) -> DataFrame:
    """(part, name, share): what part of all events and weighted interactions each name of each array has. A part's sum
    over its names is one row a part, so it is broadcast."""
    n = _named(events, parts, interactions).groupBy("part", "name").agg(F.sum("w").alias("w"))
    return n.join(F.broadcast(n.groupBy("part").agg(F.sum("w").alias("all"))), "part").select("part", "name", (F.col("w") / F.col("all")).alias("share"))


def popularity(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """events with `popular`: a quarter of the sum of its genres' mean share, its artists' mean share, its venue's share
    and its own popularity. events: event_id, genres, artists, venue_name, popularity. The names of all three parts are
    exploded once, summed once, and their means joined once."""
    parts = {"genre": F.col("genres"), "artist": F.col("artists"), "venue": F.array("venue_name")}
    keyed = _named(events, parts, interactions).drop("w")
    each = keyed.join(shares(events, parts, interactions), ["part", "name"])
    mean = each.groupBy("event_id").agg(*[F.avg(F.when(F.col("part") == p, F.col("share"))).alias(f"_{p}") for p in parts])
    found = [F.coalesce(c, F.lit(0.0)) for c in ("_genre", "_artist", "_venue", "popularity")]
    out = events.join(mean, "event_id", "left")
    return out.withColumn("popular", reduce(lambda a, b: a + b, found) / 4).drop("_genre", "_artist", "_venue")


def wish_vector(events: DataFrame, genres: Column) -> DataFrame:
    """One row `wish`: the mean embedding of the events (genres, embedding) that have one of the genres, in order of
    the dimensions; empty without such events."""
    e = events.where(F.arrays_overlap("genres", genres)).select(F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("i").agg(F.avg("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("wish"))


def content_similarity(wish: dict[str, Column]) -> Column:
    """Of a candidate (embedding, genres, lat, lon, price_min, price_max, date_time) and a wish by the same names, with
    hour and day as shares of 23 and 6: the weighted sum of cosine, Jaccard, rings of cells apart, price and time."""
    x, y = geo.cell(F.col("lat"), F.col("lon"))
    wx, wy = geo.cell(wish["lat"], wish["lon"])
    apart = geo.ring(x, y, wx, wy)
    near = F.when(apart == 0, 1.0).when(apart == 1, 0.8).when(apart == 2, 0.5).otherwise(0.0)
    price = S.price_similarity(F.col("price_min"), F.col("price_max"), wish["price_min"], wish["price_max"])
    hour = S.hour_similarity(F.hour("date_time") / 23.0, wish["hour"])
    day = 1 - F.abs(F.weekday("date_time") / 6.0 - wish["day"])
    parts = {"text": S.cosine(F.col("embedding"), wish["embedding"]), "genre": S.jaccard(F.col("genres"), wish["genres"]), "venue": F.coalesce(near, F.lit(0.0)), "price": price, "time": F.coalesce((hour + day) / 2, F.lit(0.0))}
    return S.clip(reduce(lambda a, b: a + b, [CONTENT[k] * v for k, v in parts.items()]))


def feature_row(candidates: DataFrame, now: Column, lat: float, lon: float, budget: tuple[float, float], hours: list[int], days: list[int]) -> DataFrame:
    """candidates (event_id, content, collaborative, lat, lon, price_min, price_max, date_time, popularity, venue_id) as
    the eight features of a ranker. diversity: 1 / (1 + a tenth of the candidates at the venue)."""
    km = geo.haversine_km(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    there = candidates.groupBy("venue_id").agg(F.count("*").alias("there"))
    c = candidates.join(there, "venue_id", "left")
    return c.select("event_id", F.coalesce("content", F.lit(0.0)).alias("content"), F.coalesce("collaborative", F.lit(0.0)).alias("collaborative"), F.coalesce(km, F.lit(0.0)).alias("distance_km"), S.price_overlap(F.col("price_min"), F.col("price_max"), *budget).alias("price"), S.recency(dates.days_until(F.col("date_time"), now)).alias("recency"), F.coalesce("popularity", F.lit(0.0)).alias("popularity"), (1 / (1 + F.coalesce("there", F.lit(1)) * 0.1)).alias("diversity"), S.time_match(F.col("date_time"), hours, days).alias("time_match"))


def weighted(row: dict[str, Column] | None = None, farther_is_better: bool = False) -> Column:
    """The hybrid score of a feature row. Nearer is better; the other way round as some rankers have it by a slip."""
    c = row or {k: F.col(k) for k in [*HYBRID, "distance_km"] if k != "distance"}
    near = geo.nearness(c["distance_km"])
    value = {**c, "distance": 1 - near if farther_is_better else near}
    return reduce(lambda a, b: a + b, [w * value[k] for k, w in HYBRID.items()])


def diversity_from(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """(event_id, genre_diversity, venue_diversity, artist_diversity, diversity) of candidates against the events already
    chosen (a bounded list): 1 less the share of chosen genres that a candidate has, 1 where its venue is new, likewise
    for artists, and the mean. Without chosen events all are 1."""
    gathered = lambda name: F.array_distinct(F.flatten(F.collect_list(name)))
    known = chosen.agg(gathered("genres").alias("g"), gathered("artists").alias("a"), F.collect_set(F.lower("venue_name")).alias("v"), F.count("*").alias("n"))
    fresh = lambda own, all_: F.when(F.size(all_) > 0, 1 - F.size(F.array_intersect(own, all_)) / F.size(all_)).otherwise(1.0)
    d = candidates.join(F.broadcast(known)).select("event_id", "n", fresh(F.col("genres"), F.col("g")).alias("genre_diversity"), F.when(F.array_contains("v", F.lower("venue_name")), 0.0).otherwise(1.0).alias("venue_diversity"), fresh(F.col("artists"), F.col("a")).alias("artist_diversity"))
    return d.select("event_id", "genre_diversity", "venue_diversity", "artist_diversity", F.when(F.col("n") == 0, 1.0).otherwise((F.col("genre_diversity") + F.col("venue_diversity") + F.col("artist_diversity")) / 3).alias("diversity"))


def geo_features(lat: Column, lon: Column, user_lat: float, user_lon: float) -> list[Column]:
    """Distances from the centre and the user, and whether they are under 3, 5 and 2 km."""
    centre = geo.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), lat, lon)
    user = geo.haversine_km(F.lit(user_lat), F.lit(user_lon), lat, lon)
    return [centre.alias("from_centre"), (centre < 3).alias("is_central"), user.alias("from_user"), (user < 5).alias("is_nearby"), (user < 2).alias("is_walkable")]


def price_features(low: Column, high: Column, budget: tuple[float, float]) -> list[Column]:
    """Prices, their bands at 200 and 500, and how they meet a budget; a missing price is 0, a missing upper one the lower."""
    a = F.coalesce(low, F.lit(0.0))
    b = F.coalesce(F.nullif(high, F.lit(0.0)), a)
    shared = F.greatest(F.lit(0.0), F.least(b, F.lit(budget[1])) - F.greatest(a, F.lit(budget[0])))
    span = F.least(F.lit(budget[1] - budget[0]), F.coalesce(F.nullif(b - a, F.lit(0.0)), F.lit(1.0)))
    return [((a + b) / 2).alias("price_avg"), (b - a).alias("price_range"), (b == 0).alias("is_free"), (a / USUAL_PRICE).alias("low_share"), (b / USUAL_PRICE).alias("high_share"), (b < 200).alias("is_budget"), b.between(200, 500).alias("is_mid_range"), (b > 500).alias("is_premium"), F.try_divide(shared, span).alias("budget_overlap"), (a <= budget[1]).alias("is_affordable"), (b <= budget[1]).alias("is_within_budget"), ((a + b) / 2 / budget[1]).alias("budget_ratio")]


def time_features(at: Column, now: Column) -> list[Column]:
    """Hour, weekday and month round the clock, peak hours, weekends from Friday, and days until."""
    turn = lambda x, n: 2 * F.pi() * x / n
    h, w, m, n = F.hour(at), F.weekday(at), F.month(at), dates.days_until(at, now)
    return [F.sin(turn(h, 24)).alias("hour_sin"), F.cos(turn(h, 24)).alias("hour_cos"), h.between(19, 23).alias("is_peak"), F.sin(turn(w, 7)).alias("day_sin"), F.cos(turn(w, 7)).alias("day_cos"), (w >= 4).alias("is_weekend"), F.sin(turn(m, 12)).alias("month_sin"), F.cos(turn(m, 12)).alias("month_cos"), n.alias("days_until"), F.log(F.greatest(F.lit(1), n)).alias("days_log"), n.between(0, 7).alias("is_this_week"), n.between(0, 30).alias("is_this_month"), ((m - 1) / 11.0).alias("month_share"), (w / 6.0).alias("day_share")]


def content_features(title: Column, description: Column, genres: Column, artists: Column, venue: Column) -> list[Column]:
    size = lambda x: F.coalesce(F.length(x), F.lit(0))
    low = F.transform(genres, lambda g: F.lower(g))
    flags = [F.array_contains(low, g).alias(f"genre_{g}") for g in FLAGGED]
    famous = F.exists(F.array(*map(F.lit, FAMOUS)), lambda v: F.contains(F.lower(F.coalesce(venue, F.lit(""))), v))
    return [size(title).alias("title_length"), size(description).alias("description_length"), (size(description) > 0).alias("has_description"), F.size(genres).alias("n_genres"), F.size(artists).alias("n_artists"), *flags, size(venue).alias("venue_length"), famous.alias("is_famous")]


def z_score(x: Column, mean: Column | float, deviation: Column | float) -> Column:
    """Standard score; 0 without a deviation."""
    mean, deviation = (v if isinstance(v, Column) else F.lit(v) for v in (mean, deviation))
    return F.when(F.coalesce(deviation, F.lit(0.0)) == 0, 0.0).otherwise((x - mean) / deviation)


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with z_<name> for each column: its standard score by the mean and the deviation of all rows (not of a sample).
    Both are one row, aggregated before it is joined. A null stays null, and a column of one value gives 0."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    z = {f"z_{c}": F.when(F.col(c).isNotNull(), z_score(F.col(c), F.col(f"_m_{c}"), F.col(f"_d_{c}"))) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def preference_features(genres: Column, artists: Column, low: Column, high: Column, hours: Column, days: Column) -> list[Column]:
    """How much a user says of their wishes: numbers of genres, artists, hours and weekdays (Monday 0), the budget, and
    whether evenings (from 18) or weekends are among them. Null lists are empty; a missing budget is 0 to 1000."""
    n = lambda a: F.coalesce(F.size(a), F.lit(0)).cast("long")
    a, b = F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(1000.0))
    some = lambda x, f: F.coalesce(F.exists(x, f), F.lit(False))
    return [n(genres).alias("n_genres"), n(artists).alias("n_artists"), (n(genres) > 0).alias("has_genres"), (n(artists) > 0).alias("has_artists"), a.alias("budget_min"), b.alias("budget_max"), (b - a).alias("budget_range"), (b < 300).alias("is_budget_conscious"), n(hours).alias("n_hours"), n(days).alias("n_days"), some(hours, lambda h: h >= 18).alias("prefers_evenings"), some(days, lambda d: d.isin(5, 6)).alias("prefers_weekends")]
