"""Collaborative scores of one user's history, and users alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.operators import blocks as B
from lumenfare.operators.recommend import top
from lumenfare.sources.shared import stored

# The shares of the four scores in a blend.
BLEND = {"cooccurrence": 0.4, "feature": 0.3, "context": 0.2, "evolution": 0.1}


def contexts(at: Column, low: Column, high: Column) -> Column:
    """The segments that an interaction at a time with an event of a price belongs to. The price is half the lower
    bound, or half the upper one where the lower is missing or 0."""
    price = F.coalesce(F.nullif(low, F.lit(0.0)), high, F.lit(0.0)) / 2
    day = F.when(F.weekday(at) >= 5, "weekend_explorer").otherwise("weekday_regular")
    hour = F.when(F.hour(at) >= 22, "late_night_party").when(F.hour(at) <= 20, "early_evening_culture")
    cost = F.when(price > 400, "premium_experience").when(price < 200, "price_conscious")
    return F.array_compact(F.array(day, hour, cost))


def positive(kind: Column, rating: Column) -> Column:
    return kind.isin("like", "going", "went") | (F.coalesce(rating, F.lit(0.0)) >= 4)


def segments(history: DataFrame) -> DataFrame:
    """(segment, n, share): how many of a history's rows (ts, price_min, price_max, kind, rating) each segment has, and
    the share of positive ones."""
    s = history.select(F.explode(contexts(F.col("ts"), F.col("price_min"), F.col("price_max"))).alias("segment"), positive(F.col("kind"), F.col("rating")).alias("good"))
    return s.groupBy("segment").agg(F.count("*").alias("n"), (F.count_if("good") / F.count("*")).alias("share"))


def context_score(candidates: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """(event_id, context): the sum of the positive shares of the segments that a candidate would belong to now. It may
    exceed 1; candidates without a score are left out. There are six segments, so their table is broadcast."""
    c = candidates.select("event_id", F.explode(contexts(now, F.col("price_min"), F.col("price_max"))).alias("segment"))
    return c.join(F.broadcast(segments(history)), "segment").groupBy("event_id").agg(F.sum("share").alias("context")).where("context > 0")


def genre_steps(history: DataFrame) -> DataFrame:
    """(source, target, n): how often a genre follows another over the history's events (ts, id, genres) in order."""
    g = history.select("ts", "id", "user_id", F.posexplode("genres").alias("pos", "source"))
    g = g.withColumn("target", F.lead("source").over(W.partitionBy("user_id").orderBy("ts", "id", "pos")))
    return g.where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))


def evolution_score(candidates: DataFrame, steps: DataFrame) -> DataFrame:
    """(event_id, evolution): a tenth of the steps into a candidate's genres, 1 at most."""
    into = steps.groupBy(F.col("target").alias("genre")).agg(F.sum("n").alias("n"))
    g = candidates.select("event_id", F.explode("genres").alias("genre"))
    return g.join(into, "genre").groupBy("event_id").agg(F.least(F.lit(1.0), F.sum("n") * 0.1).alias("evolution"))


def seeds(history: DataFrame) -> DataFrame:
    """The event ids that a user liked or rated 4 or more; all of the history's where there are none."""
    h = history.withColumn("good", (F.col("kind") == "like") | (F.coalesce("rating", F.lit(0.0)) >= 4))
    any_good = h.agg(F.max(F.col("good").cast("int")).alias("any_good"))
    return h.join(F.broadcast(any_good)).where(F.col("good") | (F.col("any_good") == 0)).select("event_id").distinct()


def cooccurrence_score(pairs: DataFrame, seed: DataFrame) -> DataFrame:
    """(event_id, cooccurrence): the weights of pairs (a, b, weight) with the seeds, over the number of seeds."""
    both = pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    n = seed.agg(F.count("*").alias("n"))
    s = both.join(seed.withColumnRenamed("event_id", "a"), "a", "left_semi").groupBy(F.col("b").alias("event_id")).agg(F.sum("weight").alias("w"))
    return s.join(F.broadcast(n)).select("event_id", (F.col("w") / F.col("n")).alias("cooccurrence"))


def feature_pairs(vectors: DataFrame, ids: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, similarity) of the rows named in ids (id) with all others by the dot product of their vectors (id, term,
    weight; of length 1), above `least`. The ids are a stated set: pairs meet by term from their side only."""
    a = vectors.join(ids, "id", "left_semi").select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    b = vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    s = a.join(b, "term").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity"))
    return s.where(F.col("similarity") > least)


def blend(candidates: DataFrame, seed: DataFrame, scores: dict[str, DataFrame]) -> DataFrame:
    """(event_id, score, reasons) of the candidates that are no seeds and have a score; scores: tables (event_id, name)
    by the names of BLEND. reasons: the names of the parts above 0 with two places."""
    out = candidates.select("event_id").join(seed, "event_id", "left_anti")
    for name, part in scores.items():
        out = out.join(part, "event_id", "left")
    value = {n: F.coalesce(n, F.lit(0.0)) for n in scores}
    total = sum((value[n] * BLEND[n] for n in scores), F.lit(0.0))
    reasons = F.array_compact(F.array(*[F.when(value[n] > 0, F.concat(F.lit(f"{n} "), F.format_number(value[n], 2))) for n in scores]))
    return out.select("event_id", total.alias("score"), F.array_join(reasons, "; ").alias("reasons")).where("score > 0")


def similar_users(weights: DataFrame, users: DataFrame, k: int = 5, most_rows: int = 1_000_000) -> DataFrame:
    """(user_id, other_id, score, rank): the k users most alike each of the named users (user_id), by the cosine of
    their weights (user_id, event_id, w). The users are a stated set: every block of them, of about most_rows rows, meets
    each part of all users in a task, and only what may be among a user's k best leaves it."""
    length = weights.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")).where("length > 0")
    unit = weights.join(length, "user_id").where("event_id is not null").select("user_id", "event_id", (F.col("w") / F.col("length")).alias("w"))
    unit = stored(unit)
    a = unit.join(users.select("user_id").distinct(), "user_id", "left_semi").select(F.col("user_id").alias("asked_id"), F.col("event_id").alias("asked_event"), F.col("w").alias("v"))
    n, kind = unit.count(), unit.schema["user_id"].dataType.simpleString()
    blocks, parts = max(1, -(-a.count() // most_rows)), max(1, -(-n // most_rows), min(16, -(-n // 65_536)))
    met = B.dealt(a, unit, "asked_id", "user_id", blocks, parts).applyInPandas(B.alike_in(k), f"user_id {kind}, other_id {kind}, score double")
    return top(met.withColumn("score", F.round("score", 6)), "score", k, "other_id", ["user_id"])


def by_shared(scores: DataFrame, events: DataFrame, key: str, most_broadcast: int = 500_000, parts: int = 64, users: int = 2_000) -> DataFrame:
    """(user_id, event_id, score) of every event (event_id, key) for every score (user_id, key, score) of its key. There
    may be very many, so they are made where events are read, dealt over `parts` tasks at least, and never shuffled: a
    key's scores stand in arrays of about `users` users. Up to most_broadcast scores are broadcast; more are dealt by
    user, and each deal meets each part of the events by join."""
    n = scores.count()
    deals, lists = -(-n // most_broadcast), max(1, scores.select("user_id").distinct().count() // users)
    dealt = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    packed = scores.withColumn("_list", dealt("user_id", lists)).groupBy(key, "_list").agg(F.collect_list(F.struct("user_id", "score")).alias("_s"))
    made = lambda df: df.select("event_id", F.explode("_s").alias("_s")).select("_s.user_id", "event_id", "_s.score")
    if deals <= 1:
        return made(events.repartition(parts, "event_id").join(F.broadcast(packed), key))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    e = events.withColumn("_part", dealt("event_id", parts)).withColumn("_deal", each(deals))
    s, on = packed.withColumn("_deal", F.col("_list") % deals).withColumn("_part", each(parts)), ["_deal", "_part"]
    return made(e.repartition(deals * parts, *on).join(s.repartition(deals * parts, *on), [*on, key]))


def cascade(models: list[DataFrame], users: list[DataFrame] | None = None) -> DataFrame:
    """(user_id, event_id, score, model): for each user the rows (user_id, event_id, score) of the first model that has
    any for them; model counts from 1. users: those (user_id) that each model has rows for, where a table smaller than
    its rows tells them."""
    every = taken = None
    for i, m in enumerate(models):
        has = m.select("user_id") if users is None else users[i].select("user_id")
        m = m.select("user_id", "event_id", "score", F.lit(i + 1).alias("model"))
        m = m if taken is None else m.join(taken, "user_id", "left_anti")
        every, taken = (m, has.distinct()) if every is None else (every.unionByName(m), taken.unionByName(has.distinct()))
    return every
