"""Recommendation: content similarity, popularity, diversity, co-occurrence, sequences, re-ranking."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.functions import scores as S
from lumenfare.operators import blocks as B
from lumenfare.operators.sequence import chained, counted, walked
from lumenfare.sources.shared import stored

# The weight of each kind of interaction.
WEIGHTS = {"like": 1.0, "going": 2.0, "went": 1.5, "save": 0.8, "dislike": -0.5}


def weight(kind: Column, rating: Column | None = None) -> Column:
    """A kind's weight, .5 for unknown kinds; a visit's scaled by its rating out of 5."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[kind], F.lit(0.5))
    return w if rating is None else F.when((kind == "went") & rating.isNotNull(), w * rating / 5).otherwise(w)


def top(df: DataFrame, score: str, k: int, tie: str, by: list[str] | None = None) -> DataFrame:
    """The k best rows, of each group if there are groups, with rank from 1."""
    order = [F.desc(score), F.asc(tie)]
    if not by:
        return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def genre_popularity(events: DataFrame, interactions: DataFrame) -> DataFrame:
    """Each genre's share of all events' genres and weighted interactions."""
    w = interactions.groupBy("event_id").agg(F.sum(weight(F.col("kind"))).alias("w"))
    g = events.join(w, "event_id", "left").select(F.explode("genres").alias("genre"), (1 + F.coalesce("w", F.lit(0.0))).alias("w")).groupBy("genre").agg(F.sum("w").alias("w"))
    return g.select("genre", (F.col("w") / F.sum("w").over(W.partitionBy())).alias("share"))


def similar_events(events: DataFrame, event_id: int) -> DataFrame:
    """.5 genre overlap + .3 same venue + .2 same neighborhood with one event; only positive scores."""
    one = events.where(F.col("event_id") == event_id).select(F.col("genres").alias("g"), F.col("venue_id").alias("v"), F.col("neighborhood").alias("n"))
    score = 0.5 * S.overlap(F.col("genres"), F.col("g")) + F.when(F.col("venue_id") == F.col("v"), 0.3).otherwise(0.0) + F.when(F.col("neighborhood") == F.col("n"), 0.2).otherwise(0.0)
    return events.where(F.col("event_id") != event_id).join(F.broadcast(one)).withColumn("score", score).where("score > 0").drop("g", "v", "n")


def diversity_penalty(candidates: DataFrame, factor: float = 0.1) -> DataFrame:
    """score less factor * Jaccard for each candidate that shares genres with a better one (ties: the later loses).

    For a bounded candidate list, such as the candidates of one request: pairs meet by genre.
    """
    g = candidates.select("event_id", "score", "genres", F.explode("genres").alias("genre"))
    a, b = g.alias("a"), g.alias("b")
    better = (F.col("a.score") > F.col("b.score")) | ((F.col("a.score") == F.col("b.score")) & (F.col("a.event_id") < F.col("b.event_id")))
    pairs = a.join(b, (F.col("a.genre") == F.col("b.genre")) & better).select(F.col("a.event_id").alias("i"), F.col("b.event_id").alias("event_id"), S.jaccard(F.col("a.genres"), F.col("b.genres")).alias("j")).distinct()
    lost = pairs.groupBy("event_id").agg((F.sum("j") * factor).alias("lost"))
    return candidates.join(lost, "event_id", "left").withColumn("score", S.clip(F.col("score") - F.coalesce("lost", F.lit(0.0)))).drop("lost")


def popularity_fallback(events: DataFrame, seed: int = 0, spread: float = 0.1) -> DataFrame:
    """(event_id, score): popularity with a noise of up to `spread` either way, within 0 and 1. The noise is a rule of
    event_id and seed in steps of a thousandth of it, so that reruns and repeated rows agree; a null popularity is 0."""
    step = F.pmod(F.pmod(F.col("event_id"), F.lit(1_000_003)) * 7919 + seed * 104_729, F.lit(2001)) - 1000
    return events.select("event_id", S.clip(F.coalesce("popularity", F.lit(0.0)) + step / 1000.0 * spread).alias("score"))


def anchored_windows(df: DataFrame, user: str, at: str, hours: int = 24) -> DataFrame:
    """df with win, the start of its window: a user's window opens at the first row that is later than `hours` after
    the last window's opening. Ties in time stand in order of `id`."""
    span = timedelta(hours=hours)

    def step(start, t):
        start = t if start is None or t - start > span else start
        return start, start

    return walked(df, user, at, "id", "win", df.schema[at].dataType, step)


def chained_windows(df: DataFrame, user: str, at: str, hours: int = 24) -> DataFrame:
    """anchored_windows without a walk over rows; rows without user, time or id have no window (null).

    A window's next one opens at its user's first row that is later than `hours` after it: a jump from each row to
    another, found by sorting rows together with markers that stand `hours` later. The rows that a user's first one
    reaches by jumps open the windows; doubling the jumps finds them in log n rounds of joins, one user's rows in many
    tasks.
    """
    span, known = hours * 3_600_000_000, F.col(user).isNotNull() & F.col(at).isNotNull() & F.col("id").isNotNull()
    t = df.where(known).withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    t = stored(counted(t, user, "_us", "_node", order=["id"], width=span))
    rows = t.select(F.col(user).alias("group"), F.col("_us").alias("us"), F.col("_node").alias("node"))
    # Behind the rows of its time, a marker counts the rows of the window that its row would open, and all before.
    marks = rows.withColumn("us", F.col("us") + span).unionByName(rows.withColumn("node", F.lit(None).cast("long")))
    ends = counted(marks, "group", "us", "upto", F.col("node").isNull(), [F.asc_nulls_first("node")], span).where("node is not null")
    last = rows.groupBy("group").agg(F.max("node").alias("last"))
    jumps = ends.join(last, "group").where("upto < last").select("group", "node", (F.col("upto") + 1).alias("to"))
    opened = chained(jumps, rows.where("node = 1")).select(F.col("group").alias(user), F.col("node").alias("_node"), F.lit(True).alias("_opens"))
    # A row's window is the n-th of its user's, n being the number of openings up to the row.
    o = stored(counted(t.join(opened, [user, "_node"], "left"), user, "_us", "_no", F.col("_opens").isNotNull(), ["_node"], span))
    starts = o.where("_opens").select(user, "_no", F.col(at).alias("win"))
    out = o.join(starts, [user, "_no"]).select(*df.columns, "win")
    return out.unionByName(df.where(~known).withColumn("win", F.lit(None).cast(df.schema[at].dataType)))


def cooccurrence(windowed: DataFrame, user: str) -> DataFrame:
    """(a, b, weight): how often two items stand in one user's window, over the most frequent pair's count."""
    items = windowed.select(user, "win", F.col("event_id").alias("e")).distinct()
    a, b = items.alias("a"), items.alias("b")
    n = a.join(b, (F.col(f"a.{user}") == F.col(f"b.{user}")) & (F.col("a.win") == F.col("b.win")) & (F.col("a.e") < F.col("b.e"))).groupBy(F.col("a.e").alias("a"), F.col("b.e").alias("b")).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.join(F.broadcast(most)).select("a", "b", "n", (F.col("n") / F.col("most")).alias("weight"))


def transitions(df: DataFrame, user: str, order: list, item: str) -> DataFrame:
    """(source, target, n): how often an item follows another in a user's order."""
    nxt = F.lead(item).over(W.partitionBy(user).orderBy(*order))
    return df.withColumn("target", nxt).where("target is not null").groupBy(F.col(item).alias("source"), "target").agg(F.count("*").alias("n"))


def _paired(vectors: DataFrame, query: DataFrame, most_broadcast: int, vector_blocks: int) -> DataFrame:
    """Every vector (vec_id, embedding) beside every query (query_id, q). Up to most_broadcast queries are broadcast; more
    are dealt into blocks of about that many, and every block meets every one of vector_blocks parts of the vectors by an
    ordinary join, so that a task holds one part of each."""
    blocks = -(-query.count() // most_broadcast)
    if blocks <= 1:
        return vectors.join(F.broadcast(query))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = query.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("v_block", each(vector_blocks))
    v = vectors.withColumn("v_block", F.pmod(F.xxhash64("vec_id"), F.lit(vector_blocks)).cast("int")).withColumn("q_block", each(blocks))
    return v.join(q, ["q_block", "v_block"])


def nearest(vectors: DataFrame, query: DataFrame, k: int, most_queries: int = 20_000, vector_blocks: int | None = None) -> DataFrame:
    """(query_id, vec_id, score) of the k most similar vectors of each query by cosine.

    The queries are a stated set that meets all vectors: every block of about most_queries of them meets each part of the
    vectors (about 16,384, or fewer where there are few) in a task, and only what may be among a query's k best leaves
    it. A vector that is null, holds a null or has another number of values than the query is 0 alike.
    """
    whole = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c)).otherwise(F.array().cast(vectors.schema["embedding"].dataType))
    q = query.where("vec_id is not null").select(F.col("vec_id").alias("query_id"), whole("embedding").alias("q"))
    v = vectors.where("vec_id is not null").select("vec_id", whole("embedding").alias("embedding"))
    n, kind = v.count(), vectors.schema["vec_id"].dataType.simpleString()
    blocks, parts = max(1, -(-q.count() // most_queries)), vector_blocks or max(1, -(-n // 16_384), min(64, -(-n // 1_024)))
    met = B.dealt(q, v, "query_id", "vec_id", blocks, parts).applyInPandas(B.nearest_in(k), f"query_id {kind}, vec_id {kind}, score double")
    return top(met.withColumn("score", F.round("score", 6)), "score", k, "vec_id", ["query_id"])


def assigned(vectors: DataFrame, prototypes: DataFrame, most_broadcast: int = 20_000, vector_blocks: int = 64) -> DataFrame:
    """(vec_id, query_id, score): the prototype (vec_id, embedding) most like each vector by cosine, the lowest id of
    equal ones. Any number of prototypes meets the vectors in blocks, and tasks keep one best prototype a vector."""
    q = prototypes.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = _paired(vectors.select("vec_id", "embedding"), q, most_broadcast, vector_blocks).select("vec_id", F.struct(S.cosine(F.col("embedding"), F.col("q")).alias("score"), (-F.col("query_id")).alias("id")).alias("b"))
    best = s.groupBy("vec_id").agg(F.max("b").alias("b"))
    return best.select("vec_id", (-F.col("b.id")).alias("query_id"), F.col("b.score").alias("score"))


def tf_idf(docs: DataFrame, least_df: int = 2, most_share: float = 0.95, most_terms: int | None = None) -> DataFrame:
    """(id, term, weight) of docs (id, terms): tf * (ln((1+n)/(1+df)) + 1), each document scaled to length 1.

    With most_terms only that many terms count, those that occur most often in all, ties in order of the alphabet.
    """
    tf = docs.select("id", F.explode("terms").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    kept = df.join(F.broadcast(n)).where((F.col("df") >= least_df) & (F.col("df") <= F.col("n") * most_share))
    kept = kept if most_terms is None else kept.orderBy(F.desc("total"), "term").limit(most_terms)
    idf = kept.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = tf.join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return w.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))).alias("weight"))


def unseen_topk(model, seen: DataFrame, k: int) -> DataFrame:
    """(user_id, event_id, score, rank) of the k best unseen items of every user of seen (user_id, event_id) by a fitted model.

    A user's k + n best items hold the k best unseen ones, n being the number of items seen. Users are asked for in
    classes by the binary digits of n, each with its largest n, so that candidates are fewer than k a user and two for
    each row of seen.
    """
    size = seen.groupBy("user_id").agg(F.length(F.bin(F.count_distinct("event_id"))).alias("digits"))
    found = None
    for n in sorted(r.digits for r in size.select("digits").distinct().collect()):
        r = model.recommendForUserSubset(size.where(F.col("digits") == n).select("user_id"), min(k + 2**n - 1, 2**31 - 1))
        found = r if found is None else found.unionByName(r)
    r = found.select("user_id", F.explode("recommendations").alias("r")).select("user_id", "r.event_id", F.col("r.rating").cast("double").alias("score"))
    return top(r.join(seen.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti"), "score", k, "event_id", ["user_id"])


def factors(model, kind: str, ids: DataFrame) -> DataFrame:
    """(id, features) of the named users or items (id) of a fitted model; kind is user or item. Unknown ids are left out."""
    return (model.userFactors if kind == "user" else model.itemFactors).join(ids.select("id").distinct(), "id", "left_semi")


def nearest_users(model, users: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score) of the k users whose factors are nearest those of the named users (id) by cosine."""
    vectors = model.userFactors.select(F.col("id").alias("vec_id"), F.col("features").alias("embedding"))
    asked = factors(model, "user", users).select(F.col("id").alias("vec_id"), F.col("features").alias("embedding"))
    return nearest(vectors, asked, k)


def training_weights(interactions: DataFrame) -> DataFrame:
    """(user_id, event_id, w, is_positive): the sum of the weights of a user's interactions with an event, visits by
    their rating; positive above 0. Weights are added as decimals of nine places: a sum of doubles that should be 0 has
    the sign that the order of its rows gives it."""
    w = interactions.groupBy("user_id", "event_id").agg(F.sum(weight(F.col("kind"), F.col("rating")).cast("decimal(18,9)")).cast("double").alias("w"))
    return w.withColumn("is_positive", F.col("w") > 0)


def sampled(items: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n items in an order that only the key and the seed give, as a draw without replacement that every run repeats."""
    mixed = (F.col(key) * (2 * seed + 7919) + seed * 104729) % 1000003
    return items.orderBy(mixed, key).limit(n)
