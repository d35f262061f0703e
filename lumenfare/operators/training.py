"""Training sets and ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.operators.sequence import counted


def positives(interactions: DataFrame, least: int = 3) -> DataFrame:
    """(user_id, event_id) of positive interactions, of users with at least `least` interactions."""
    active = interactions.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("user_id")
    good = F.col("kind").isin("like", "going", "went", "save") | (F.coalesce("rating", F.lit(0.0)) >= 4)
    return interactions.where(good).select("user_id", "event_id").distinct().join(active, "user_id", "left_semi")


def numbered(items: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """items with slot, the place of each from 0 in order of an integer key without repeats: by offsets of ranges of
    `width` keys, so that only one row a range passes through one task."""
    b = items.withColumn("_range", F.floor(F.col(key) / width))
    first = b.groupBy("_range").agg(F.count("*").alias("_n"))
    first = first.withColumn("_first", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy("_range").orderBy(key)) - 1
    return b.withColumn("_place", place).join(first, "_range").withColumn("slot", F.col("_first") + F.col("_place")).drop("_range", "_place", "_first")


def negatives(pos: DataFrame, items: DataFrame, ratio: int = 5, tries: int = 10) -> DataFrame:
    """Up to ratio items per positive that the user has no positive with.

    Each positive draws `tries` items by arithmetic on its keys from the numbered items, and keeps the first that are
    not positives: no user meets all items.
    """
    slots = numbered(items.select("event_id").distinct(), "event_id")
    n = slots.agg(F.count("*").alias("n_items"))
    draws = pos.join(F.broadcast(n)).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(tries)))).select("user_id", F.col("event_id").alias("anchor"), "k", ((F.col("user_id") * 7919 + F.col("event_id") * 104729 + F.col("k") * 15485863) % F.col("n_items")).alias("slot"))
    drawn = draws.join(slots, "slot").join(pos, ["user_id", "event_id"], "left_anti")
    first = drawn.groupBy("user_id", "anchor", "event_id").agg(F.min("k").alias("k"))
    return first.withColumn("r", F.row_number().over(W.partitionBy("user_id", "anchor").orderBy("k"))).where(F.col("r") <= ratio).select("user_id", "event_id").distinct()


def exact_negatives(pos: DataFrame, items: DataFrame, ratio: int = 5) -> DataFrame:
    """(user_id, anchor, event_id): for each positive (user_id, event_id), its anchor, min(ratio, unseen) different items
    that the user has no positive with, unseen being the number of those.

    Items are numbered, and a user's unseen ones have ranks 0 to unseen - 1 among themselves. An anchor takes ranks that
    lie unseen / take apart, from a start that the ids give. Rank r is item r + k, where k counts the user's positives
    whose slot less those before is at most r: ranks and positives are sorted together, in blocks, so that one user's
    rows lie in many tasks, no draw is repeated and none fails. Repeated positives count once; null ids and items that
    are not in `items` are not drawn from.
    """
    slots = numbered(items.select("event_id").where("event_id is not null").distinct(), "event_id")
    pos = pos.select("user_id", "event_id").where("user_id is not null and event_id is not null").distinct()
    seen = counted(pos.join(slots, "event_id").select("user_id", "slot"), "user_id", "slot", "place")
    seen = seen.select("user_id", (F.col("slot") - F.col("place") + 1).alias("rank"))
    n, own = slots.agg(F.count("*").alias("n")), seen.groupBy("user_id").agg(F.count("*").alias("m"))
    draws = pos.join(own, "user_id", "left").join(F.broadcast(n)).withColumn("unseen", F.col("n") - F.coalesce("m", F.lit(0))).where("unseen > 0")
    draws = draws.withColumn("take", F.least("unseen", F.lit(ratio))).withColumn("k", F.explode(F.expr("sequence(0L, take - 1)")))
    rank = (F.pmod(F.col("user_id") * 7919 + F.col("event_id") * 104729, F.col("unseen")) + F.col("k") * F.floor(F.col("unseen") / F.col("take"))) % F.col("unseen")
    both = seen.select("user_id", "rank", F.lit(None).cast("long").alias("anchor")).unionByName(draws.select("user_id", rank.alias("rank"), F.col("event_id").alias("anchor")))
    found = counted(both, "user_id", "rank", "seen", F.col("anchor").isNull(), [F.asc_nulls_first("anchor")]).where("anchor is not null")
    return found.select("user_id", "anchor", (F.col("rank") + F.col("seen")).alias("slot")).join(slots, "slot").select("user_id", "anchor", "event_id")


def split(df: DataFrame, by: str, order: list, share: float = 0.8) -> DataFrame:
    """df with part: train for the first floor(share * n) rows of each group, else test."""
    w = W.partitionBy(by)
    return df.withColumn("part", F.when(F.row_number().over(w.orderBy(*order)) <= F.floor(F.count("*").over(w) * share), "train").otherwise("test"))


#: Ranges of scores whose counts are summed apart.
RANGES = 4096


def _summed(c: DataFrame, label: str, low: float, step: float, down: bool) -> DataFrame:
    """c (s, p, q) with the sums of p and q over all lower scores (or the higher ones), named by label: within ranges of
    scores by windows, and over ranges by one window of RANGES rows."""
    order, near = (F.desc, "above") if down else (F.asc, "below")
    r = c.withColumn("_r", F.least(F.lit(RANGES - 1), F.floor((F.col("s") - low) / step).cast("int")) if step else F.lit(0))
    w = W.partitionBy("_r").orderBy(order("s")).rowsBetween(W.unboundedPreceding, -1)
    whole = r.groupBy("_r").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    over = W.orderBy(order("_r")).rowsBetween(W.unboundedPreceding, -1)
    first = whole.select("_r", *[F.coalesce(F.sum(f"_{x}").over(over), F.lit(0)).alias(f"_first_{x}") for x in "pq"])
    inner = r.withColumns({f"_own_{x}": F.coalesce(F.sum(x).over(w), F.lit(0)) for x in "pq"})
    return inner.join(first, "_r").select(*c.columns, *[(F.col(f"_own_{x}") + F.col(f"_first_{x}")).alias(f"{label}_{x}") for x in "pq"])


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by mean ranks of tied scores, from counts per distinct score, and average precision."""
    c = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    low, high = c.agg(F.min("s"), F.max("s")).first()
    step = (high - low) / RANGES if low is not None and high > low else 0.0
    c = _summed(_summed(c, "below", low or 0.0, step, False), "above", low or 0.0, step, True)
    cp, cq = F.col("above_p") + F.col("p"), F.col("above_q") + F.col("q")
    return c.agg((F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("roc_auc"), (F.sum(F.col("p") * cp / (cp + cq)) / F.sum("p")).alias("pr_auc"))


def at_threshold(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision and recall of scores of `threshold` or more as positives; 0 where nothing is counted."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    c = df.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count("*").alias("n"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(share(F.col("n") - fp - fn, F.col("n")).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"))


def balanced(examples: DataFrame, least: int = 10) -> DataFrame:
    """Of examples (user_id, event_id, label) at most a target for each user: `least`, or half of the mean if that is
    more. A user with more keeps at most half the target of positives, and negatives for the rest; which ones is by a
    hash-like order of the ids, the same at every run."""
    n = examples.agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u"))
    target = F.greatest(F.lit(least), F.floor(F.col("n") / (F.col("u") * 2))).cast("int")
    own = W.partitionBy("user_id")
    mixed = (F.col("user_id") * 7919 + F.col("event_id") * 104729) % 1000003
    e = examples.join(F.broadcast(n.select(target.alias("target")))).withColumns({"own": F.count("*").over(own), "pos": F.sum("label").over(own), "place": F.row_number().over(W.partitionBy("user_id", "label").orderBy(mixed, "event_id"))})
    half = F.least(F.col("pos"), F.floor(F.col("target") / 2))
    keep = F.when(F.col("own") <= F.col("target"), True).when(F.col("label") == 1, F.col("place") <= half).otherwise(F.col("place") <= F.col("target") - half)
    return e.where(keep).select("user_id", "event_id", "label")


def enriched(interactions: DataFrame, events: DataFrame, venues: DataFrame, now, days: int = 180) -> DataFrame:
    """Interactions of the last `days` with their event's genres, prices and venue, in no order."""
    recent = interactions.where((F.col("ts") >= now - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= now))
    e = events.join(venues.select("venue_id", F.col("name").alias("venue_name"), "lat", "lon"), "venue_id", "left")
    return recent.join(e.select("event_id", "genres", "price_min", "price_max", "venue_name", "lat", "lon", "date_time"), "event_id")


class EarlyStop:
    """Says when a loss has not fallen by `least` for `patience` steps, and keeps the best state."""

    def __init__(self, patience: int = 10, least: float = 0.0):
        self.patience, self.least, self.best, self.state, self.waited = patience, least, None, None, 0

    def step(self, loss: float, state) -> bool:
        if self.best is None or loss < self.best - self.least:
            self.best, self.state, self.waited = loss, state, 0
        else:
            self.waited += 1
        return self.waited >= self.patience


def train_ranker(rows: DataFrame, features: list[str], label: str, part: str, steps: int = 60, rate: float = 2.0, patience: int = 5) -> tuple[list[float], float]:
    """Weights of the features and the bias last, and the best loss, of a logistic ranker by gradient steps on all rows
    whose `part` is train; the weights of the least loss on the other rows stand. Each step is one aggregation: only
    sums come to the driver."""
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    data = rows.select(F.array(*x).alias("x"), F.col(label).cast("double").alias("y"), (F.col(part) == "train").alias("t")).persist()
    w, stop = [0.0] * len(x), EarlyStop(patience)
    try:
        for _ in range(steps):
            z = F.aggregate(F.zip_with("x", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            p = data.withColumn("p", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-z)))))
            off = F.col("p") - F.col("y")
            loss = -(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))
            r = p.agg(F.count_if("t").alias("n"), F.avg(F.when(~F.col("t"), loss)).alias("loss"), *[F.sum(F.when(F.col("t"), off * F.col("x")[k])).alias(f"g{k}") for k in range(len(x))]).first()
            if stop.step(r["loss"] if r["loss"] is not None else 0.0, w) or not r["n"]:
                break
            w = [a - rate * (r[f"g{k}"] or 0.0) / r["n"] for k, a in enumerate(w)]
    finally:
        data.unpersist()
    return stop.state, stop.best


def ndcg(df: DataFrame, by: str, score: str, label: str, tie: str, k: int = 10) -> DataFrame:
    """(by, ndcg) of groups with two rows or more and more than one label."""
    w = W.partitionBy(by)
    r = df.withColumns({"rp": F.row_number().over(w.orderBy(F.desc(score), tie)), "rl": F.row_number().over(w.orderBy(F.desc(label), tie))})
    gain = lambda rank: F.sum(F.when(F.col(rank) <= k, F.col(label) / F.log2(F.col(rank) + 1.0)).otherwise(0.0))
    g = r.groupBy(by).agg(F.count("*").alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"), gain("rp").alias("dcg"), gain("rl").alias("ideal"))
    return g.where("n >= 2 and lo < hi").select(by, (F.col("dcg") / F.col("ideal")).alias("ndcg"))


def at_k(ranked: DataFrame, truth: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """Mean precision and recall at k over users with truth, F1 of the means, and the number of users."""
    hits = ranked.where(F.col("rank") <= k).join(truth, [by, item], "left_semi").groupBy(by).agg(F.count("*").alias("hits"))
    per = truth.groupBy(by).agg(F.count("*").alias("n")).join(hits, by, "left").select((F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("p"), (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("r"))
    m = per.agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.count("*").alias("users"))
    return m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))
