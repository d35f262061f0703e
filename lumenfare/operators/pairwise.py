"""Pairwise ranking by factors (Bayesian personalised ranking): a user's score of an item is u.e + b_u + b_e + g.

Stochastic descent on -log sigmoid(score(positive) - score(negative)) over strata. Users and items are dealt into
`blocks` blocks each; in one stratum block b of the users meets block b + s of the items, so that the stratum's tasks
share no factor and each moves its own as it goes. After `blocks` strata every pair of blocks has met, which is an
epoch; items are then dealt anew. Negatives come from the task's item block, where all of a user's positives of that
block are at hand, by rank among the others: none is a positive. b_u and g cancel in every difference and stay 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.operators.training import exact_negatives
from lumenfare.sources.shared import stored

#: Positives whose gradients are added up before factors move, and negatives for each.
BATCH, RATIO = 1024, 5
_FACTOR = "kind int, id long, vec array<double>"


def started(positives: DataFrame, dim: int, seed: int) -> DataFrame:
    """(kind, id, vec) of the users (0) and items (1) of positives: dim factors between -.17 and .17 that the id gives,
    as wide as a normal draw of deviation .1, then a bias of 0 and the sum of squared gradients so far, 0."""
    ids = positives.select(F.lit(0).alias("kind"), F.col("user_id").alias("id")).unionByName(positives.select(F.lit(1).alias("kind"), F.col("event_id").alias("id"))).distinct()
    draw = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "kind", "id", k), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5) * (0.2 * 3**0.5)
    return ids.withColumn("vec", F.concat(F.transform(F.sequence(F.lit(1), F.lit(dim)), draw), F.array(F.lit(0.0), F.lit(0.0))))


def _negatives(users: np.ndarray, items: np.ndarray, n_items: int, ratio: int, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the positive, item) of up to `ratio` items for each positive, none of which the user has here. Rows of a
    user stand together, and all of them are here."""
    at, out = [], []
    edges = np.flatnonzero(np.concatenate(([True], users[1:] != users[:-1], [True]))) if len(users) else users
    for low, high in zip(edges[:-1], edges[1:]):
        own = np.sort(items[low:high])
        unseen = n_items - len(own)
        take = min(ratio, unseen)
        if take <= 0:
            continue
        start = (items[low:high] * 7919 + mark * 104729 + users[low] * 31) % unseen
        rank = (start[:, None] + np.arange(take) * (unseen // take)) % unseen
        out.append((rank + np.searchsorted(own - np.arange(len(own)), rank, side="right")).ravel())
        at.append(np.repeat(np.arange(low, high), take))
    none = np.empty(0, np.int64)
    return (np.concatenate(at), np.concatenate(out)) if at else (none, none)


def _add(state: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Moves rows of state (factors, bias, sum of squares) along the sum of their gradients, by less the more they have
    moved."""
    which, at = np.unique(rows, return_inverse=True)
    total = np.zeros((len(which), gradient.shape[1]))
    np.add.at(total, at, gradient)
    state[which, -1] += (total**2).mean(axis=1)
    state[which, :-1] += rate * total / np.sqrt(state[which, -1:] + 1e-8)


def descend(u: np.ndarray, v: np.ndarray, users: np.ndarray, items: np.ndarray, mark: int, rate: float, decay: float) -> None:
    """One batch: gradients of every (user, positive, negative) at the factors as they are, then one move of each row."""
    at, neg = _negatives(users, items, len(v), RATIO, mark)
    if not len(at):
        return
    a, i = users[at], items[at]
    d = v.shape[1] - 2
    gap = (u[a, :d] * (v[i, :d] - v[neg, :d])).sum(axis=1) + v[i, d] - v[neg, d]
    c = (1 / (1 + np.exp(np.clip(gap, -30, 30))))[:, None]
    zero, one = np.zeros((len(at), 1)), np.ones((len(at), 1))
    with_bias = lambda x, b: np.concatenate((x, b), axis=1)
    gu = with_bias(c * (v[i, :d] - v[neg, :d]) - decay * u[a, :d], zero)
    gi, gn = (with_bias(s * c * u[a, :d], s * c * one) - decay * v[r, : d + 1] for s, r in ((1, i), (-1, neg)))
    _add(v, np.concatenate((i, neg)), np.concatenate((gi, gn)), rate)
    _add(u, a, gu, rate)


def _trained(mark: int, rate: float, decay: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by block: factors of users, of items, then positives, a user's together."""
        block, held, wait = None, ([], []), []

        def descended() -> None:
            nonlocal wait, tables
            if tables is None:
                tables = [(np.array([i for i, _ in h], np.int64), np.array([x for _, x in h], float)) for h in held]
            if wait:
                rows, (uid, u), (vid, v) = np.array(wait, np.int64), *tables
                descend(u, v, np.searchsorted(uid, rows[:, 0]), np.searchsorted(vid, rows[:, 1]), mark, rate, decay)
            wait = []

        def emitted() -> pd.DataFrame:
            descended()
            return pd.concat([pd.DataFrame({"kind": k, "id": ids, "vec": list(x)}) for k, (ids, x) in enumerate(tables)])

        tables = None
        for pdf in frames:
            for b, kind, x, y, vec in zip(*[pdf[c].tolist() for c in ("block", "kind", "x", "y", "vec")]):
                if b != block:
                    if block is not None:
                        yield emitted()
                    block, held, wait, tables = b, ([], []), [], None
                if kind < 2:
                    held[kind].append((x, vec))
                else:
                    if len(wait) >= BATCH and x != wait[-1][0]:
                        descended()
                    wait.append((x, y))
        if block is not None:
            yield emitted()

    return run


def train(positives: DataFrame, dim: int = 16, epochs: int = 4, blocks: int = 4, rate: float = 0.1, decay: float = 1e-3, seed: int = 1, each=None) -> DataFrame:
    """(kind, id, vec) after `epochs` epochs over positives (user_id, event_id); each(epoch, factors), if given, is called
    with the factors at the start and after every epoch.

    A worker holds one block of users, one of items and a batch with all positives of its last user, which are no more
    than the block's items: choose `blocks` so that a block fits. Every epoch writes the positives by stratum, and every
    stratum reads its own and writes the factors anew, so a lost executor costs a stratum's tasks.
    """
    rows = positives.select("user_id", "event_id").where("user_id is not null and event_id is not null").distinct()
    factors, user_block = stored(started(rows, dim, seed)), F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    if each:
        each(0, factors)
    for epoch in range(1, epochs + 1):
        item_block = lambda c: F.pmod(F.xxhash64(F.lit(epoch), c), F.lit(blocks)).cast("int")  # noqa: B023, E731
        p = rows.withColumns({"block": user_block, "stratum": F.pmod(item_block("event_id") - user_block, F.lit(blocks)).cast("int")})
        p = stored(p, "stratum")
        for s in range(blocks):
            own = F.when(F.col("kind") == 0, F.pmod(F.xxhash64("id"), F.lit(blocks))).otherwise(F.pmod(item_block("id") - s, F.lit(blocks))).cast("int")
            f = factors.select(own.alias("block"), "kind", F.col("id").alias("order"), F.col("id").alias("x"), F.lit(None).cast("long").alias("y"), "vec")
            t = p.where(F.col("stratum") == s).select("block", F.lit(2).alias("kind"), F.xxhash64(F.lit(epoch), "user_id").alias("order"), F.col("user_id").alias("x"), F.col("event_id").alias("y"), F.lit(None).cast("array<double>").alias("vec"))
            dealt = f.unionByName(t).repartition(blocks, "block").sortWithinPartitions("block", "kind", "order", "x", "y")
            factors = stored(dealt.mapInPandas(_trained(epoch * blocks + s, rate, decay), _FACTOR))
        if each:
            each(epoch, factors)
    return factors


def score(u: str, e: str) -> Column:
    """The score of a user's and an item's vec as train() keeps them."""
    n = F.size(u) - 2
    dot = F.aggregate(F.zip_with(F.slice(u, F.lit(1), n), F.slice(e, F.lit(1), n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return dot + F.element_at(F.col(u), -2) + F.element_at(F.col(e), -2)


def _side(factors: DataFrame, kind: int, key: str, vec: str) -> DataFrame:
    return factors.where(F.col("kind") == kind).select(F.col("id").alias(key), F.col("vec").alias(vec))


def loss(factors: DataFrame, triplets: DataFrame, *by: str) -> DataFrame:
    """(by, loss, right, n): mean -log sigmoid of the gaps of triplets (user_id, anchor, event_id), and the share of gaps
    above 0, of those whose user and items all have factors."""
    t = triplets.join(_side(factors, 0, "user_id", "u"), "user_id").join(_side(factors, 1, "anchor", "p"), "anchor").join(_side(factors, 1, "event_id", "n"), "event_id")
    gap = score("u", "p") - score("u", "n")
    return t.select(*by, gap.alias("gap")).groupBy(*by).agg(F.avg(F.log1p(F.exp(-F.col("gap")))).alias("loss"), F.avg((F.col("gap") > 0).cast("double")).alias("right"), F.count("*").alias("n"))


def held_out(positives: DataFrame, share: int = 10) -> tuple[DataFrame, DataFrame]:
    """(positives to train on, triplets of the others): one in `share` is held out, by its ids, with one item that its
    user has no positive with at all."""
    mark = F.pmod(F.xxhash64("user_id", "event_id"), F.lit(share)) == 0
    known = positives.where(~mark)
    every = exact_negatives(positives, known.select("event_id"), 1)
    return known, every.join(positives.where(mark).withColumnRenamed("event_id", "anchor"), ["user_id", "anchor"], "left_semi")


def recommend(factors: DataFrame, asked: DataFrame, seen: DataFrame, k: int, candidates: DataFrame | None = None, item_parts: int = 16) -> DataFrame:
    """(user_id, event_id, score, rank) of the k best items that each asked user (user_id) has not seen (user_id,
    event_id), of the candidates (event_id) if given. Unknown users and items have no rows; ties go to the smaller id.

    The asked users are a stated set. They meet every part of the items by a join on parts, and every task keeps its own
    k best of a user before the last shuffle.
    """
    items = _side(factors, 1, "event_id", "e")
    items = items if candidates is None else items.join(candidates.select("event_id").distinct(), "event_id", "left_semi")
    users = _side(factors, 0, "user_id", "u").join(asked.select("user_id").distinct(), "user_id", "left_semi")
    users = users.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(item_parts - 1))))
    pairs = items.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(item_parts)).cast("int")).join(users, "part")
    s = pairs.select("user_id", "event_id", score("u", "e").alias("score")).join(seen.select("user_id", "event_id").distinct(), ["user_id", "event_id"], "left_anti")
    return s.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "event_id"))).where(F.col("rank") <= k)
