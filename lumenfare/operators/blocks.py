"""The best of many pairs, found in blocks of both sides: a task holds one block of each, and only what may be among a
row's best leaves it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are scored at once in a task, and columns of a dense part of a sparse table.
PAIRS, COLUMNS = 4_000_000, 128
#: More than an approximate score and rounding to six places can move a score.
MARGIN = 2e-6


def among_best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of those that may be among the k best once scores are rounded to six places, with ties by id. Scores too
    near the middle between two rounded ones count as either. NaN is best, as it is in Spark's order."""
    x = score * 1e6 + 0.5
    r = np.where(np.isnan(score), np.inf, np.floor(x))
    unsure = np.isfinite(r) & (np.abs(x - np.round(x)) < 1e-3)
    sure = np.flatnonzero(~unsure)
    first = sure[np.lexsort((ids[sure], -r[sure]))[:k]]
    least = r[first[-1]] if len(first) == k else -np.inf
    return np.concatenate([first, np.flatnonzero(unsure & (r + 1 >= least))])


def at_least(score: np.ndarray, k: int) -> np.ndarray:
    """For each row, the score that its k best reach within MARGIN; minus infinity where there are no more than k."""
    return np.partition(score, -k, axis=1)[:, -k] - MARGIN if score.shape[1] > k else np.full(len(score), -np.inf)


def dealt(left: DataFrame, right: DataFrame, key: str, other: str, blocks: int, parts: int):
    """The cogroups of each of `blocks` blocks of left with each of `parts` parts of right, by their keys."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    on, tasks = ["_block", "_part"], min(blocks * parts, 4096)
    a = left.withColumn("_block", of(key, blocks)).withColumn("_part", each(parts)).repartition(tasks, *on)
    b = right.withColumn("_part", of(other, parts)).withColumn("_block", each(blocks)).repartition(tasks, *on)
    return a.groupBy(*on).cogroup(b.groupBy(*on))


def _rows(vectors: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, rows, lengths) by number of values; lengths are summed value by value, as the column expression does."""
    size = vectors.map(len).to_numpy()
    out = {}
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        x = np.stack(vectors.iloc[at].to_list()).astype(np.float64)
        out[int(n)] = at, x, np.sqrt(_summed(x, x))
    return out


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = np.zeros(len(a))
    for i in range(a.shape[1]):
        s += a[:, i] * b[:, i]
    return s


def _unit(x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (0 where they have none), and which are too long or short for that."""
    odd = ~np.isfinite(length) | (length > 1e100) | ((length > 0) & (length < 1e-100))
    return np.where((odd | (length == 0))[:, None], 0.0, x / np.where(length == 0, 1.0, length)[:, None]), odd


def nearest_in(k: int):
    """(query_id, vec_id, score) of a block of queries (query_id, q) and a part of the vectors (vec_id, embedding): by
    products of matrices, and those that may be among a query's k best once more value by value."""

    def meet(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        asked, ids, out = queries.query_id.to_numpy(), vectors.vec_id.to_numpy(), []
        with np.errstate(all="ignore"):
            q, v = _rows(queries.q), _rows(vectors.embedding)
            place = {n: (np.full(len(asked), -1), np.full(len(ids), -1)) for n in q.keys() & v.keys()}
            unit = {}
            for n, (a, b) in place.items():
                a[q[n][0]], b[v[n][0]] = np.arange(len(q[n][0])), np.arange(len(v[n][0]))
                unit[n] = _unit(*q[n][1:]), _unit(*v[n][1:])
            for begin in range(0, len(asked), step := max(1, PAIRS // max(1, len(ids)))):
                now = np.arange(begin, min(len(asked), begin + step))
                rough, odd = np.zeros((len(now), len(ids))), np.zeros((len(now), len(ids)), bool)
                for n, (a, _) in place.items():
                    rows, ((qu, q_odd), (vu, v_odd)) = np.flatnonzero(a[now] >= 0), unit[n]
                    here, cols = a[now[rows]], v[n][0]
                    if len(rows):
                        rough[np.ix_(rows, cols)] = qu[here] @ vu.T
                        odd[np.ix_(rows, cols)] = q_odd[here][:, None] | v_odd
                same = asked[now][:, None] == ids
                rough[odd | same] = -np.inf
                i, j = np.nonzero(((rough >= at_least(rough, k)[:, None]) | odd) & ~same)
                score = np.zeros(len(i))
                for n, (a, b) in place.items():
                    at = np.flatnonzero((a[now[i]] >= 0) & (b[j] >= 0))
                    x, y = a[now[i[at]]], b[j[at]]
                    size = v[n][2][y] * q[n][2][x]
                    score[at] = np.where(size <= 0, 0.0, _summed(v[n][1][y], q[n][1][x]) / size)
                ends = np.searchsorted(i, np.arange(len(now) + 1))
                for r, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
                    at = lo + among_best(score[lo:hi], ids[j[lo:hi]], k)
                    out.append(pd.DataFrame({"query_id": asked[now[r]], "vec_id": ids[j[at]], "score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": asked[:0], "vec_id": ids[:0], "score": np.zeros(0)})

    return meet


def _sparse(value: np.ndarray, code: np.ndarray, who: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, rows, their places among the rows, columns, values) of each dense part of a sparse table."""
    order = np.argsort(code, kind="stable")
    code, who, value = code[order], who[order], value[order]
    number = code // width
    for n in np.unique(number):
        lo, hi = np.searchsorted(number, [n, n + 1])
        rows, at = np.unique(who[lo:hi], return_inverse=True)
        yield int(n), rows, at, code[lo:hi] - n * width, value[lo:hi]


def alike_in(k: int):
    """(user_id, other_id, score) of a block of users (asked_id, asked_event, v) and a part of all (user_id, event_id, w): sums
    of products over the events that both have, by products of dense parts with some events for columns, the most frequent
    ones together."""
    width = COLUMNS

    def meet(asked: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        known, often = np.unique(others.event_id.to_numpy(), return_counts=True)
        known = known[np.argsort(-often, kind="stable")]
        places = pd.Index(known)
        asked = asked[asked.asked_event.isin(known)]
        ids, who = np.unique(others.user_id.to_numpy(), return_inverse=True)
        right = list(_sparse(others.w.to_numpy(), places.get_indexer(others.event_id), who, width))
        users, which = np.unique(asked.asked_id.to_numpy(), return_inverse=True)
        code, value = places.get_indexer(asked.asked_event), asked.v.to_numpy()

        def dense(n, at, col, v):
            x, there = np.zeros((n, width)), np.zeros((n, width), np.float32)
            np.add.at(x, (at, col), v)
            there[at, col] = 1
            return x, there

        for begin in range(0, len(users), step := max(1, PAIRS // max(1, len(ids)))):
            here = np.flatnonzero((which >= begin) & (which < begin + step))
            n = min(step, len(users) - begin)
            score, shared = np.zeros((n, len(ids))), np.zeros((n, len(ids)), np.float32)
            left = {g: x for g, *x in _sparse(value[here], code[here], which[here] - begin, width)}
            for g, cols, *b in right:
                if g in left:
                    rows, *a = left[g]
                    (x, a_there), (y, b_there) = dense(len(rows), *a), dense(len(cols), *b)
                    score[np.ix_(rows, cols)] += x @ y.T
                    shared[np.ix_(rows, cols)] += a_there @ b_there.T
            score[(shared == 0) | (users[begin : begin + n][:, None] == ids)] = -np.inf
            low = at_least(score, k)
            for r in range(n):
                at = np.flatnonzero((score[r] >= low[r]) & (score[r] > -np.inf))
                at = at[among_best(score[r, at], ids[at], k)]
                out.append(pd.DataFrame({"user_id": users[begin + r], "other_id": ids[at], "score": score[r, at]}))
        return pd.concat(out) if out else pd.DataFrame({"user_id": users[:0], "other_id": ids[:0], "score": np.zeros(0)})

    return meet
