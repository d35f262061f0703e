"""Exact negatives, windows by doubled jumps and the pairwise factor model against plain versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfare.operators import network as N
from lumenfare.operators import pairwise as P
from lumenfare.operators import recommend as R
from lumenfare.operators import sequence
from lumenfare.operators import training as T


def test_counted_in_blocks_equals_counting(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(-50, 50), i, rng.random() < 0.5) for i in range(300)]
    got = sequence.counted(spark.createDataFrame(rows, "g string, x long, id long, f boolean"), "g", "x", "n", F.col("f"), ["id"], 7).collect()
    assert len(got) == 300 and all(r.n == sum(f for g, x, i, f in rows if g == r.g and (x, i) <= (r.x, r.id)) for r in got)


def test_chained_reaches_what_single_jumps_reach(spark):
    jumps = [(g, n, n + 1 + (n * g) % 5) for g in (1, 2, 3) for n in range(1, 200)]
    got = {tuple(r) for r in sequence.chained(spark.createDataFrame(jumps, "group long, node long, to long"), spark.createDataFrame([(1, 1), (2, 1), (3, 4), (9, 7)], "group long, node long")).collect()}
    step, want = {(g, n): to for g, n, to in jumps}, set()
    for g, n in ((1, 1), (2, 1), (3, 4), (9, 7)):
        while n is not None:
            want.add((g, n))
            n = step.get((g, n))
    assert got == want


def test_chained_windows_equal_the_walk(spark):
    rng, t0 = random.Random(6), datetime(2024, 1, 1)
    gaps = [timedelta(hours=h) for h in (0, 1, 12, 23, 24, 25, 48)]
    rows, n = [], 0
    for user in (1, 2, 3, 4):
        t = t0
        for _ in range((1, 2, 60, 400)[user - 1]):
            n, t = n + 1, t + rng.choice(gaps)
            rows.append((n, user, t, "x", 1, 2))
    schema = "id long, user_id long, ts timestamp_ntz, win_no string, node int, us int"
    df = spark.createDataFrame(rows, schema)
    want = {r.id: r.win for r in R.anchored_windows(df.select("id", "user_id", "ts"), "user_id", "ts").collect()}
    odd = df.unionByName(spark.createDataFrame([(None, 1, t0, "x", 1, 2), (9001, None, t0, None, 1, 2), (9002, 1, None, "x", None, None)], schema))
    got = R.chained_windows(odd, "user_id", "ts")
    assert got.columns == [*df.columns, "win"] and got.count() == len(rows) + 3
    assert {r.id: r.win for r in got.collect() if r.id and r.id < 9000} == want
    assert R.chained_windows(df.limit(0), "user_id", "ts").count() == 0


def test_exact_negatives_are_as_many_as_there_are(spark):
    """A user who has seen all, one who has seen all but three, a hot one, repeated rows, unknown items, nulls."""
    items = spark.createDataFrame([(i * 7 - 100,) for i in range(40)] + [(None,), (5,), (5,)], "event_id long")
    known = [i * 7 - 100 for i in range(40)] + [5]
    pos = [(1, i) for i in known] + [(2, i) for i in known[3:]] + [(3, i) for i in known[::2]] + [(4, known[0]), (4, known[0]), (5, 10**9), (None, 5), (6, None)]
    got = T.exact_negatives(spark.createDataFrame(pos, "user_id long, event_id long"), items).collect()
    have = {u: {i for v, i in pos if v == u} for u, _ in pos}
    by = {}
    for r in got:
        assert r.event_id in known and r.event_id not in have[r.user_id]
        by.setdefault((r.user_id, r.anchor), []).append(r.event_id)
    assert all(len(set(x)) == len(x) for x in by.values())
    want = {(u, i): min(5, len(set(known) - have[u])) for u, i in pos if u is not None and i is not None and u != 1}
    assert {k: len(x) for k, x in by.items()} == want
    assert len({x for (u, _), v in by.items() if u == 3 for x in v}) > 15


def tastes(spark):
    """Users like the items of their own group, but for a few."""
    rng = np.random.default_rng(2)
    pairs = {(int(u), int(100 + i)) for u in range(60) for i in range(40) if rng.random() < (0.5 if u % 4 == i % 4 else 0.03)}
    return sorted(pairs), spark.createDataFrame(sorted(pairs), "user_id long, event_id long")


def plain_training(spark, pairs, epochs, blocks, rate, decay, dim, seed):
    """The same descent, triplet by triplet; blocks and orders are looked up, all else is loops over lists."""
    df = spark.createDataFrame(pairs, "user_id long, event_id long")
    vec = {(r.kind, r.id): list(r.vec) for r in P.started(df, dim, seed).collect()}
    for epoch in range(1, epochs + 1):
        cols = [F.pmod(F.xxhash64("user_id"), F.lit(blocks)).alias("ub"), F.pmod(F.xxhash64(F.lit(epoch), "event_id"), F.lit(blocks)).alias("ib"), F.xxhash64(F.lit(epoch), "user_id").alias("order")]
        rows, all_items = df.select("user_id", "event_id", *cols).collect(), {}
        for r in rows:
            all_items.setdefault(r.ib, set()).add(r.event_id)
        for s in range(blocks):
            for b in range(blocks):
                here = sorted((r.order, r.user_id, r.event_id) for r in rows if r.ub == b and r.ib == (b + s) % blocks)
                items, batch = sorted(all_items.get((b + s) % blocks, ())), []
                groups = [[i for _, v, i in here if v == u] for u in dict.fromkeys(v for _, v, _ in here)]
                users = list(dict.fromkeys(v for _, v, _ in here))
                pending = list(zip(users, groups))
                while pending:
                    batch = []
                    while pending and sum(len(g) for _, g in batch) < P.BATCH:
                        batch.append(pending.pop(0))
                    moves = {}
                    for u, own in batch:
                        rest = [i for i in items if i not in own]
                        take = min(P.RATIO, len(rest))
                        for i in own:
                            for k in range(take):
                                place = items.index(i)
                                start = (place * 7919 + (epoch * blocks + s) * 104729 + sorted(x for x in {r.user_id for r in rows if r.ub == b}).index(u) * 31) % len(rest)
                                n = rest[(start + k * (len(rest) // take)) % len(rest)]
                                a, p, q = vec[0, u], vec[1, i], vec[1, n]
                                gap = sum(a[x] * (p[x] - q[x]) for x in range(dim)) + p[dim] - q[dim]
                                c = 1 / (1 + np.exp(gap))
                                for key, g in (((0, u), [c * (p[x] - q[x]) - decay * a[x] for x in range(dim)] + [0.0]), ((1, i), [c * a[x] - decay * p[x] for x in range(dim)] + [c - decay * p[dim]]), ((1, n), [-c * a[x] - decay * q[x] for x in range(dim)] + [-c - decay * q[dim]])):
                                    old = moves.setdefault(key, [0.0] * (dim + 1))
                                    for x, y in enumerate(g):
                                        old[x] += y
                    for key, g in moves.items():
                        v = vec[key]
                        v[-1] += sum(y * y for y in g) / len(g)
                        for x, y in enumerate(g):
                            v[x] += rate * y / (v[-1] + 1e-8) ** 0.5
    return vec


def test_training_equals_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH", 7)
    pairs, df = tastes(spark)
    odd = df.unionByName(df.limit(5)).unionByName(spark.createDataFrame([(None, 1), (1, None)], df.schema))
    got = {(r.kind, r.id): r.vec for r in P.train(odd, dim=3, epochs=2, blocks=2, rate=0.2, decay=0.01, seed=4).collect()}
    want = plain_training(spark, pairs, 2, 2, 0.2, 0.01, 3, 4)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_held_out_loss_falls_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH", 64)
    pairs, df = tastes(spark)
    known, triplets = P.held_out(df)
    losses, last = [], []
    factors = P.train(known, dim=8, epochs=4, blocks=2, each=lambda e, f: losses.append(P.loss(f, triplets).first()) or last.append(f))
    assert losses[0].loss > 0.65 and losses[-1].loss < losses[0].loss - 0.1 and losses[-1].right > 0.7 and losses[0].n == losses[-1].n > 20
    assert {(r.user_id, r.anchor) for r in triplets.collect()} | {tuple(r) for r in known.collect()} == set(pairs)
    asked = spark.createDataFrame([(0,), (4,), (7,), (7,), (999,)], "user_id long")
    got = P.recommend(factors, asked, df, 3, spark.createDataFrame([(i,) for i in range(100, 135)], "event_id long"))
    vec = {(r.kind, r.id): np.array(r.vec) for r in factors.collect()}
    for u in (0, 4, 7):
        open_ = [i for i in range(100, 135) if (u, i) not in pairs and (1, i) in vec]
        value = {i: vec[0, u][:8] @ vec[1, i][:8] + vec[0, u][8] + vec[1, i][8] for i in open_}
        mine = [r.event_id for r in sorted(got.where(F.col("user_id") == u).collect(), key=lambda r: r.rank)]
        assert mine == sorted(open_, key=lambda i: (-value[i], i))[:3]
    assert got.where("user_id = 999").count() == 0
    assert P.train(df.limit(0), dim=2, epochs=1, blocks=2).count() == 0


@pytest.mark.parametrize("seen", [[0, 2, 3], [], [0, 1, 2, 3, 4]])
def test_ranks_among_the_others(seen):
    users, items = np.zeros(len(seen), np.int64), np.array(seen, np.int64)
    at, neg = P._negatives(users, items, 5, 5, 1)
    assert sorted(set(neg.tolist())) == ([] if not seen else sorted(set(range(5)) - set(seen))) and len(at) == len(seen) * (5 - len(seen))


# ---------------------------------------------------------------- ranking network

def examples(spark, n=400):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] + x[:, 2]) > 0).astype(int)
    part = np.where(np.arange(n) % 5, "train", "test")
    rows = [(*map(float, a), int(b), str(c)) for a, b, c in zip(x, y, part)]
    return x, y.astype(float), part, spark.createDataFrame(rows, "a double, b double, c double, y int, part string")


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    sizes, x, y = [3, 5, 4, 1], rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    w = N.begun(sizes, 3)
    g, loss = N.gradient(sizes, w, x, y)
    total = lambda v: N.losses(N.forward(sizes, v, x)[-1][:, 0], y).sum()
    step = np.eye(len(w)) * 1e-6
    assert abs(loss - total(w)) < 1e-9 and np.allclose(g, [(total(w + s) - total(w - s)) / 2e-6 for s in step], atol=1e-5)


def test_ten_steps_equal_plain_steps(spark):
    x, y, part, df = examples(spark)
    odd = df.unionByName(spark.createDataFrame([(None, 1.0, 2.0, 1, "train"), (1.0, 1.0, 1.0, None, "train"), (0.0, None, 1.0, 0, None)], df.schema))
    sizes = [3, 8, 4, 1]
    got, history = N.train(odd, ["a", "b", "c"], "y", "part", hidden=(8, 4), epochs=10, batches=1, rate=0.01, decay=0.1, seed=5)
    tx, ty = np.vstack([x[part == "train"], [0, 1, 2]]), np.append(y[part == "train"], 1)
    hx, hy = np.vstack([x[part == "test"], [0, 0, 1]]), np.append(y[part == "test"], 0)
    w, m, v, seen = N.begun(sizes, 5), 0.0, 0.0, []
    for t in range(1, 11):
        seen.append((np.mean(N.losses(N.forward(sizes, w, hx)[-1][:, 0], hy)), w))
        each = [np.array([N.gradient(sizes, w, tx[i : i + 1], ty[i : i + 1])[0]]) for i in range(len(tx))]
        g = np.concatenate(each).mean(axis=0) + 0.1 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.01 * (m / (1 - 0.9**t)) / ((v / (1 - 0.999**t)) ** 0.5 + 1e-8)
    assert np.allclose([h["held_loss"] for h in history], [s[0] for s in seen], atol=1e-9)
    kept = seen[0]
    for s in seen[1:]:
        kept = s if s[0] < kept[0] - 1e-3 else kept
    assert np.allclose(got, kept[1], atol=1e-9)


def test_network_learns_what_no_line_can_and_stops(spark):
    x, y, part, df = examples(spark)
    w, history = N.train(df, ["a", "b", "c"], "y", "part", hidden=(16, 8), epochs=20, batches=2, rate=0.03, patience=4, seed=2)
    p = [r.score for r in N.scored(df, ["a", "b", "c"], [3, 16, 8, 1], w).where("part = 'test'").collect()]
    assert np.mean((np.array(p) > 0.5) == y[part == "test"]) > 0.85 and history[-1]["held_loss"] < history[0]["held_loss"]
    assert np.allclose(p, N.forward([3, 16, 8, 1], w, x[part == "test"])[-1][:, 0])
    noise = df.withColumn("y", F.pmod(F.xxhash64("a"), F.lit(2)).cast("int"))
    assert len(N.train(noise, ["a", "b", "c"], "y", "part", hidden=(4,), epochs=9, batches=1, rate=0.3, patience=2)[1]) < 9
    none, history = N.train(df.limit(0), ["a", "b", "c"], "y", "part", hidden=(4,), epochs=2, batches=1)
    assert history == [] and np.allclose(none, N.begun([3, 4, 1]))
