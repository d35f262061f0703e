"""Operators without SQL, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfare.operators import recommend as R
from lumenfare.operators import training as T


def test_numbered_equals_rank(spark):
    ids = [int(x) for x in np.random.default_rng(1).choice(10**6, 500, False)]
    got = {r.event_id: r.slot for r in T.numbered(spark.createDataFrame([(i,) for i in ids], "event_id long"), "event_id", 1000).collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("scores", [[0.1, 0.4, 0.35, 0.8, 0.8], [0.5] * 5, [float(x) for x in np.random.default_rng(2).normal(size=400).round(2)]])
def test_auc_equals_pairs(spark, scores):
    labels = [int(x) for x in np.random.default_rng(3).integers(0, 2, len(scores))]
    labels[0], labels[1] = 0, 1
    r = T.auc(spark.createDataFrame(list(zip(scores, labels)), "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in zip(scores, labels) if y], [s for s, y in zip(scores, labels) if not y]
    assert abs(r.roc_auc - np.mean([(p > q) + (p == q) / 2 for p in pos for q in neg])) < 1e-9
    assert abs(r.pr_auc - np.mean([sum(x >= p for x in pos) / sum(x >= p for x in scores) for p in pos])) < 1e-9


def test_early_stop():
    s = T.EarlyStop(patience=2)
    assert [s.step(x, i) for i, x in enumerate((3.0, 2.0, 2.5, 1.5, 1.6, 1.7))] == [False] * 5 + [True] and s.best == 1.5 and s.state == 3


def test_ranker_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.5, -1.0] + rng.normal(size=300) > 0.3).astype(float)
    part = np.where(np.arange(300) % 5, "train", "test")
    rows = spark.createDataFrame([(float(a), float(b), int(c), str(p)) for (a, b), c, p in zip(x, y, part)], "a double, b double, y int, part string")
    w, loss = T.train_ranker(rows, ["a", "b"], "y", "part", steps=25)
    ones, v, stop = np.column_stack([x, np.ones(300)]), np.zeros(3), T.EarlyStop(5)
    for _ in range(25):
        p = 1 / (1 + np.exp(-ones @ v))
        q, z = p[part == "test"], y[part == "test"]
        if stop.step(-np.mean(z * np.log(q) + (1 - z) * np.log(1 - q)), v):
            break
        v = v - 2.0 * (ones[part == "train"].T @ (p - y)[part == "train"]) / (part == "train").sum()
    assert np.allclose(w, stop.state, atol=1e-9) and abs(loss - stop.best) < 1e-9


def test_factors_and_neighbours(spark):
    from pyspark.ml.recommendation import ALS

    i = spark.createDataFrame([(u, e, float((u * e) % 5 + 1)) for u in range(12) for e in range(9) if (u + e) % 3], "user_id int, event_id int, w double")
    model = ALS(rank=4, maxIter=3, implicitPrefs=True, userCol="user_id", itemCol="event_id", ratingCol="w", seed=1).fit(i)
    f = {r.id: np.array(r.features) for r in model.userFactors.collect()}
    assert {r.id for r in R.factors(model, "user", spark.createDataFrame([(3,), (99,)], "id int")).collect()} == {3}
    assert R.factors(model, "item", spark.createDataFrame([(1,), (2,)], "id int")).count() == 2
    got = R.nearest_users(model, spark.createDataFrame([(3,)], "id int"), 4).orderBy("rank").collect()
    want = sorted(((round(float(f[3] @ v / np.linalg.norm(f[3]) / np.linalg.norm(v)), 6), -u) for u, v in f.items() if u != 3), reverse=True)[:4]
    assert [r.vec_id for r in got] == [-u for _, u in want] and np.allclose([r.score for r in got], [s for s, _ in want], atol=2e-6)


def test_rate_limiter_equals_plain_log(spark):
    """At most two accepted in sixty seconds a user, rejected ones not counted."""
    from datetime import datetime, timedelta

    from lumenfare.streaming import metrics as M

    rng = np.random.default_rng(6)
    start = datetime(2024, 1, 1)
    rows = [(int(i), int(rng.integers(0, 3)), start + timedelta(seconds=int(rng.integers(0, 600)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, user_id long, ts timestamp_ntz")
    got = {r.id: r for r in M.limit_rate(df, 2, 60).collect()}
    column = next(c for c in M.limit_rate(df, 2, 60).columns if c not in ("id", "user_id", "ts"))
    for u in range(3):
        taken = []
        for i, _, t in sorted((r for r in rows if r[1] == u), key=lambda r: (r[2], r[0])):
            taken = [x for x in taken if (t - x).total_seconds() < 60]
            ok = len(taken) < 2
            if ok:
                taken.append(t)
            assert bool(got[i][column]) == ok
