"""Search over settings against a loop over trials; sketches of days against exact counts."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfare.operators import network as N
from lumenfare.operators import search as H
from lumenfare.streaming import sketches as K


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(rng.random(), None if k % 40 == 0 else rng.random(), "train" if k % 5 else "test") for k in range(600)]
    return spark.createDataFrame([(a, b, int(a > (b or 0)), p) for a, b, p in made], "a double, b double, label int, part string")


def alone(data, trial, epochs, batches):
    """One trial by itself: its weights and its loss on the held rows."""
    sizes = [2, *trial["hidden"], 1]
    w = N.begun(sizes)
    adam = N.Adam(len(w), trial["rate"], trial["decay"])
    part = lambda k: tuple(np.array(v, float) for v in zip(*[(x, y) for x, y, b in data if b == k]))
    for _ in range(epochs):
        for k in range(batches):
            x, y = part(k)
            w = adam.step(w, N.gradient(sizes, w, x, y)[0] / len(y))
    x, y = part(N.HELD)
    return w, N.losses(N.forward(sizes, w, x)[-1][:, 0], y).mean()


def test_halving_equals_a_loop_over_trials(spark, rows):
    trials = [{"hidden": (4 + k, 3), "rate": 10 ** (-3 + k / 3), "decay": 1e-5} for k in range(5)]
    found, w = H.halved(rows, ["a", "b"], "label", "part", trials, epochs=1, batches=2)
    data = [tuple(r) for r in N.dealt(rows, ["a", "b"], "label", "part", 2).select("x", "y", "bucket").collect()]
    left, epochs, step, out = list(range(5)), 0, 1, []
    while left:
        epochs += step
        loss = {k: alone(data, trials[k], epochs, 2)[1] for k in left}
        left.sort(key=lambda k: loss[k])
        n = len(left) // 2
        out, left, step = [(k, epochs, pytest.approx(loss[k], abs=1e-9)) for k in left[n:]] + out, left[:n], step * 2
    assert [(t["trial"], t["epochs"], t["loss"]) for t in found] == out
    assert found[0]["epochs"] == max(t["epochs"] for t in found)
    assert w == pytest.approx(alone(data, trials[found[0]["trial"]], found[0]["epochs"], 2)[0], abs=1e-9)


def test_search_without_rows_or_trials(spark, rows):
    one = H.drawn(1)
    assert H.halved(rows.limit(0), ["a", "b"], "label", "part", one, 1, 1)[0][0]["loss"] is None
    known = H.halved(rows.where("part = 'train'"), ["a", "b"], "label", "part", one, 1, 1)[0][0]
    assert known["loss"] > 0
    assert H.halved(rows, ["a", "b"], "label", "part", [], 1, 1) == ([], None)
    assert H.drawn(3) == H.drawn(3) and all(32 <= t["hidden"][0] <= 128 and 1e-4 <= t["rate"] <= 1e-2 for t in H.drawn(50))


def test_trailing_users_are_within_two_percent(spark):
    e = spark.range(600000).select(((F.col("id") * 7919) % 150000).alias("user_id"), (F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval((F.xxhash64("id") % 10 + 10).cast("int"))).alias("ts"))
    exact = {}
    for day, users in e.groupBy(F.to_date("ts")).agg(F.collect_set("user_id")).collect():
        for k in range(3):
            exact.setdefault(day + timedelta(days=k), set()).update(users)
    got = {r.day.date(): r.users for r in K.trailing(K.daily_sketches(e), 3).collect()}
    assert set(got) == {d for d in exact if d <= max(got)} and len(got) >= 19
    for day, n in got.items():
        assert n == pytest.approx(len(exact[day]), rel=0.02)


def test_odd_days(spark):
    rows = [(None, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 2)), (2, datetime(2024, 1, 9)), (3, None)]
    e = spark.createDataFrame(rows, "user_id long, ts timestamp")
    got = sorted((r.day.day, r.n, r.users) for r in K.trailing(K.daily_sketches(e), 3).collect())
    assert got == [(1, 2, 1), (2, 3, 1), (3, 3, 1), (4, 1, 1), (9, 1, 1)]
    assert K.trailing(K.daily_sketches(e.limit(0)), 3).count() == 0
