"""Scores of many pairs, made in blocks, against plain loops."""

import math
import random

import pytest

from lumenfare.operators import blocks
from lumenfare.operators import collaborative as L
from lumenfare.operators import recommend as R


def test_shared_keys_broadcast_or_dealt(spark):
    scores = [(u, [g, "x"][: 1 + u % 2], u + k / 10) for u in range(40) for k, g in enumerate("abc")]
    events = [(i, ["abcd"[i % 4], "x"][: 1 + i // 4 % 2]) for i in range(50)]
    want = sorted((u, e, s) for u, g, s in scores for e, h in events if g == h)
    s, e = spark.createDataFrame(scores, "user_id long, genres array<string>, score double"), spark.createDataFrame(events, "event_id long, genres array<string>")
    for most, users in ((1000, 2000), (1000, 7), (30, 7)):
        assert sorted(map(tuple, L.by_shared(s, e, "genres", most, 3, users).collect())) == want
    assert L.by_shared(s.limit(0), e, "genres").count() == 0


def test_first_model_of_each_user_by_stated_users(spark):
    m = [spark.createDataFrame(r, "user_id long, event_id long, score double") for r in ([(1, 7, 0.5), (1, 8, 0.1)], [(1, 9, 1.0), (2, 9, 1.0)], [(2, 1, 2.0), (3, 1, 2.0)])]
    want = [(1, 7, 0.5, 1), (1, 8, 0.1, 1), (2, 9, 1.0, 2), (3, 1, 2.0, 3)]
    assert sorted(map(tuple, L.cascade(m).collect())) == want
    assert sorted(map(tuple, L.cascade(m, [x.select("user_id") for x in m]).collect())) == want


def test_cascade_sums_no_pairs(spark):
    from lumenfare import registry

    plan = registry.queries()["model_cascade"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    events = [line for line in plan.split("\n") if "Aggregate" in line and "event_id" in line]
    assert not events


def best(scores, k):
    """(row, other, score) of each row's k best by rounded score, ties by id; scores: by (row, other)."""
    rows = {}
    for (a, b), s in scores.items():
        rows.setdefault(a, []).append((-round(s, 6), b))
    return sorted((a, b, -s) for a, x in rows.items() for s, b in sorted(x)[:k])


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_nearest_of_odd_vectors(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "PAIRS", size)
    rng = random.Random(4)
    v = {i: [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)] for i in range(70)} | {100 + i: [1.0, 1.0, 1.0] for i in range(30)}
    v |= {200: None, 201: [1.0, None, 2.0], 202: [], 203: [0.0] * 3, 204: [1.0, 2.0], 205: [3.0, 1.0], 206: [1e-170] * 3, 207: [-1e-170, 0.0, 0.0], 210: [2.0, 4.0], 215: None}

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a + b:
            return 0.0
        dot = lambda x, y: sum(i * j for i, j in zip(x, y))
        n = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return dot(a, b) / n if n > 0 else 0.0

    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    want = best({(a, b): cosine(v[a], v[b]) for a in v if a % 5 == 0 for b in v if a != b}, 4)
    for most, parts in ((100, None), (7, 3)):
        got = sorted((r.query_id, r.vec_id, r.score) for r in R.nearest(df, df.where("vec_id % 5 = 0"), 4, most, parts).collect())
        assert got == want
    few = df.where("vec_id in (0, 1, 5)")
    assert R.nearest(few, few.where("vec_id = 0"), 4).count() == 2 and R.nearest(few, few.where("vec_id = 9"), 4).count() == 0


@pytest.mark.parametrize("size,columns", [(4_000_000, 128), (60, 4)])
def test_users_alike(spark, monkeypatch, size, columns):
    monkeypatch.setattr(blocks, "PAIRS", size)
    monkeypatch.setattr(blocks, "COLUMNS", columns)
    rng = random.Random(6)
    w = {u: {rng.randrange(30) ** 2: rng.choice([-0.5, 1.0, 2.0]) for _ in range(rng.randrange(1, 6))} for u in range(80)}
    w |= {90: {10_000: 1.0}, 91: {10_000: 0.0}, 92: {0: -1.0, 1: -1.0}}
    unit = {u: {e: x / math.sqrt(sum(y * y for y in m.values())) for e, x in m.items()} for u, m in w.items() if any(m.values())}
    want = best({(a, b): sum(x * unit[b][e] for e, x in unit[a].items() if e in unit[b]) for a in unit if a % 10 == 0 or a == 92 for b in unit if a != b and unit[a].keys() & unit[b].keys()}, 5)
    df = spark.createDataFrame([(u, e, x) for u, m in w.items() for e, x in m.items()], "user_id long, event_id long, w double")
    for most in (1_000_000, 9):
        got = L.similar_users(df, df.where("user_id % 10 = 0 or user_id = 92"), 5, most)
        assert sorted((r.user_id, r.other_id, r.score) for r in got.collect()) == want
    assert not any(u == 90 for u, _, _ in want)
