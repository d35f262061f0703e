"""The vector index against exact search."""

import numpy as np
import pytest

from lumenfare.operators import vector_index as V

SCHEMA = "vec_id long, embedding array<float>, list int, x string, part int"


def exact(ids, x, k, every=50):
    x = V._unit(np.array(x, float))
    out = {}
    for i in np.flatnonzero(np.array(ids) % every == 0):
        s = np.round(x @ x[i], 6)
        out.setdefault(ids[i], sorted([(-a, j) for a, j in zip(s.tolist(), ids) if j != ids[i]])[:k])
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_tables(spark, sf):
    v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    centroids, probes = V.fit(v)
    index = V.build(v, centroids)
    assert index.count() == v.count() and index.select("list").distinct().count() > 1
    got = V.search(index, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), centroids, 5, probes).collect()
    rows = v.orderBy("vec_id").collect()
    want = exact([r.vec_id for r in rows], [r.embedding for r in rows], 5)
    assert sum((-r.score, r.vec_id) in want[r.query_id] for r in got) >= 0.9 * 5 * len(want) and len(got) == 5 * len(want)


@pytest.fixture(scope="module")
def clustered(spark):
    """Forty tight clusters, a third of all rows one vector, a zero vector, nulls, a repeated row."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 8))
    rows = [(i, (middle[i % 40] + 0.05 * rng.normal(size=8)).tolist(), 1, "x", 2) for i in range(800)]
    rows += [(1000 + i, middle[0].tolist(), 1, "x", 2) for i in range(400)] + [rows[7], (50 * 99, [0.0] * 8, 1, None, None)]
    return rows, spark.createDataFrame([*rows, (9999, None, 1, "x", 2)], SCHEMA)


def test_search_equals_exact_where_all_lists_are_read(spark, monkeypatch, clustered):
    rows, df = clustered
    monkeypatch.setattr(V, "PART", 37)
    monkeypatch.setattr(V, "QUERIES", 3)
    centroids, probes = V.fit(df)
    index = V.build(df, centroids)
    assert index.count() == len(rows) and 0 < probes < len(centroids)
    asked = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    ids, want = [r[0] for r in rows], None
    want = exact(ids, np.array([r[1] for r in rows], np.float32), 5)
    for n, least in ((len(centroids), 1.0), (probes, 0.9)):
        got = {}
        for r in V.search(index, asked, centroids, 5, n).collect():
            got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
        hits = [sum(a == b for (_, *a), b in zip(sorted(got.get(q, [])), map(list, w))) / 5 for q, w in want.items() if q != 4950]
        # of many equal vectors the same ones come first, whatever the parts
        assert np.mean(hits) >= least


def test_index_of_few(spark, clustered):
    none = clustered[1].limit(0)
    centroids, probes = V.fit(none)
    assert len(centroids) == 0 and V.build(none, centroids).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, "x", 2), (1, [1.0, 1.0], 1, "x", 2)], SCHEMA)
    centroids, probes = V.fit(two)
    got = V.search(V.build(two, centroids), two.withColumnRenamed("vec_id", "query_id"), centroids, 5, probes).collect()
    assert sorted((r.query_id, r.vec_id, r.score, r.rank) for r in got) == [(0, 1, 0.707107, 1), (1, 0, 0.707107, 1)]
