"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from lumenfare import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def norm(v):
    return "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    r = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(tuple(norm(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(norm(row[c]) for c in cols) for row in df.collect()) == want
