"""Recommendation without SQL against its rule."""

from lumenfare import registry


def test_als_topk_of_a_user_who_has_seen_most_items(spark, tmp_path):
    """Every user gets five unseen items, or as many as are left."""
    seen = {1: set(range(75)), 2: set(range(70, 80)), 3: set(range(0, 80, 9)), 4: set(range(78)), 5: {3}}
    rows = [(u, i) for u, items in seen.items() for i in sorted(items)]
    rows = [(n, u, "purchase", f'{{"k": {i}}}') for n, (u, i) in enumerate(rows)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    e.selectExpr("*", "1.0D as value", "timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    r = [x.asDict() for x in registry.queries()["als_topk"](spark, str(tmp_path)).collect()]
    for u, items in seen.items():
        mine = sorted((x for x in r if x["user_id"] == u), key=lambda x: x["rank"])
        assert [x["rank"] for x in mine] == list(range(1, min(5, 80 - len(items)) + 1))
        assert not items & {x["event_id"] for x in mine}
        assert [x["score"] for x in mine] == sorted((x["score"] for x in mine), reverse=True)
