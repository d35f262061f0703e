"""Streaming metrics over several batches: late rows, repeated batches, distinct users."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenfare.streaming import metrics as M

SCHEMA = "id long, user_id long, event_type string, ts timestamp"


def laid(spark, tmp_path, batches):
    """One file a batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    folder = tmp_path / "events"
    folder.mkdir()
    for k in range(len(batches)):
        (file,) = [p for p in (tmp_path / f"in{k}").iterdir() if p.suffix == ".parquet"]
        file.rename(folder / f"{k:03d}.parquet")
        import os

        os.utime(folder / f"{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return M.stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, 1)


def test_late_rows_are_dropped_and_others_counted(spark, tmp_path):
    day = datetime(2024, 1, 1)
    row = lambda i, days, kind="a": (i, i % 3, kind, day + timedelta(days=days, hours=3))
    batches = [[row(1, 0), row(2, 0)], [row(3, 0.5), row(4, 5)], [row(5, 5), row(7, 9)], [row(8, 9), row(9, 8.5), row(6, 0)]]
    s = laid(spark, tmp_path, batches)
    r = M.flushed(M.daily_counts(s), ["day", "event_type"], str(tmp_path / "out"))
    got = {x.day.replace(tzinfo=None): x.n for x in r.collect()}
    assert got == {day: 3, day + timedelta(days=5): 2, day + timedelta(days=8): 1, day + timedelta(days=9): 2}  # row 6 is too late
    assert len(list((tmp_path / "out" / "changes").iterdir())) >= 4


def test_running_users_over_batches(spark, tmp_path):
    at = datetime(2024, 1, 1)
    batches = [[(i, (i * k) % 5, "ab"[i % 2], at) for i in range(10)] for k in range(1, 4)]
    s = laid(spark, tmp_path, batches)
    r = M.flushed(M.running_users(s), ["event_type", "user_id"], str(tmp_path / "out")).groupBy("event_type").agg(F.count("*").alias("users"), F.sum("n").alias("n"))
    rows = [x for b in batches for x in b]
    assert {x.event_type: (x.users, x.n) for x in r.collect()} == {k: (len({u for _, u, e, _ in rows if e == k}), sum(e == k for _, _, e, _ in rows)) for k in "ab"}
