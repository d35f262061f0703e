"""Buffered batches of a stream against a plain loop, over several triggers."""

from datetime import datetime, timedelta

from lumenfare.streaming import buffers as B
from lumenfare.streaming import metrics as M

SCHEMA = "event_id long, user_id long, ts timestamp, ids string"
DAY = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, *args, **kw):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = M.stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1)
    r = M.appended(B.buffered(s, "user_id", *args, **kw), str(tmp_path / "out")).collect()
    return sorted(((x.user_id, x.opened.replace(tzinfo=None), list(x.ids), x.n, x.dropped, x.reason) for x in r), key=str)


def row(i, user, hours):
    return (i, user, None if hours is None else DAY + timedelta(hours=hours), "kept out")


def test_number_age_and_timers(spark, tmp_path):
    batches = [
        [row(1, 1, 0), row(2, 1, 1), row(3, 1, 2), row(4, 1, 3), row(5, 2, 0)],  # user 1: three by number, one is left
        [row(6, 1, 8), row(7, 3, 9)],  # too late for user 1's buffer, which is let go of first
        [row(8, 3, 30)],  # the watermark passes the others' times
        [row(9, 4, 31), row(None, 3, 31), row(10, 4, None)],
        [row(11, 2, 60), row(12, None, 60), row(13, None, 60)],
    ]
    at = lambda h: DAY + timedelta(hours=h)
    got = run(spark, tmp_path, batches, 3, 4 * 3600)
    want = [(1, at(0), [1, 2, 3], 3, 0, "count"), (1, at(3), [4], 1, 0, "time"), (2, at(0), [5], 1, 0, "time"), (1, at(8), [6], 1, 0, "time"), (3, at(9), [7], 1, 0, "time"), (3, at(30), [8], 1, 0, "close"), (4, at(31), [9], 1, 0, "time")]
    assert got == sorted(want, key=str)


def test_full_buffers_drop_the_oldest_and_count_them(spark, tmp_path):
    batches = [[row(k, 1, k / 100) for k in range(4)], [row(k, 1, k / 100) for k in range(4, 9)], [row(None, 1, 1)]]
    got = run(spark, tmp_path, batches, 7, 3600 * 24, 3)
    assert got == [(1, DAY, [4, 5, 6], 3, 4, "count"), (1, DAY + timedelta(hours=0.07), [7, 8], 2, 0, "close")]


def test_without_events(spark, tmp_path):
    assert run(spark, tmp_path, [[row(None, 1, 1)], [row(1, 1, None)]], 3, 60) == []
