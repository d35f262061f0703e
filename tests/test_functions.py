import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfare.functions import dates, geo, text
from lumenfare.functions import scores as S
from lumenfare.operators import recommend, training
from lumenfare.sources import listings
from lumenfare.streaming import metrics


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text_dates(spark):
    now = F.lit("2025-09-20 12:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("den 17. sep 2025",), ("17. sep",), ("2025-10-02 doors",), ("tonight!",), ("nothing",)], "t string")
    got = [r[0] for r in df.select(dates.text_date(F.col("t"), now)).collect()]
    d = lambda y, m, day: dt.datetime(y, m, day, 20)
    assert got == [d(2025, 9, 17), d(2026, 9, 17), d(2025, 10, 2), d(2025, 9, 20), None]


def test_next_weekday_is_never_today(spark):
    now = F.lit("2024-01-15 10:00:00").cast("timestamp_ntz")
    assert one(spark, dates.next_weekday(now, 0), dates.next_weekday(now, 4))[:] == (dt.date(2024, 1, 22), dt.date(2024, 1, 19))


def test_names_and_cleaning(spark):
    r = one(spark, text.venue_name(F.lit(" the rust copenhagen")), text.unescaped(F.lit("a &amp; ﬁ")), text.clean(F.lit("See #Jazz at https://x.y @you!!! now")))
    assert r[:] == ("Rust", "a & fi", "see jazz at now")


def test_classifier_ties_and_default(spark):
    t, c = text.classify(F.lit("A techno night with a DJ in the club"))
    d, e = text.classify(F.lit("nothing here"))
    assert one(spark, t, c, d, e)[:] == ("nightlife", 0.4, "music", 0.3)  # club, dj, techno and night


def test_distances_agree(spark):
    p = [F.lit(x) for x in (55.6761, 12.5683, 55.70, 12.60)]
    a, b = one(spark, geo.cosine_law_km(*p), geo.haversine_km(*p))
    assert abs(a - b) < 1e-6 and 3 < a < 4


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd")))
def test_jaccard_is_symmetric(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    x, y = df.select(S.jaccard(F.col("a"), F.col("b")), S.jaccard(F.col("b"), F.col("a"))).first()
    assert x == y and 0 <= x <= 1


def test_perfect_ranking(spark):
    df = spark.createDataFrame([(1, 0.8), (0, 0.2), (1, 0.7), (0, 0.3), (1, 0.9)], "y int, p double")
    assert training.auc(df, "p", "y").first()[:] == (1.0, 1.0)


def test_nearest_in_blocks_equals_broadcast(spark):
    rows = [(i, [float((i * 37 + j * j) % 11 - 5) for j in range(6)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 5 = 0")
    got = [sorted(map(tuple, recommend.nearest(v, q, 3, most, 4).collect())) for most in (100, 5)]
    assert got[0] == got[1] and len(got[0]) == 36


def test_window_opens_after_a_day(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, 1, t0 + dt.timedelta(hours=h)) for i, h in enumerate([0, 24, 25, 49, 50])], "id long, user_id long, ts timestamp_ntz")
    got = {r.id: (r.win - t0).total_seconds() / 3600 for r in recommend.anchored_windows(df, "user_id", "ts").collect()}
    assert got == {0: 0, 1: 0, 2: 25, 3: 25, 4: 50}


def test_limiter_forgets_after_the_span(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, 1, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 60, 61])], "id long, user_id long, ts timestamp_ntz")
    got = [r.allowed for r in metrics.limit_rate(df, 2, 60).orderBy("id").collect()]
    assert got == [True, True, False, True, True]


def test_limiter_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, i % 2, t0 + dt.timedelta(seconds=7 * i)) for i in range(40)], "id long, user_id long, ts timestamp")
    for k in range(2):
        df.where(f"id >= {20 * k} and id < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = metrics.stream(spark, str(tmp_path / "in"), df.schema)
    q = metrics.limit_rate_stream(s, 3, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.id, r.allowed) for r in spark.table("limited").collect())
    assert got == sorted((r.id, r.allowed) for r in metrics.limit_rate(df, 3, 60).collect())


def test_listings(spark):
    eb = {"id": "1", "name": {"text": "A"}, "start": {"local": "2025-01-02T20:00:00"}, "is_free": False, "venue": {"name": "V", "latitude": "55.6", "longitude": "12.5"}, "ticket_classes": [{"free": False, "cost": {"display": "$10", "major_value": "10"}}, {"free": True}]}
    raw = spark.createDataFrame([(json.dumps(eb),), (json.dumps(eb | {"id": "2", "venue": None}),), ("{broken",)], "value string")
    rows = listings.eventbrite(raw).collect()
    assert [(r.source_id, r.price_min, r.price_max) for r in rows] == [("1", 0.0, 65.0)]
    tm = {"id": "9", "name": "B", "dates": {"start": {"localDate": "2025-03-01"}}, "images": [{"url": "s", "width": 1}, {"url": "w", "width": 9}], "pleaseNote": "n"}
    r = listings.ticketmaster(spark.createDataFrame([(json.dumps(tm),)], "value string")).first()
    assert (r.image_url, r.description, r.date_time.date()) == ("w", "n", dt.date(2025, 3, 1))
    lu = spark.createDataFrame([('{"slug":"x","title":"T","startTime":"2025-01-01T10:00:00Z"}',), ('{"slug":"y"}',)], "value string")
    assert [r.source_id for r in listings.embedded_json(lu).collect()] == ["x"]


def test_words_beyond_ascii(spark):
    """Letters of any script are letters of tags, mentions, titles and first sentences."""
    texts = ["Århus får en ny café. Og mere", "¡Ñandú! sí", "mød @søren på #kødbyen, #año_1", "你好, мир"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    got = df.orderBy("i").select(text.first_sentence(t).alias("s"), text.title_key(t).alias("k"), text.hashtags(t).alias("h"), text.mentions(t).alias("m"), text.clean(t).alias("c")).collect()
    assert [r.s for r in got][:2] == ["Århus får en ny café", "Ñandú"]
    assert [r.k for r in got] == ["århus får en ny café og mere", "ñandú sí", "mød søren på kødbyen año_1", "你好 мир"]
    assert got[2].h == ["kødbyen", "año_1"] and got[2].m == ["søren"] and got[2].c == "mød på kødbyen, año_1"
