"""Facts read from long and odd texts, genres of posts, wishes, standard scores, artist links, and prototypes in blocks."""

import random
import re

from pyspark.sql import functions as F

from lumenfare.functions import extract as E
from lumenfare.operators import hybrid as H
from lumenfare.operators import landing as L
from lumenfare.operators import recommend as R


def _artists(text):
    """The rule as a plain walk over matches that ignore case."""
    name = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
    out = []
    for p in (rf"featuring\s+({name})", rf"with\s+({name})", rf"({name})\s+live", rf"({name})\s+concert"):
        out += [m.strip() for m in re.findall(p, text, re.IGNORECASE | re.ASCII)]
    kept = [x for x in out if len(x) > 2 and x not in E.NO_ARTISTS]
    return list(dict.fromkeys(kept))[:5]


def _names(text):
    return re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", text, re.ASCII)


def test_names_equal_plain_matches(spark):
    rng = random.Random(5)
    words = ["Anna", "Berg", "with", "featuring", "live", "Live", "liver", "concert", "a", "x9", "DJ", "Berg2", "En_", "and", "the", "Tonight"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ". ", ", ", " ", "-", ""]) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", E.artists_in(F.col("t")).alias("a"), E.capitalised(F.col("t")).alias("n")).collect():
        assert r.a == _artists(r.t), r.t
        assert r.n == _names(r.t), r.t


def test_long_texts_need_no_deep_stack(spark):
    run = "Anna " * 300_000
    df = spark.createDataFrame([(0, run + "live. with " + run.replace("Anna", "Berg")), (1, ""), (2, None)], "i int, t string")
    got = {r.i: r for r in df.select("i", F.size(E.artists_in(F.col("t"))).alias("a"), F.size(E.capitalised(F.col("t"))).alias("n"), E.venue_in(F.col("t")).alias("v")).collect()}
    assert (got[0].a, got[0].n) == (2, 2) and (got[1].a, got[1].n) == (0, 0)


def test_genres_of_posts(spark):
    df = spark.createDataFrame([(0, "A Chillout night", ["DeepHouse"]), (1, None, None), (2, "x", ["singer-songwriter"])], "i int, t string, h array<string>")
    got = {r.i: r.g for r in df.select("i", E.post_genres(F.col("t"), F.col("h")).alias("g")).collect()}
    assert got == {0: ["house", "chillout"], 1: [], 2: []}
    assert E.GENRES.count("chillout") == 0 and "singer-songwriter" not in E.POST_GENRES


def test_wishes_of_nothing_and_of_something(spark):
    rows = [(0, None, None, None, None, None, None), (1, ["a", "b"], ["x"], 100.0, 250.0, [9, 18], [6])]
    df = spark.createDataFrame(rows, "i int, g array<string>, a array<string>, lo double, hi double, h array<int>, d array<int>")
    got = {r.i: r for r in df.select("i", *H.preference_features(*[F.col(c) for c in ("g", "a", "lo", "hi", "h", "d")])).collect()}
    assert tuple(got[0])[1:] == (0, 0, False, False, 0.0, 1000.0, 1000.0, False, 0, 0, False, False)
    assert tuple(got[1])[1:] == (2, 1, True, True, 100.0, 250.0, 150.0, True, 2, 1, True, True)


def test_standard_scores_of_constants_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0), (3, None, None)], "i int, same double, x double")
    got = {r.i: (r.z_same, r.z_x) for r in H.standardised(df, ["same", "x"]).collect()}
    assert got == {1: (0.0, -1.0), 2: (0.0, 1.0), 3: (None, None)}
    assert H.standardised(df.where("i > 9"), ["x"]).count() == 0


def test_artist_links_are_whole_and_single(spark):
    stored = spark.createDataFrame([(1, ["Ann", "Ann", "Bo", "", None]), (2, []), (3, None), (4, ["Bo"])], "event_id long, artists array<string>")
    known = spark.createDataFrame([("7", "Bo")], "artist_id string, name string")
    links, artists = L.artist_links(stored, known)
    ids = {r.name: r.artist_id for r in artists.collect()}
    assert ids["Bo"] == "7" and set(ids) == {"Ann", "Bo"}
    assert sorted((r.event_id, r.artist_id) for r in links.collect()) == sorted([(1, ids["Ann"]), (1, "7"), (4, "7")])


def test_fallback_is_clipped_and_agrees_with_itself(spark):
    e = spark.createDataFrame([(k, p) for k in range(300) for p in (0.0, 0.5, 1.0, None)], "event_id long, popularity double")
    s = R.popularity_fallback(e, seed=3).collect()
    assert s == R.popularity_fallback(e, seed=3).collect() and all(0 <= r.score <= 1 for r in s)
    near = [r.score - 0.5 for i, r in enumerate(s) if i % 4 == 1]
    assert max(map(abs, near)) <= 0.1 + 1e-12 and len(set(near)) > 200 and min(near) < -0.08 and max(near) > 0.08


def test_prototypes_in_blocks_equal_broadcast_ones(spark):
    rng = random.Random(2)
    rows = lambda n: spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(n)], "vec_id long, embedding array<double>")
    v, p = rows(60), rows(9)
    p = p.unionByName(p.selectExpr("vec_id + 100 as vec_id", "embedding"))
    one = sorted(map(tuple, R.assigned(v, p).collect()))
    assert one == sorted(map(tuple, R.assigned(v, p, most_broadcast=4, vector_blocks=3).collect()))
    assert len(one) == 60 and all(q < 100 for _, q, _ in one)
