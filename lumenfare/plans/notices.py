"""Registered queries that read dates, names, prices and categories from announcements.

The announcements are made of each catalogue event's number by rule, and the statements say from the number alone what
must be read from them, so that a statement never parses a text.
"""

from pyspark.sql import functions as F

from lumenfare.functions import dates
from lumenfare.functions import extract as E
from lumenfare.functions import text as X
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, catalog, read, sql

NOW = "timestamp '2024-01-15 00:00:00'"  # a Monday
DANISH = "januar februar marts april maj juni juli august september oktober november december".split()
ENGLISH = "January February March April May June July August September October November December".split()
DANISH_DAYS = "mandag tirsdag onsdag torsdag fredag lørdag søndag".split()
ENGLISH_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()

#: The same numbers in statements.
_N = "n AS (SELECT p_partkey AS k, p_name AS name, (p_partkey%28+1)::int AS d, (p_partkey%12+1)::int AS m, (2024+p_partkey%3)::int AS y FROM part)"


def _k():
    return F.col("k")


def _d():
    return (_k() % 28 + 1).cast("int")


def _m():
    return (_k() % 12 + 1).cast("int")


def _y():
    return (2024 + _k() % 3).cast("int")


def _pick(words, at):
    return F.element_at(F.array(*map(F.lit, words)), at)


def _numbers(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))


def _forms(*texts):
    """The text of form k % n."""
    out = F.lit(None).cast("string")
    for i, t in enumerate(texts):
        out = F.when(_k() % len(texts) == i, t).otherwise(out)
    return out


@query(f"WITH {_N} SELECT k, CASE k%6 WHEN 0 THEN make_date(y,m,d)::timestamp+to_hours(20) WHEN 1 THEN make_date(CASE WHEN m=1 AND d<15 THEN 2025 ELSE 2024 END,m,d)::timestamp+to_hours(20) WHEN 2 THEN {NOW}+to_days((CASE WHEN k%7=0 THEN 7 ELSE k%7 END)::int) WHEN 3 THEN make_date(y,m,d)::timestamp+to_hours(20) WHEN 4 THEN NULL ELSE NULL END AS at FROM n")
def announced_dates(spark, d):
    """`17. september 2025`, `17. sep`, `Hver fredag`, `lørdag 17. september 2025`, `snart`, and a day that no month has."""
    da = _pick(DANISH, _m())
    t = _forms(F.concat(_d(), F.lit(". "), da, F.lit(" "), _y()), F.concat(_d(), F.lit(". "), F.substring(da, 1, 3)), F.concat(F.lit("Hver "), _pick(DANISH_DAYS, (_k() % 7 + 1).cast("int"))), F.concat(F.lit("lørdag "), _d(), F.lit(". "), da, F.lit(" "), _y()), F.lit("snart"), F.concat(F.lit("31. februar "), _y()))
    return _numbers(spark, d).select("k", dates.announced_date(F.concat(F.lit("Koncert: "), t), as_of()).alias("at"))


@query(f"WITH {_N} SELECT k, CASE k%7 WHEN 0 THEN make_date(y,m,d)::timestamp WHEN 1 THEN make_date(2024,m,d)::timestamp WHEN 2 THEN make_date(y,m,d)::timestamp WHEN 4 THEN {NOW} WHEN 5 THEN {NOW}+to_days(5) WHEN 6 THEN {NOW}+to_days(1) END AS at FROM n")
def header_dates(spark, d):
    en = _pick(ENGLISH, _m())
    t = _forms(F.concat(_d(), F.lit(" "), en, F.lit(" "), _y()), F.concat(F.lit("On "), _d(), F.lit(" of "), en), F.concat(en, F.lit(" "), _d(), F.lit("th "), _y()), F.concat_ws(".", _d(), _m(), _y()), F.lit("Tonight only"), F.lit("This weekend"), F.lit("tomorrow"))
    return _numbers(spark, d).select("k", dates.header_date(t, as_of()).alias("at"))


@query(f"WITH {_N} SELECT k, array_to_string(list_transform(CASE k%8 WHEN 0 THEN [make_date(y,m,d)::timestamp] WHEN 1 THEN [make_date(y,m,d)::timestamp] WHEN 2 THEN [make_date(y,m,d)::timestamp] WHEN 3 THEN [{NOW}+to_days((CASE WHEN k%7=0 THEN 7 ELSE k%7 END)::int)] WHEN 4 THEN [{NOW}+to_hours(20),{NOW}+to_hours(20)] WHEN 5 THEN [{NOW}+to_days(4)] WHEN 6 THEN [make_date(y,m,d)::timestamp,make_date(2026,m,1)::timestamp,{NOW}+to_days(1)] ELSE [] END, lambda t: strftime(t,'%Y-%m-%d %H')),', ') AS at FROM n")
def dates_in_text(spark, d):
    """All times of a text, kind by kind; 31.2. names none."""
    t = _forms(F.concat(F.lit("on "), F.concat_ws(".", _d(), _m(), _y())), F.concat_ws("/", _d(), _m(), _y()), F.concat_ws("-", _y(), F.lpad(_m().cast("string"), 2, "0"), _d()), F.concat(F.lit("every "), _pick(ENGLISH_DAYS, (_k() % 7 + 1).cast("int"))), F.lit("Tonight, i dag"), F.lit("denne weekend"), F.concat(F.lit("i morgen, 1/"), _m(), F.lit("/2026 and "), F.concat_ws(".", _d(), _m(), _y())), F.concat(F.lit("31.2."), _y()))
    return _numbers(spark, d).select("k", F.array_join(F.transform(dates.dates_in(t, as_of()), lambda x: F.date_format(x, "yyyy-MM-dd HH")), ", ").alias("at"))


@query(f"WITH {_N} SELECT k, CASE k%4 WHEN 0 THEN 'Anna O''Berg' || k WHEN 1 THEN 'DJ Night-Owl' || k WHEN 2 THEN 'Kollektiv Nr. ' || k ELSE '' END AS artist, CASE k%3 WHEN 0 THEN k%3000::double WHEN 1 THEN (1000+k%1000)::double END AS price, CASE k%5 WHEN 0 THEN 'Vega' || k WHEN 1 THEN 'Loppen' || k WHEN 2 THEN '@Rust' || k END AS venue, CASE k%4 WHEN 0 THEN 'gratis' WHEN 1 THEN k%900 || ' kr' WHEN 2 THEN 'Admission: ' || k || ' at the door' END AS price_phrase FROM n")
def names_and_prices(spark, d):
    artist = _forms(F.concat(F.lit(" \"anna o'BERG"), _k(), F.lit("\" ")), F.concat(F.lit("dj night-owl"), _k()), F.concat(F.lit("'kollektiv NR. "), _k()), F.lit(None).cast("string"))
    price = _forms(F.concat(_k() % 3000, F.lit(" kr")), F.concat(F.lit("Pris: 1."), F.lpad((_k() % 1000).cast("string"), 3, "0"), F.lit(" KR.")), F.concat(_k(), F.lit(" dollars")))
    venue = _forms(F.concat(F.lit("Live at Vega"), _k(), F.lit(" tonight")), F.concat(F.lit("Venue: Loppen"), _k(), F.lit(", 20:00")), F.concat(F.lit("come to @Rust"), _k(), F.lit(".")), F.lit("at a, so"), F.lit("nowhere"))
    phrase = _forms(F.lit("Entré gratis, 100 kr"), F.concat(F.lit("from "), _k() % 900, F.lit(" kr and up")), F.concat(F.lit("Admission: "), _k(), F.lit(" at the door. Tickets: none")), F.lit("ask us"))
    return _numbers(spark, d).select("k", E.artist_name(artist).alias("artist"), E.price_in_kroner(price).alias("price"), E.venue_in(venue).alias("venue"), E.price_phrase(phrase).alias("price_phrase"))


@query(f"WITH {_N} SELECT k, CASE k%9 WHEN 0 THEN 'music' WHEN 1 THEN 'art' WHEN 2 THEN 'theater' WHEN 3 THEN 'cultural' WHEN 4 THEN 'market' WHEN 5 THEN 'film' WHEN 6 THEN 'festival' WHEN 7 THEN 'nightlife' ELSE 'cultural' END AS category, CASE k%4 WHEN 0 THEN 'Nørrebro' WHEN 1 THEN 'Christiania' WHEN 2 THEN 'Amager' ELSE 'Copenhagen' END AS quarter, CASE k%3 WHEN 0 THEN 0.85 WHEN 1 THEN 1.0 ELSE 0.7 END::double AS venue_standing, CASE k%3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.7 END::double AS source_standing FROM n")
def categories_and_lookups(spark, d):
    t = _forms(*map(F.lit, ("Jazz in the museum", "Sculpture in the gallery", "A comedy", "Old heritage", "Flea time", "A documentary", "Summer fest", "Disco with dj", "Nothing to see")))
    one = lambda words: _forms(*[F.lit(w).cast("string") for w in words])
    return _numbers(spark, d).select("k", E.category(t).alias("category"), E.looked_up(one(["Rust", "Loppen", "Beta", None]), E.QUARTERS, "Copenhagen").alias("quarter"), E.looked_up(one(["Culture Box", "Noma", "X"]), E.VENUE_STANDING, 0.7).alias("venue_standing"), E.looked_up(one(["store_vega", "nordic_techkomm", None]), E.SOURCE_STANDING, 0.7).alias("source_standing"))


@query(f"WITH {_N} SELECT k, 'come to ' || name || ' techno' || k%9 || ' ' || k%24 || ':' || lpad((k%60)::varchar,2,'0') || ' ' || k%500 || ' kr' AS cleaned_text, 'techno' || k%9 AS hashtags, 'friend' || k AS mentions, lpad((k%24)::varchar,1,'0') || CASE WHEN k%24>9 THEN right((k%24)::varchar,1) ELSE '' END || ':' || lpad((k%60)::varchar,2,'0') AS times, CASE WHEN contains(name,'pop') THEN '' ELSE '' END || 'techno' AS genre, k%500 AS price, 'kr' AS currency FROM n")
def social_posts(spark, d):
    t = F.concat(F.lit("Come  to "), F.col("name"), F.lit(" @friend"), _k(), F.lit(" #Techno"), _k() % 9, F.lit(" "), _k() % 24, F.lit(":"), F.lpad((_k() % 60).cast("string"), 2, "0"), F.lit(" "), _k() % 500, F.lit(" kr http://x.example/"), _k(), F.lit("!!!"))
    p = _numbers(spark, d).select("k", E.post(t).alias("p"))
    return p.select("k", F.trim(F.regexp_replace("p.cleaned_text", "!+$", "")).alias("cleaned_text"), F.array_join("p.hashtags", ",").alias("hashtags"), F.array_join("p.mentions", ",").alias("mentions"), F.array_join("p.times", ",").alias("times"), F.get(F.filter("p.genres", lambda g: g == "techno"), F.lit(0)).alias("genre"), F.get("p.prices", F.lit(0))["amount"].cast("long").alias("price"), F.get("p.prices", F.lit(0))["currency"].alias("currency"))


@query(f"WITH {_N} SELECT k, CASE k%4 WHEN 0 THEN 'Anna Berg,Carl Dahl' WHEN 1 THEN 'Band' WHEN 2 THEN '' ELSE 'Eva Holm' END AS artists, CASE k%4 WHEN 0 THEN 'Anna Berg,Carl Dahl' WHEN 1 THEN 'Band' WHEN 2 THEN 'Live' ELSE 'Eva Holm' END AS names, CASE WHEN k%4<>3 THEN 'Night Of Stars ' || k END AS slug_title, CASE WHEN k%4<>3 THEN make_date(y,m,d) END AS slug_date FROM n")
def artists_and_slugs(spark, d):
    t = _forms(F.lit("featuring Anna Berg. Carl Dahl live"), F.lit("we go with Band!"), F.lit("Live concert"), F.lit("Eva Holm concert"))
    url = F.when(_k() % 4 != 3, F.concat(F.lit("http://x.example/event/night-of-stars-"), _k(), F.lit("-"), _y(), F.lit("-"), F.lpad(_m().cast("string"), 2, "0"), F.lit("-"), F.lpad(_d().cast("string"), 2, "0"))).otherwise(F.concat(F.lit("http://x.example/"), _k()))
    names = F.filter(E.capitalised(t), lambda x: F.length(x) > 0)
    return _numbers(spark, d).select("k", F.array_join(E.artists_in(t), ",").alias("artists"), F.array_join(names, ",").alias("names"), E.slug(url)["title"].alias("slug_title"), E.slug(url)["date"].alias("slug_date"))


@query(sql("SELECT event_id, title || ' . at v' || venue_id || ' . music: ' || array_to_string(genres,' ') || ' . featuring: a b c' AS event_text, 'music genres: ' || array_to_string(genres,' ') || ' . venues: v' || venue_id AS wish_text, CASE WHEN event_id%2=0 THEN 'music event' ELSE 'artists: x' END AS other_wish, 'Event: ' || title || chr(10) || 'Description: No description' || chr(10) || 'Venue: v' || venue_id || ' in None' || chr(10) || 'Date: ' || strftime(date_time,'%Y-%m-%d') || chr(10) || 'Price: 1-2 DKK' AS document, title || ' . venue: V' || venue_id || ' . artists: a, b, c . genres: ' || array_to_string(genres,', ') AS labelled FROM catalog", "catalog"))
def embedding_texts(spark, d):
    e, venue, none = catalog(spark, d), F.concat(F.lit("v"), "venue_id"), F.lit(None).cast("string")
    names = F.array(*map(F.lit, "abcd"))
    wish = F.when(F.col("event_id") % 2 == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    return e.select("event_id", E.event_text(F.col("title"), F.lit(""), venue, F.col("genres"), names).alias("event_text"), E.wish_text(F.col("genres"), empty, F.array(venue)).alias("wish_text"), E.wish_text(empty, wish, empty).alias("other_wish"), E.document_text(F.col("title"), none, venue, none, F.date_format("date_time", "yyyy-MM-dd"), F.lit(1), F.lit(2)).alias("document"), E.labelled_text(F.col("title"), F.lit(""), venue, names, F.col("genres")).alias("labelled"))


_TOPIC_TEXTS = ["Hackathon on machine learning and data science", "Techno night at the club", "Jazz concert by a folk band", "Yoga and football match", "Nothing at all", "R&B and hip hop show", "Startup meetup with techno", "Marathon, party and opera"]
_TOPICS = ["tech", "nightlife", "music", "sports", "music", "music", "tech", "nightlife"]
_CONFIDENCE = [0.4, 0.3, 0.4, 0.3, 0.3, 0.3, 0.15, 0.1]


@query(f"WITH {_N} SELECT k, CASE k%8 {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(_TOPICS))} END AS topic, CASE k%8 {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(_CONFIDENCE))} END::double AS confidence, CASE k%3 WHEN 0 THEN 'free,outdoor' WHEN 1 THEN 'family-friendly,danish' ELSE '18+,recurring' END AS tags FROM n")
def notice_topics(spark, d):
    """The whole keyword lists: `tech` does not stand in `techno`, which takes half a point off it; 'data science' is a
    phrase, and its `science` a word of its own."""
    t = _forms(*map(F.lit, _TOPIC_TEXTS))
    g = _forms(*map(F.lit, ("Free entry in the park", "For kids, på dansk", "18+ every week")))
    c = _numbers(spark, d).select("k", X.classified(t, X.TOPIC_KEYWORDS, X.NEGATIVES).alias("c"), F.array_join(X.tags(g, F.lit(0.0)), ",").alias("tags"))
    return c.select("k", "c.topic", F.round("c.confidence", 6).alias("confidence"), "tags")
