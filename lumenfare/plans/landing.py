"""Registered queries of ingestion from raw records to the catalogue, and of the listings' parsers.

Raw records are made of the catalogue's rows by rule; the statements say from the numbers what must become of them.
"""

from pyspark.sql import functions as F

from lumenfare.operators import landing as I
from lumenfare.plans.query import query
from lumenfare.sources import listings as S
from lumenfare.sources.tables import catalog, interactions, read, sql, venues

_TEXTS = ["Hackathon on python", "Techno rave in the park", "Free jazz concert for kids", "Football match"]
_TOPIC = "CASE event_id%4 WHEN 0 THEN 'tech' WHEN 1 THEN 'nightlife' WHEN 2 THEN 'music' ELSE 'sports' END"
_TAGS = "CASE event_id%4 WHEN 1 THEN 'outdoor' WHEN 2 THEN CASE WHEN price_min IS NULL OR price_min=0 THEN 'free,family-friendly' ELSE 'family-friendly' END ELSE '' END"


def _k():
    return F.col("event_id")


def _raw(spark, d):
    """Odd events with an id of their source, of which every third stands twice; even ones known by title and time."""
    c = catalog(spark, d)
    text = F.element_at(F.array(*map(F.lit, _TEXTS)), (_k() % 4 + 1).cast("int"))
    r = c.select(_k(), text.alias("name"), F.when(_k() % 2 == 1, F.concat(F.lit("x"), (_k() - F.when(_k() % 3 == 0, 2).otherwise(0)).cast("string"))).alias("id"), F.struct(F.concat(F.lit("Supplier#"), F.lpad((_k() % 7).cast("string"), 9, "0")).alias("name"), F.lit("street").alias("address")).alias("venue"), F.struct(F.col("price_min").alias("min"), F.col("price_max").alias("max")).alias("price"), F.lit("a").alias("source"), F.lit("about").alias("description"), F.make_timestamp_ntz(F.lit(2024), F.lit(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("date_time"))
    return r.drop("event_id").withColumn("source_id", F.col("id")).drop("id")


def _known(spark, d):
    """What exists already: the ids below x40."""
    c = catalog(spark, d).where(_k() < 40)
    return c.select(F.lit("a").alias("source"), F.concat(F.lit("x"), _k().cast("string")).alias("source_id"), "title", "date_time")


_REC = f"r AS (SELECT event_id, {_TOPIC} AS topic, {_TAGS} AS tags, price_min IS NULL OR price_min=0 AS is_free, event_id%7 AS v, CASE WHEN event_id%2=1 THEN event_id - CASE WHEN event_id%3=0 THEN 2 ELSE 0 END END AS x, event_id%4 AS form FROM catalog), k AS (SELECT *, CASE WHEN x IS NULL THEN row_number() OVER (PARTITION BY x IS NULL, form)>1 ELSE row_number() OVER (PARTITION BY x ORDER BY event_id)>1 OR x<40 END AS dup FROM r)"


@query(sql(f", {_REC} SELECT topic, count(*) AS total, count(CASE WHEN dup THEN 1 END) AS duplicates, count(CASE WHEN NOT dup THEN 1 END) AS inserted FROM k GROUP BY topic", "catalog"))
def ingest_counters(spark, d):
    """Classify, tag, drop duplicates by id or by title and time, get or create venues; counted by topic."""
    known = venues(spark, d).select("name", F.concat(F.lit("v"), "venue_id").alias("id"))
    return I.counters(I.ingested(_raw(spark, d), _known(spark, d), known)).drop("source")


@query(sql(f", {_REC} SELECT DISTINCT CASE WHEN x IS NOT NULL THEN 'x' || x END AS source_id, topic, CASE WHEN x IS NOT NULL AND v IN (SELECT CAST(substring(name,10) AS BIGINT) FROM venues) THEN 'v' || (SELECT venue_id FROM venues WHERE name='Supplier#' || lpad(v::varchar,9,'0')) END AS known_venue FROM k WHERE NOT dup AND x IS NOT NULL", "catalog", "venues").replace("'v' || (SELECT venue_id FROM venues WHERE name='Supplier#' || lpad(v::varchar,9,'0'))", "'v' || v"))
def ingest_records(spark, d):
    """The records that go in, with the ids of venues that were known; others get ids made of their names."""
    known = venues(spark, d).select("name", F.concat(F.lit("v"), "venue_id").alias("id"))
    r = I.ingested(_raw(spark, d), _known(spark, d), known).where("not is_duplicate and source_id is not null")
    return r.select("source_id", "topic", F.when(F.length("venue_id") < 64, F.col("venue_id")).alias("known_venue")).distinct()


@query(sql("SELECT DISTINCT name, address, sha256(name || chr(31) || address) AS venue_id FROM (SELECT 'Supplier#' || lpad((event_id%13)::varchar,9,'0') AS name, 'street ' || event_id%3 AS address FROM catalog) n WHERE NOT EXISTS (SELECT 1 FROM venues v WHERE v.name=n.name AND n.address='street ' || v.venue_id%3)", "catalog", "venues"))
def venues_by_name_and_address(spark, d):
    """The venues that records name and nobody knows under that address."""
    r = catalog(spark, d).select(F.concat(F.lit("Supplier#"), F.lpad((_k() % 13).cast("string"), 9, "0")).alias("venue_name"), F.concat(F.lit("street "), (_k() % 3).cast("string")).alias("venue_address"))
    known = venues(spark, d).select("name", F.concat(F.lit("street "), (F.col("venue_id") % 3).cast("string")).alias("address"), F.col("venue_id").cast("string").alias("id"))
    return I.venue_ids(r, known, ["name", "address"])[1].select("name", "address", "venue_id")


@query(sql("SELECT event_id, venue_id, date_time::date AS day FROM catalog n WHERE event_id%2=1 AND NOT EXISTS (SELECT 1 FROM catalog o WHERE o.event_id%2=0 AND o.status<>'cancelled' AND o.venue_id=n.venue_id AND o.date_time::date=n.date_time::date) QUALIFY row_number() OVER (PARTITION BY venue_id, date_time::date ORDER BY event_id)=1", "catalog"))
def store_events(spark, d):
    c = catalog(spark, d)
    return I.one_a_day(c.where(_k() % 2 == 1), c.where(_k() % 2 == 0), "event_id").select("event_id", "venue_id", "day")


@query("SELECT event_id, user_id, ts, props AS data FROM events WHERE event_type='click'")
def logged_requests(spark, d):
    """Clicks stand for the one kind of tracked event that is kept."""
    return I.logged(read(spark, d, "events"), "click").select("event_id", "user_id", "ts", F.col("props").alias("data"))


@query(sql("SELECT part, count(*) AS n, sum(label)::bigint AS positives, sum(1-label)::bigint AS negatives, count(DISTINCT user_id) AS users FROM (SELECT user_id, CASE WHEN kind IN ('like','going','went','save') THEN 1 ELSE 0 END AS label, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, id) <= floor(count(*) OVER (PARTITION BY user_id)*0.8::double) THEN 'train' ELSE 'test' END AS part FROM interactions) GROUP BY part", "interactions"))
def training_set_counts(spark, d):
    from lumenfare.operators.training import split

    i = interactions(spark, d).select("id", "user_id", "ts", F.col("kind").isin("like", "going", "went", "save").cast("int").alias("label"))
    return I.set_counts(split(i, "user_id", ["ts", "id"]), "part")


def _json(spark, d, *fields):
    """One JSON text per catalogue event, of named columns."""
    return catalog(spark, d).select(F.to_json(F.struct(*fields)).alias("value"))


_ID = "CASE WHEN event_id%5<>4 THEN 'e' || event_id END"


@query(sql(f"SELECT 'e' || event_id AS source_id, title, timestamp '2024-03-01 20:00:00' + to_days((event_id%20)::int) AS date_time, CASE WHEN event_id%3=0 THEN 0.0 ELSE (event_id%50)*6.5 END::double AS price_min, CASE WHEN event_id%3=0 THEN 0.0 ELSE (event_id%50+10)*6.5 END::double AS price_max, 'v' || venue_id AS venue_name, 55.5::double AS venue_lat FROM catalog WHERE event_id%5<>4 AND event_id%7<>6", "catalog"))
def eventbrite_listings(spark, d):
    """Records without an id or without coordinates are left out; prices of ticket classes in kroner."""
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-03-01")), (_k() % 20).cast("int")), "yyyy-MM-dd'T'20:00:00")
    ticket = lambda n: F.struct(F.lit(False).alias("free"), F.struct(F.lit("x").alias("display"), n.cast("string").alias("major_value")).alias("cost"))
    raw = _json(spark, d, F.when(_k() % 5 != 4, F.concat(F.lit("e"), _k())).alias("id"), F.struct(F.col("title").alias("text")).alias("name"), F.struct(day.alias("local")).alias("start"), (_k() % 3 == 0).alias("is_free"), F.struct(F.concat(F.lit("v"), "venue_id").alias("name"), F.when(_k() % 7 != 6, "55.5").alias("latitude"), F.lit("12.5").alias("longitude")).alias("venue"), F.array(ticket(_k() % 50 + 10), ticket(_k() % 50)).alias("ticket_classes"))
    return S.eventbrite(raw).select("source_id", "title", F.col("date_time").cast("timestamp_ntz").alias("date_time"), "price_min", "price_max", "venue_name", "venue_lat")


@query(sql("SELECT 't' || event_id AS source_id, CASE WHEN event_id%2=0 THEN 'info' ELSE 'note' END AS description, date '2024-03-01' + (event_id%20)::int AS day, CASE WHEN event_id%3=0 THEN 'wide' ELSE 'w2' END AS image_url, CASE WHEN event_id%4>0 THEN (event_id%90)::double END AS price_min, CASE WHEN event_id%4>0 THEN 'EUR' ELSE 'DKK' END AS currency, 'v' || venue_id AS venue_name FROM catalog WHERE event_id%9<>8", "catalog"))
def ticketmaster_listings(spark, d):
    """First venue and price range, widest image, info or else the note, a date or else none of it."""
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-03-01")), (_k() % 20).cast("int")), "yyyy-MM-dd")
    image = lambda url, w: F.struct(F.lit(url).alias("url"), F.lit(w).alias("width"))
    images = F.when(_k() % 3 == 0, F.array(image("a", 10), image("wide", 900), image("b", 20))).otherwise(F.array(image("w1", 5), image("w2", 6)))
    venue = F.struct(F.concat(F.lit("v"), "venue_id").alias("name"))
    raw = _json(spark, d, F.concat(F.lit("t"), _k()).alias("id"), F.col("title").alias("name"), F.when(_k() % 2 == 0, "info").otherwise("").alias("info"), F.lit("note").alias("pleaseNote"), F.struct(F.struct(F.when(_k() % 9 != 8, day).alias("localDate")).alias("start")).alias("dates"), F.when(_k() % 4 > 0, F.array(F.struct((_k() % 90).cast("double").alias("min"), F.lit(99.0).alias("max"), F.lit("EUR").alias("currency")))).alias("priceRanges"), images.alias("images"), F.struct(F.array(venue, venue).alias("venues")).alias("_embedded"))
    return S.ticketmaster(raw).select("source_id", "description", F.to_date("date_time").alias("day"), "image_url", "price_min", "currency", "venue_name")


@query(sql("SELECT CASE event_id%3 WHEN 0 THEN 'a' WHEN 1 THEN 'i' ELSE 's' END || event_id AS source_id, title, CASE WHEN event_id%2=0 THEN 'about' END AS description FROM catalog WHERE event_id%11<>10", "catalog"))
def embedded_listings(spark, d):
    """Records under alternative keys; those without a start are left out."""
    at = F.when(_k() % 11 != 10, "2024-03-01T10:00:00")
    raw = _json(spark, d, F.when(_k() % 3 == 0, F.concat(F.lit("a"), _k())).alias("api_id"), F.when(_k() % 3 == 1, F.concat(F.lit("i"), _k())).alias("id"), F.when(_k() % 3 == 2, F.concat(F.lit("s"), _k())).alias("slug"), F.when(_k() % 2 == 0, F.col("title")).alias("name"), F.when(_k() % 2 == 1, F.col("title")).alias("title"), F.when(_k() % 4 < 2, at).alias("start_at"), F.when(_k() % 4 > 1, at).alias("startTime"), F.when(_k() % 2 == 0, "about").otherwise("").alias("description"))
    return S.embedded_json(raw).select("source_id", "title", "description")


@query(sql("SELECT event_id, CASE WHEN event_id%3=2 THEN NULL ELSE title END AS title, CASE WHEN event_id%3=0 THEN '2024-03-01' END AS start, CASE event_id%3 WHEN 0 THEN 'ld' WHEN 1 THEN 'og' END AS image FROM catalog", "catalog"))
def page_events(spark, d):
    """JSON-LD of an event, or OpenGraph tags, or neither."""
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type":"MusicEvent","name":"'), F.col("title"), F.lit('","startDate":"2024-03-01","image":"ld"}</script>'))
    og = F.concat(F.lit('<meta property="og:title" content="'), F.col("title"), F.lit('"><meta property="og:image" content="og">'))
    html = F.concat(F.lit("<html><head>"), F.when(_k() % 3 == 0, F.concat(ld, F.lit('<meta property="og:title" content="no">'))).when(_k() % 3 == 1, og).otherwise(""), F.lit("</head></html>"))
    return catalog(spark, d).select("event_id", S.page_event(html).alias("p")).select("event_id", "p.title", "p.start", "p.image")


@query(sql("SELECT event_id, n, title || ' ' || n AS title, make_date(2024,(event_id%12+1)::int,(event_id%28+1)::int)::timestamp + to_hours(20) AS at, (100+event_id%300)::double AS price, 'techno' AS genre, 'http://t.example/' || event_id AS url FROM catalog, range(1,3) r(n) WHERE make_date(2024,(event_id%12+1)::int,(event_id%28+1)::int) BETWEEN date '2024-01-16' AND date '2024-12-31' AND event_id%4<>0", "catalog"))
def venue_site_events(spark, d):
    """Blocks of a venue's page: title, date, price, genre and ticket link by class; headings that are no titles and
    past dates are left out, and a block that stands twice counts once."""
    k = F.col("event_id")
    months = F.array(*map(F.lit, "januar februar marts april maj juni juli august september oktober november december".split()))
    date = F.concat((k % 28 + 1).cast("string"), F.lit(". "), F.element_at(months, (k % 12 + 1).cast("int")), F.lit(" 2024"))
    block = lambda n: F.concat(F.lit('<div class="event-card"><h3 class="event-title">'), F.when(k % 4 == 0, "Program").otherwise(F.concat(F.col("title"), F.lit(f" {n}"))), F.lit('</h3><span class="date">'), date, F.lit('</span><p class="price">Entré '), (100 + k % 300).cast("string"), F.lit(' kr</p><span class="genre">techno</span><a class="ticket" href="http://t.example/'), k.cast("string"), F.lit('">Køb</a></div>'))
    pages = catalog(spark, d).select(k.alias("page_id"), F.concat(F.lit("<html><body>"), block(1), block(2), block(2), F.lit("</body></html>")).alias("html"))
    from lumenfare.sources.tables import as_of

    return S.site_events(pages, as_of(), 366).select(F.col("page_id").alias("event_id"), F.element_at(F.split("title", " "), -1).cast("long").alias("n"), "title", "at", "price", "genre", "url")
