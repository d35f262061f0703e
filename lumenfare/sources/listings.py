"""Event listings from JSON and HTML landings, each reshaped to one common record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

COMMON = ["source", "source_id", "title", "description", "date_time", "end_date_time", "venue_name", "venue_address", "venue_lat", "venue_lon", "price_min", "price_max", "currency", "image_url", "source_url"]
_EVENTBRITE = "id string, name struct<text:string>, description struct<text:string>, start struct<local:string>, end struct<local:string>, url string, is_free boolean, logo struct<url:string>, venue struct<name:string,latitude:string,longitude:string,address:struct<localized_area_display:string>>, ticket_classes array<struct<free:boolean,cost:struct<display:string,major_value:string>>>"
_TICKETMASTER = "id string, name string, url string, info string, pleaseNote string, dates struct<start:struct<dateTime:string,localDate:string>>, priceRanges array<struct<min:double,max:double,currency:string>>, images array<struct<url:string,width:int>>, _embedded struct<venues:array<struct<name:string,address:struct<line1:string>,location:struct<latitude:string,longitude:string>>>>"


def _common(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[(columns[c] if c in columns else F.lit(None).cast("string")).alias(c) for c in COMMON])


def parsed(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """JSON lines to records; malformed ones become null and are left out."""
    return raw.select(F.from_json(column, schema).alias("r")).where("r.id is not null").select("r.*")


def eventbrite(raw: DataFrame, rate: float = 6.5) -> DataFrame:
    """Records with a venue and coordinates; free events cost 0, others the span of their ticket classes in DKK."""
    r = parsed(raw, _EVENTBRITE)
    costs = F.filter(F.transform("ticket_classes", lambda t: F.when(t["free"], 0.0).otherwise(t["cost"]["major_value"].cast("double") * rate)), lambda x: x.isNotNull())
    lat, lon = F.col("venue.latitude").cast("double"), F.col("venue.longitude").cast("double")
    price = lambda f: F.when(F.col("is_free"), 0.0).otherwise(f(costs))
    return _common(r.where(lat.isNotNull() & lon.isNotNull()), source=F.lit("eventbrite"), source_id=F.col("id"), title=F.col("name.text"), description=F.coalesce("description.text", F.lit("")), date_time=F.try_to_timestamp("start.local"), end_date_time=F.try_to_timestamp("end.local"), venue_name=F.col("venue.name"), venue_address=F.col("venue.address.localized_area_display"), venue_lat=lat, venue_lon=lon, price_min=price(F.array_min), price_max=price(F.array_max), currency=F.lit("DKK"), image_url=F.col("logo.url"), source_url=F.col("url"))


def ticketmaster(raw: DataFrame) -> DataFrame:
    """First venue, first price range, widest image; info or else a note; records without a date are left out."""
    r = parsed(raw, _TICKETMASTER)
    v, p = F.get("_embedded.venues", F.lit(0)), F.get("priceRanges", F.lit(0))
    at = F.coalesce(F.try_to_timestamp("dates.start.dateTime"), F.try_to_timestamp("dates.start.localDate"))
    widest = F.get(F.array_sort("images", lambda a, b: F.coalesce(b["width"], F.lit(0)) - F.coalesce(a["width"], F.lit(0))), F.lit(0))["url"]
    return _common(r.where(at.isNotNull()), source=F.lit("ticketmaster"), source_id=F.col("id"), title=F.col("name"), description=F.coalesce(F.nullif("info", F.lit("")), "pleaseNote"), date_time=at, venue_name=v["name"], venue_address=v["address"]["line1"], venue_lat=v["location"]["latitude"].cast("double"), venue_lon=v["location"]["longitude"].cast("double"), price_min=p["min"], price_max=p["max"], currency=F.coalesce(p["currency"], F.lit("DKK")), image_url=widest, source_url=F.col("url"))


def first_of(json: Column, *keys: str) -> Column:
    """The first non-empty value among alternative JSON keys."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in keys])


def embedded_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """Records under alternative keys; those without id, title or start are left out."""
    j = F.col(column)
    r = raw.select(first_of(j, "api_id", "id", "slug").alias("i"), first_of(j, "name", "title").alias("t"), F.try_to_timestamp(first_of(j, "start_at", "startTime")).alias("s"), F.try_to_timestamp(first_of(j, "end_at", "endTime")).alias("e"), first_of(j, "description").alias("d"), first_of(j, "cover_url", "image").alias("c"))
    return _common(r.where("i is not null and t is not null and s is not null"), source=F.lit("luma"), source_id=F.col("i"), title=F.col("t"), description=F.col("d"), date_time=F.col("s"), end_date_time=F.col("e"), image_url=F.col("c"), currency=F.lit("DKK"))


def page_event(html: Column) -> Column:
    """(title, start, image) of a page: JSON-LD of an event, or else OpenGraph tags."""
    ld = F.regexp_extract(html, r'(?s)<script type="application/ld\+json">(.*?)</script>', 1)
    event = F.get_json_object(ld, "$['@type']").isin("Event", "MusicEvent")
    og = lambda p: F.nullif(F.regexp_extract(html, rf'<meta property="og:{p}" content="([^"]*)"', 1), F.lit(""))
    pick = lambda key, p: F.coalesce(F.when(event, F.get_json_object(ld, f"$.{key}")), og(p))
    return F.struct(pick("name", "title").alias("title"), F.when(event, F.get_json_object(ld, "$.startDate")).alias("start"), pick("image", "image").alias("image"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of a page's links in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), 1)).alias("pos", "href"))


def visible_text(html: Column) -> Column:
    """A page's text without script, style, nav, header and footer elements, tags and extra white space."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer)\b.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"[ \t\n\r]+", " "))


def carried(blocks: DataFrame, by: str, pos: str, header: Column) -> DataFrame:
    """blocks with current, the last header at or before each."""
    return blocks.withColumn("current", F.last(header, ignorenulls=True).over(W.partitionBy(by).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)))


# Words of events, places and times in announcements.
EVENT_WORDS = ["concert", "exhibition", "performance", "show", "festival", "market", "screening", "workshop", "tour", "opening", "closing", "premiere", "live", "event", "celebration", "party", "gathering", "meeting", "koncert", "udstilling", "forestilling", "marked"]
PLACE_WORDS = ["at ", "venue", "location", "address", "copenhagen", "københavn", "museum", "gallery", "theater", "theatre", "club", "bar", "hall", "center", "centre", "park", "square", "street"]
TIME_WORDS = ["time", "clock", "am", "pm", ":", "from", "until", "to", "klokken", "kl", "fra", "til"]


def event_blocks(pages: DataFrame, least: int = 50) -> DataFrame:
    """(page_id, pos, block) of the lines of pages' texts (page_id, text) that are long enough and look like an event."""
    b = pages.select("page_id", F.posexplode(F.split("text", "\n")).alias("pos", "block")).withColumn("block", F.trim("block"))
    return b.where((F.length("block") >= least) & looks_like_event(F.col("block"), EVENT_WORDS, PLACE_WORDS, TIME_WORDS))


def looks_like_event(text: Column, event_words: list[str], place_words: list[str], time_words: list[str], least: int = 30) -> Column:
    """An event word and a word of place or time, in a text of at least `least` characters."""
    has = lambda ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower(text), w))
    return (F.length(text) >= least) & has(event_words) & (has(place_words) | has(time_words))


# Headings of a venue's page that are no titles.
NO_TITLES = ["program", "kalender", "calendar", "events", "billetter", "tickets", "menu", "om os", "about", "kontakt", "contact", "nyhedsbrev", "newsletter"]


def _by_class(block: Column, *names: str) -> Column:
    """The text of a block's first element whose class holds one of the names."""
    text = F.regexp_extract(block, rf"(?is)<[a-z0-9]+[^>]*class=\"[^\"]*\b(?:{'|'.join(names)})\b[^\"]*\"[^>]*>(.*?)</", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))


def site_events(pages: DataFrame, now: Column, days: int, block_class: str = "event") -> DataFrame:
    """(page_id, title, at, price, genre, url) of the blocks of venues' pages (page_id, html).

    A block begins at an element whose class begins with block_class and ends where the next begins. Title, date, price
    and genre are the first elements of their classes; the link is the first one to tickets, or else the first. Blocks
    without a title or date, with a heading for a title, or outside the time from now to `days` later are left out; of
    blocks of one page with one title and time the first counts.
    """
    from lumenfare.functions.dates import announced_date
    from lumenfare.functions.extract import price_in_kroner

    start = rf"(?i)<(?=[a-z0-9]+[^>]*class=\"{block_class}[-_ ][^\"]*(?:card|item|row|container|teaser|block)[^\"]*\")"
    b = pages.select("page_id", F.posexplode(F.split("html", start)).alias("pos", "block")).where("pos > 0")
    b = b.withColumn("block", F.concat(F.lit("<"), "block"))
    link = F.coalesce(F.nullif(F.regexp_extract("block", r'(?is)<a[^>]*class="[^"]*(?:ticket|billet)[^"]*"[^>]*href="([^"]*)"', 1), F.lit("")), F.nullif(F.regexp_extract("block", r'(?is)<a[^>]*href="([^"]*)"', 1), F.lit("")))
    e = b.select("page_id", "pos", _by_class(F.col("block"), "title", "headline", "name").alias("title"), announced_date(_by_class(F.col("block"), "date", "dato"), now).alias("at"), price_in_kroner(_by_class(F.col("block"), "price", "pris")).alias("price"), _by_class(F.col("block"), "genre").alias("genre"), link.alias("url"))
    e = e.where(F.col("title").isNotNull() & ~F.lower("title").isin(NO_TITLES) & (F.col("at") > now) & (F.col("at") < now + F.make_dt_interval(F.lit(days))))
    first = e.groupBy("page_id", "title", "at").agg(F.min_by(F.struct("price", "genre", "url"), "pos").alias("r"))
    return first.select("page_id", "title", "at", "r.*")


def union_all(sources: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
