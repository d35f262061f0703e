"""Facts read from announcements: artists, venues, prices, categories, slugs, and the texts made for embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfare.functions.text import clean, hashtags, mentions, times, titled, venue_name

# Genres that a text may name anywhere.
GENRES = [
    "techno", "house", "electronic", "edm", "trance", "dubstep", "dnb", "drum and bass", "ambient", "downtempo", "minimal", "electro", "deep house", "tech house", "progressive house", "hardcore",
    "rock", "pop", "jazz", "blues", "classical", "folk", "country", "punk", "metal", "indie", "alternative", "acoustic",
    "hip hop", "rap", "r&b", "soul", "funk", "reggae", "ska",
    "disco", "latin", "world", "experimental", "singer-songwriter",
]
# Genres that a post and its hashtags are searched for.
POST_GENRES = [
    "techno", "house", "deep house", "tech house", "progressive house", "electronic", "edm", "trance", "dubstep", "drum and bass", "dnb", "ambient", "downtempo", "chillout", "minimal", "electro",
    "rock", "pop", "jazz", "blues", "classical", "folk", "country", "punk", "metal", "hardcore", "indie", "alternative",
    "hip hop", "rap", "r&b", "soul", "funk", "reggae", "ska",
    "disco", "latin", "world", "experimental", "acoustic",
]
# Words that are no artist's name.
NO_ARTISTS = ["Live", "Music", "Concert", "Event", "Party", "Tonight", "Tomorrow", "Friday", "Saturday", "Sunday", "Copenhagen", "Denmark", "Danish", "Fredag", "Lørdag", "Søndag", "København", "Danmark"]
# Categories by the words that a text holds anywhere; the first category with a word wins.
CATEGORIES = {
    "music": ["concert", "live music", "jazz", "classical", "opera", "festival", "band", "orchestra"],
    "art": ["exhibition", "gallery", "museum", "art", "painting", "sculpture", "photography"],
    "theater": ["theater", "theatre", "play", "performance", "drama", "comedy"],
    "cultural": ["cultural", "heritage", "history", "tradition", "celebration"],
    "market": ["market", "flea", "vintage", "shopping", "craft"],
    "film": ["film", "cinema", "movie", "screening", "documentary"],
    "festival": ["festival", "fest", "celebration", "fair"],
    "nightlife": ["party", "club", "bar", "nightlife", "dj", "dance"],
}
# Quarters of venues, and the standing of venues and sources.
QUARTERS = {"Rust": "Nørrebro", "Pumpehuset": "Indre By", "Loppen": "Christiania", "Amager Bio": "Amager", "Beta": "Amager"}
VENUE_STANDING = {"Store Vega": 1.0, "Lille Vega": 0.9, "Jazzhus Montmartre": 0.95, "Culture Box": 0.85, "Noma": 1.0}
SOURCE_STANDING = {"visit_copenhagen": 1.0, "jazzhus_montmartre": 0.95, "store_vega": 0.95, "lille_vega": 0.95, "culture_box": 0.9, "noma_popup": 1.0, "golden_days": 0.9, "craft_beer_cph": 0.85, "nordic_techkomm": 0.8}

# A name is a run of capitalised words; where case does not count, of any words of two letters or more. Runs
# never give words back, so that the longest text needs no deep stack.
_NAME = r"[A-Z][a-z]+\b(?:\s+[A-Z][a-z]+\b)*+"
_ANY_NAME = r"[A-Za-z]{2,}(?:\s+[A-Za-z]{2,})*+"


def once(value: Column, f) -> Column:
    """f of a value that is computed once a row. An array function's body would compute it again for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def looked_up(key: Column, table: dict, default) -> Column:
    """The table's value for a key, or the default for others and null."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def artist_name(name: Column) -> Column:
    """One quote off either end, every word capitalised, `DJ ` kept in front; null is empty."""
    t = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), "^[\"']|[\"']$", "")
    dj = F.startswith(F.lower(t), F.lit("dj "))
    return F.trim(F.concat(F.when(dj, "DJ ").otherwise(""), titled(F.when(dj, F.substring(t, F.lit(4), F.length(t))).otherwise(t))))


def first_match(text: Column, patterns: list[str], least: int = 1, most: int = 1 << 30) -> Column:
    """Group 1 of the first pattern's first match of a length within the bounds (inclusive); null if none has one."""
    return F.coalesce(*[F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda x: F.trim(x)), lambda x: F.length(x).between(least, most)), F.lit(0)) for p in patterns])


def venue_in(text: Column) -> Column:
    """A venue of 3 to 49 characters after `at`, `venue:`, `location:` or `@`."""
    stop = r"(?:\s|,|\.)"
    # The patterns, in order.
    return first_match(text, [rf"(?i)at\s+([A-Z][^.!?]+?){stop}", rf"(?i)venue:\s*([^.!?]+?){stop}", rf"(?i)location:\s*([^.!?]+?){stop}", rf"(?i)(@\s*[A-Z][^.!?]+?){stop}"], 3, 49)


def price_phrase(text: Column) -> Column:
    """What a text says of its price: free, an amount, or the rest of a sentence after price, admission or tickets."""
    # The patterns, in order.
    return first_match(text, [r"(?i)(free|gratis)", r"(?i)([0-9]+\s*(?:kr|dkk|€|\$))", r"(?i)(price:\s*[^.!?]+)", r"(?i)(admission:\s*[^.!?]+)", r"(?i)(tickets?:\s*[^.!?]+)"])


def price_in_kroner(text: Column) -> Column:
    """The number before `kr`, with commas and full stops taken out of the text first."""
    return F.nullif(F.regexp_extract(F.translate(F.lower(text), ",.", ""), r"([0-9]+)\s*kr", 1), F.lit("")).cast("double")


def priced(text: Column) -> Column:
    """(amount, currency) of numbers before a currency or at the text's end, where the currency is empty."""
    pattern = r"([0-9]+)\s*(kr|dkk|euro|eur|$)"
    low = F.lower(text)
    return F.transform(F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(low, F.lit(pattern), 2).alias("c")), lambda x: F.struct(x["a"].cast("int").alias("amount"), x["c"].alias("currency")))


def category(text: Column, categories: dict[str, list[str]] = CATEGORIES, default: str = "cultural") -> Column:
    has = lambda low, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return once(F.lower(text), lambda low: F.coalesce(*[F.when(has(low, words), F.lit(c)) for c, words in categories.items()], F.lit(default)))


def capitalised(text: Column) -> Column:
    """Runs of capitalised words, which may be names."""
    return F.regexp_extract_all(text, F.lit(rf"\b({_NAME})\b"), 1)


def artists_in(text: Column, most: int = 5) -> Column:
    """Names after `featuring` or `with` and before `live` or `concert`, in that order, without words that are no names.
    As case does not count, a name goes on over all words up to the next mark."""
    after = [F.regexp_extract_all(text, F.lit(rf"(?i){w}\s+({_ANY_NAME})"), 1) for w in ("featuring", "with")]
    runs = F.regexp_extract_all(text, F.lit(_ANY_NAME), 0)
    upto = lambda w: lambda run: F.regexp_extract(run, rf"(?is)^(.*\S)\s+{w}", 1)
    hits = F.concat(*after, *[F.transform(runs, upto(w)) for w in ("live", "concert")])
    kept = F.filter(F.transform(hits, lambda x: F.trim(x)), lambda x: (F.length(x) > 2) & ~x.isin(NO_ARTISTS))
    return F.slice(F.array_distinct(kept), 1, most)


def genres_in(text: Column, genres: list[str] = GENRES) -> Column:
    """Genres that a text holds anywhere, within other words too, in order of the alphabet."""
    return F.array_sort(once(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, genres)), lambda g: F.contains(low, g))))


def post_genres(text: Column, tags: Column) -> Column:
    """Genres that a post or one of its hashtags holds anywhere, in the list's order; a null text or list is empty."""
    low = F.lower(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")))
    return once(low, lambda t: F.filter(F.array(*map(F.lit, POST_GENRES)), lambda g: F.contains(t, g)))


def post(text: Column) -> Column:
    """What a social post holds, as a struct; null for an empty one."""
    t = clean(text)
    return F.when(F.length(text) > 0, F.struct(t.alias("cleaned_text"), hashtags(text).alias("hashtags"), mentions(text).alias("mentions"), priced(text).alias("prices"), times(text).alias("times"), genres_in(text).alias("genres"), F.length(text).alias("original_length"), F.length(t).alias("cleaned_length")))


def slug(url: Column) -> Column:
    """(title, date) of `/event/<title>-<year>-<month>-<day>`; nulls for other addresses."""
    pattern = r"/event/([^/]+)-(\d{4})-(\d{2})-(\d{2})"
    part = lambda k: F.regexp_extract(url, pattern, k)
    name = F.nullif(titled(F.replace(part(1), F.lit("-"), F.lit(" "))), F.lit(""))
    return F.struct(name.alias("title"), F.try_to_timestamp(F.nullif(F.concat_ws("-", part(2), part(3), part(4)), F.lit("--")), F.lit("yyyy-MM-dd")).cast("date").alias("date"))


def _part(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def event_text(title: Column, description: Column, venue: Column, genres: Column, artists: Column, most: int = 500) -> Column:
    """An event for an embedding: title, description cut at `most`, `at`, `music:`, `featuring:` three artists, without
    addresses, runs of marks and tags."""
    t = F.concat_ws(" . ", _part("", F.trim(title)), _part("", F.substring(F.trim(description), 1, most)), _part("at ", F.trim(venue)), _part("music: ", F.array_join(genres, " ")), _part("featuring: ", F.array_join(F.slice(artists, 1, 3), " ")))
    for pattern, put in ((r"\s+", " "), (r"https?://\S+", ""), (r"\S+@\S+", ""), (r"[!@#$%^&*()_+=\[\]{}|;:,.<>?/~`-]{3,}", " "), (r"<[^>]+>", "")):
        t = F.regexp_replace(t, pattern, put)
    return F.trim(t)


def labelled_text(title: Column, description: Column, venue: Column, artists: Column, genres: Column, most: int = 300) -> Column:
    """An event for an embedding with labelled parts: cleaned title and description, `venue:`, `artists:` (three), `genres:`."""
    d = clean(description)
    cut = F.when(F.length(d) > most, F.concat(F.substring(d, 1, most), F.lit("..."))).otherwise(d)
    names = F.slice(artists, 1, 3)
    return F.concat_ws(" . ", _part("", clean(title)), _part("", cut), _part("venue: ", venue_name(venue)), _part("artists: ", F.array_join(names, ", ")), _part("genres: ", F.array_join(genres, ", ")))


def wish_text(genres: Column, artists: Column, venues: Column) -> Column:
    """A user's wishes as a text: `music genres:`, `artists:`, `venues:`; `music event` without any."""
    t = F.concat_ws(" . ", _part("music genres: ", F.array_join(genres, " ")), _part("artists: ", F.array_join(artists, " ")), _part("venues: ", F.array_join(venues, " ")))
    return F.when(t == "", "music event").otherwise(t)


def document_text(title: Column, description: Column, venue: Column, quarter: Column, at: Column, low: Column, high: Column) -> Column:
    """An event as a document of lines for search."""
    said = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    lines = [F.concat(F.lit("Event: "), said(title)), F.concat(F.lit("Description: "), F.coalesce(F.nullif(description, F.lit("")), F.lit("No description"))), F.concat(F.lit("Venue: "), said(venue), F.lit(" in "), said(quarter)), F.concat(F.lit("Date: "), said(at)), F.concat(F.lit("Price: "), said(low), F.lit("-"), said(high), F.lit(" DKK"))]
    return F.concat_ws("\n", *lines)
