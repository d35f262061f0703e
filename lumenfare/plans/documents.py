"""Registered queries that read facts and dates from whole texts of `documents`."""

from pyspark.sql import functions as F

from lumenfare.functions import dates
from lumenfare.functions import extract as E
from lumenfare.functions import text as X
from lumenfare.plans.notices import DANISH, ENGLISH, ENGLISH_DAYS, NOW, _pick
from lumenfare.plans.query import query
from lumenfare.sources.tables import as_of, read


def _quoted(words) -> str:
    return ",".join("'" + w.replace("'", "''") + "'" for w in words)


def _hits(text: str, pattern: str, group: int = 1) -> str:
    return f"list_transform(regexp_extract_all({text},'{pattern}',{group}), lambda x: trim(x))"


def _first_of(text: str, patterns: list[str], low: int, high: int) -> str:
    return f"COALESCE({', '.join(f'list_filter({_hits(text, p)}, lambda x: length(x) BETWEEN {low} AND {high})[1]' for p in patterns)})"


# RE2's \b and \w know ASCII only: other characters become _, a character of words that no pattern of names takes.
_PLAIN = r"regexp_replace(text,'[^\x00-\x7F]','_','g')"
_NAME = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
_STOP = r"(?:\s|,|\.)"
_CATEGORY = " ".join(f"WHEN {' OR '.join(f'contains(low,{_quoted([w])})' for w in words)} THEN '{c}'" for c, words in E.CATEGORIES.items())
_VENUE = _first_of("text", [rf"(?i)at\s+([A-Z][^.!?]+?){_STOP}", rf"(?i)venue:\s*([^.!?]+?){_STOP}", rf"(?i)location:\s*([^.!?]+?){_STOP}", rf"(?i)(@\s*[A-Z][^.!?]+?){_STOP}"], 3, 49)
_PHRASE = _first_of("text", [r"(?i)(free|gratis)", r"(?i)([0-9]+\s*(?:kr|dkk|€|\$))", r"(?i)(price:\s*[^.!?]+)", r"(?i)(admission:\s*[^.!?]+)", r"(?i)(tickets?:\s*[^.!?]+)"], 1, 1 << 30)
_ARTISTS = f"list_filter(flatten([{', '.join(_hits('plain', f'(?i){p}') for p in (rf'featuring\s+({_NAME})', rf'with\s+({_NAME})', rf'({_NAME})\s+live', rf'({_NAME})\s+concert'))}]), lambda x: length(x)>2 AND NOT list_contains([{_quoted(E.NO_ARTISTS)}],x))"
_UNIQUE = "list_filter(artists, lambda x, i: list_position(artists,x)=i)[1:5]"


@query(rf"WITH t AS (SELECT doc_id, COALESCE(text,'') AS text FROM documents), u AS MATERIALIZED (SELECT doc_id, text, lower(text) AS low, {_PLAIN} AS plain FROM t), f AS (SELECT doc_id, CASE {_CATEGORY} ELSE 'cultural' END AS category, array_to_string(list_sort(list_filter([{_quoted(E.GENRES)}], lambda g: contains(low,g))),',') AS genres, {_VENUE} AS venue, {_PHRASE} AS price_phrase, NULLIF(regexp_extract(replace(replace(low,',',''),'.',''),'([0-9]+)\s*kr',1),'')::double AS price, {_ARTISTS} AS artists, len(regexp_extract_all(plain,'\b{_NAME}\b')) AS n_names FROM u) SELECT doc_id, category, genres, venue, price_phrase, price, array_to_string({_UNIQUE},',') AS artists, n_names FROM f")
def document_facts(spark, d):
    """Category, genres, venue, price, artists and the number of runs of capitalised words of every whole text; a null
    text is empty. Each fact is an expression over one row, so nothing is shuffled. Artists' names are of ASCII letters,
    and what follows one in another script belongs to its word."""
    t = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("plain", F.regexp_replace("text", r"[^\x00-\x7F]", "_"))
    x, plain = F.col("text"), F.col("plain")
    return t.select("doc_id", E.category(x).alias("category"), F.array_join(E.genres_in(x), ",").alias("genres"), E.venue_in(x).alias("venue"), E.price_phrase(x).alias("price_phrase"), E.price_in_kroner(x).alias("price"), F.array_join(E.artists_in(plain), ",").alias("artists"), F.size(E.capitalised(plain)).cast("long").alias("n_names"))


#: A line with a date stands in the middle of each text, of one of ten forms by the document's number: behind the word
#: that holds the middle, and between marks that no reader reads over, so that it takes no word apart and joins none.
_D, _M, _Y = "(doc_id%28+1)::int", "(doc_id%12+1)::int", "(2024+doc_id%3)::int"
_DAY = f"make_date({_Y},{_M},{_D})::timestamp"
_NEXT = f"({NOW}+to_days((CASE WHEN doc_id%7=0 THEN 7 ELSE doc_id%7 END)::int))"
_EARLY = f"make_date(CASE WHEN {_M}=1 AND {_D}<15 THEN 2025 ELSE 2024 END,{_M},{_D})::timestamp"
_WEEKDAY = "CASE " + " ".join(f"WHEN contains(low,'{w}') THEN {k}" for w, k in dates.WEEKDAYS.items()) + " END"


def _dated(spark, d):
    """Documents with their line: two Danish forms, two English ones, three of digits, and three of words."""
    k = F.col("doc_id")
    day, month, year = (k % 28 + 1).cast("int"), (k % 12 + 1).cast("int"), (2024 + k % 3).cast("int")
    two = F.lpad(month.cast("string"), 2, "0")
    da, en = _pick(DANISH, month), _pick(ENGLISH, month)
    forms = [F.concat(day, F.lit(". "), da, F.lit(" "), year), F.concat(day, F.lit(". "), F.substring(da, 1, 3), F.lit(" ...")), F.concat(day, F.lit(" "), en, F.lit(" "), year), F.concat(en, F.lit(" "), day, F.lit("th "), year), F.concat_ws(".", day, month, year), F.concat_ws("/", day, month, year), F.concat_ws("-", year, two, F.lpad(day.cast("string"), 2, "0")), F.concat(F.lit("every "), _pick(ENGLISH_DAYS, (k % 7 + 1).cast("int"))), F.lit("Tonight"), F.lit("tomorrow")]
    line = F.element_at(F.array(*forms), (k % 10 + 1).cast("int"))
    t = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(t) / 2).cast("int")
    split = half + F.length(F.regexp_extract(F.substring(t, half + 1, F.length(t)), r"^\S*", 0))
    whole = F.concat(F.substring(t, F.lit(1), split), F.lit("\n* "), line, F.lit(" *\n"), F.substring(t, split + 1, F.length(t)))
    return read(spark, d, "documents").select("doc_id", whole.alias("text"))


@query(f"WITH t AS (SELECT doc_id, lower(COALESCE(text,'')) || CASE doc_id%10 WHEN 7 THEN ' ' || [{_quoted(w.lower() for w in ENGLISH_DAYS)}][(doc_id%7+1)::int] WHEN 2 THEN ' ' || lower([{_quoted(ENGLISH)}][{_M}]) WHEN 3 THEN ' ' || lower([{_quoted(ENGLISH)}][{_M}]) ELSE '' END AS low FROM documents), w AS (SELECT doc_id, {_WEEKDAY} AS day FROM t) SELECT doc_id, CASE doc_id%10 WHEN 0 THEN {_DAY}+to_hours(20) WHEN 1 THEN {_EARLY}+to_hours(20) WHEN 2 THEN {_DAY}+to_hours(20) ELSE {NOW}+to_days((CASE WHEN day=0 THEN 7 ELSE day END)::int) END AS announced, CASE doc_id%10 WHEN 0 THEN make_date(2024,{_M},20)::timestamp WHEN 2 THEN {_DAY} WHEN 3 THEN {_DAY} WHEN 8 THEN {NOW} WHEN 9 THEN {NOW}+to_days(1) END AS header, CASE doc_id%10 WHEN 4 THEN strftime({_DAY},'%Y-%m-%d %H') WHEN 5 THEN strftime({_DAY},'%Y-%m-%d %H') WHEN 6 THEN strftime({_DAY},'%Y-%m-%d %H') WHEN 7 THEN strftime({_NEXT},'%Y-%m-%d %H') WHEN 8 THEN '2024-01-15 20' WHEN 9 THEN '2024-01-16 00' ELSE '' END AS times FROM w")
def document_dates(spark, d):
    """Dates of every whole text by three readers. A weekday's abbreviation within any word counts as one for the reader
    of announcements, as its rule is; the reader of headings takes `1. maj 2025` for the 20th of May, as its rule is. The
    other words of a text must disturb nobody."""
    t, now = _dated(spark, d), as_of()
    times = F.array_join(F.transform(dates.dates_in(F.col("text"), now), lambda x: F.date_format(x, "yyyy-MM-dd HH")), ",")
    return t.select("doc_id", dates.announced_date(F.col("text"), now).alias("announced"), dates.header_date(F.col("text"), now).alias("header"), times.alias("times"))


@query(f"WITH t AS (SELECT doc_id, lower(COALESCE(text,'')) || ' ' || array_to_string([x[2:] FOR x IN regexp_extract_all(COALESCE(text,''),'#[\\p{{L}}\\p{{N}}_]+')],' ') AS low FROM documents) SELECT doc_id, array_to_string(list_filter([{_quoted(E.POST_GENRES)}], lambda g: contains(low,g)),',') AS genres FROM t")
def document_post_genres(spark, d):
    """Genres of whole texts and their hashtags by the list for posts."""
    return read(spark, d, "documents").select("doc_id", F.array_join(E.post_genres(F.col("text"), X.hashtags(F.coalesce("text", F.lit("")))), ",").alias("genres"))
