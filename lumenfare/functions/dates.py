"""Times relative to a stated moment, and dates read from text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month beginnings in Danish and English, in calendar order.
MONTHS = ["jan", "feb", "mar", "apr", "maj", "jun", "jul", "aug", "sep", "okt", "nov", "dec"]
ENGLISH = {"may": 5, "oct": 10}
PRESETS = ("today", "tomorrow", "this_week", "this_weekend", "next_week", "this_month")


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def days_until(at: Column, now: Column) -> Column:
    """Whole days of 24 hours, rounded down, so that an hour ago is -1."""
    return F.floor((micros(at) - micros(now)) / F.lit(86400000000)).cast("long")


def preset_bounds(preset: str, now: Column) -> tuple[Column, Column]:
    """First and last moment of a date preset (exclusive end), in calendar days from `now`; weeks begin on Monday."""
    day = F.date_trunc("day", now.cast("timestamp")).cast("timestamp_ntz")
    week = F.weekday(now)
    at = lambda n: day + F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))
    if preset == "today":
        return day, at(1)
    if preset == "tomorrow":
        return at(1), at(2)
    if preset == "this_week":
        return day, at(7 - week)
    if preset == "this_weekend":
        return at(F.greatest(5 - week, F.lit(0))), at(7 - week)
    if preset == "next_week":
        return at(7 - week), at(14 - week)
    if preset == "this_month":
        return day, F.add_months(F.trunc(now.cast("date"), "month"), 1).cast("timestamp_ntz")
    raise ValueError(f"no such preset: {preset}")


def next_weekday(now: Column, target: int) -> Column:
    """The next date of a weekday (Monday 0), never the day itself."""
    ahead = F.pmod(F.lit(target) - F.weekday(now), F.lit(7))
    return F.date_add(now.cast("date"), F.when(ahead == 0, 7).otherwise(ahead).cast("int"))


def month_number(name: Column) -> Column:
    """Number of a Danish or English month by its first three letters, null for other words."""
    pairs = [x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))] + [x for m, i in ENGLISH.items() for x in (F.lit(m), F.lit(i))]
    return F.create_map(*pairs)[F.substring(F.lower(name), 1, 3)]


def text_date(text: Column, now: Column, hour: int = 20) -> Column:
    """The first of: ISO date; `17. sep 2025`; `17. sep` (next year's if past); today or tonight; tomorrow; at `hour`."""
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    full = r"(\d{1,2})\.?\s+([A-Za-zæøå]{3,9})\.?\s+(\d{4})"
    short = r"(\d{1,2})\.?\s+([A-Za-zæøå]{3,9})"

    def made(pattern: str, year: Column) -> Column:
        day, month = F.regexp_extract(text, pattern, 1), month_number(F.regexp_extract(text, pattern, 2))
        return F.try_to_timestamp(F.format_string("%s-%02d-%s", year, month, F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))

    this = made(short, F.year(now).cast("string"))
    rolled = F.when(this.cast("date") < now.cast("date"), made(short, (F.year(now) + 1).cast("string"))).otherwise(this)
    word = F.when(text.rlike(r"(?i)\b(today|tonight|i dag|i aften)\b"), now.cast("date")).when(text.rlike(r"(?i)\b(tomorrow|i morgen)\b"), F.date_add(now.cast("date"), 1))
    found = F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")), made(full, F.regexp_extract(text, full, 3)), rolled, word.cast("timestamp"))
    return F.date_trunc("day", found).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))


# Weekdays as announcements write them, each with its number from Monday, in the order they are looked for.
WEEKDAYS = {"mandag": 0, "man": 0, "monday": 0, "tirsdag": 1, "tir": 1, "tuesday": 1, "onsdag": 2, "ons": 2, "wednesday": 2, "torsdag": 3, "tor": 3, "thursday": 3, "fredag": 4, "fre": 4, "friday": 4, "lørdag": 5, "lør": 5, "saturday": 5, "søndag": 6, "søn": 6, "sunday": 6}
# Month names of both languages.
MONTH_NAMES = {"januar": 1, "january": 1, "februar": 2, "february": 2, "marts": 3, "march": 3, "april": 4, "maj": 5, "may": 5, "juni": 6, "june": 6, "juli": 7, "july": 7, "august": 8, "september": 9, "sept": 9, "oktober": 10, "october": 10, "november": 11, "december": 12}
_MONTHS = MONTH_NAMES | {m: i + 1 for i, m in enumerate(MONTHS)} | ENGLISH


def month_of(name: Column) -> Column:
    """Number of a month's whole name or usual abbreviation, null for other words."""
    return F.create_map(*[F.lit(x) for kv in _MONTHS.items() for x in kv])[F.lower(name)]


def _date(year: Column, month: Column, day: Column) -> Column:
    """A date of numbers; null where there is no such day."""
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")), F.lit("yyyy-MM-dd")).cast("date")


def _matches(text: Column, pattern: str, groups: int) -> Column:
    """All matches in order as structs g1, g2, ...; groups without a match are empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), k).alias(f"g{k}") for k in range(1, groups + 1)])


def _number(x: Column) -> Column:
    return F.nullif(x, F.lit("")).try_cast("int")


def _first(matches: Column, made) -> Column:
    """The first match that makes a date."""
    return F.get(F.filter(F.transform(matches, made), lambda x: x.isNotNull()), F.lit(0))


def _at(day: Column, hour: int) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))


def announced_date(text: Column, now: Column, hour: int = 20) -> Column:
    """The first rung that holds: `17. sep 2025`; `17. sep`, next year's if past; a weekday, the next one and never
    today. Days of months begin at `hour`, weekdays keep the time of now. A day and what ends its date stand at the ends
    of words, so that 4e9feb9c is no 9th of February."""
    full = lambda low: _first(_matches(low, r"(?<![\p{L}\p{N}])(\d{1,2})\.?\s*([a-zæøå]+)\.?\s*(\d{4})(?![\p{L}\p{N}])", 3), lambda m: _date(_number(m["g3"]), month_of(m["g2"]), _number(m["g1"])))

    def rolled(m: Column) -> Column:
        month, day = month_of(m["g2"]), _number(m["g1"])
        past = (month < F.month(now)) | ((month == F.month(now)) & (day < F.day(now)))
        return _date(F.year(now) + F.when(past, 1).otherwise(0), month, day)

    short = lambda low: _first(_matches(low, r"(?<![\p{L}\p{N}])(\d{1,2})\.?\s*([a-zæøå]+)(?![\p{L}\p{N}]|\s*\d{4})", 2), rolled)
    weekday = lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(name)), F.lit(k)) for name, k in WEEKDAYS.items()])
    ahead = lambda low: F.pmod(weekday(low) - 1 - F.weekday(now), F.lit(7)) + 1
    found = lambda low: F.coalesce(_at(full(low), hour), _at(short(low), hour), now + F.make_dt_interval(ahead(low).cast("int")))
    return F.get(F.transform(F.array(F.lower(F.trim(text))), found), F.lit(0))


def header_date(text: Column, now: Column) -> Column:
    """The date that a heading names: `15 September 2025`, `15 of September`, `September 15th 2025` (this year if none is
    named); today and tonight now, tomorrow a day later, this weekend on Saturday, at the time of now. Months in digits
    name no date."""
    low = F.lower(F.trim(text))
    made = lambda y, m, d: _date(F.coalesce(_number(y), F.year(now)), month_of(m), _number(d))
    day_first = _first(_matches(low, r"(\d{1,2})\s+(?:of\s+)?([a-z]+)(?:\s+(\d{4}))?", 3), lambda m: made(m["g3"], m["g2"], m["g1"]))
    month_first = _first(_matches(low, r"([a-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:\s+(\d{4}))?", 3), lambda m: made(m["g3"], m["g1"], m["g2"]))
    later = lambda n: now + F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))
    words = F.when(F.contains(low, F.lit("today")) | F.contains(low, F.lit("tonight")), now).when(F.contains(low, F.lit("tomorrow")), later(1)).when(F.contains(low, F.lit("this weekend")), later(F.pmod(5 - F.weekday(now), F.lit(7)).cast("int")))
    return F.coalesce(day_first.cast("timestamp_ntz"), month_first.cast("timestamp_ntz"), words)


def dates_in(text: Column, now: Column) -> Column:
    """All times that a text names, kind by kind: 15.09.2025, 15/09/2025, 2025-09-15, Danish and English weekdays (the
    next one), today and i dag at 20, tomorrow, tonight at 20, this weekend (Friday)."""
    midnight = lambda d: d.cast("timestamp_ntz")
    day_first = lambda m: midnight(_date(_number(m["g3"]), _number(m["g2"]), _number(m["g1"])))
    year_first = lambda m: midnight(_date(_number(m["g1"]), _number(m["g2"]), _number(m["g3"])))
    later = lambda n: now + F.make_dt_interval(n.cast("int"))

    def next_one(word: Column) -> Column:
        ahead = F.pmod(F.create_map(*[F.lit(x) for kv in WEEKDAYS.items() for x in kv])[F.lower(word)] - F.weekday(now), F.lit(7))
        return later(F.when(ahead == 0, 7).otherwise(ahead))

    whole = [[n for n in WEEKDAYS if len(n) > 3 and n.endswith(end)] for end in ("dag", "day")]
    evening = F.date_trunc("day", now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(20))
    words = lambda pattern, value: F.transform(F.regexp_extract_all(text, F.lit(rf"(?iu)\b({pattern})\b"), 1), value)
    found = F.concat(
        F.transform(_matches(text, r"(\d{1,2})\.(\d{1,2})\.(\d{4})", 3), day_first),
        F.transform(_matches(text, r"(\d{1,2})/(\d{1,2})/(\d{4})", 3), day_first),
        F.transform(_matches(text, r"(\d{4})-(\d{1,2})-(\d{1,2})", 3), year_first),
        *[words("|".join(names), next_one) for names in whole],
        words("i dag|today", lambda x: evening),
        words("i morgen|tomorrow", lambda x: later(F.lit(1))),
        words("i aften|tonight", lambda x: evening),
        words("denne weekend|this weekend", lambda x: later(F.pmod(4 - F.weekday(now), F.lit(7)))),
    )
    return F.filter(found, lambda x: x.isNotNull())
