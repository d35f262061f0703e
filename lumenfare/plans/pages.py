"""Registered queries over the elements of whole pages."""

from pyspark.sql import functions as F

from lumenfare.plans.query import query
from lumenfare.sources import elements as S
from lumenfare.sources.tables import as_of, read

_BODY = "regexp_replace(html, '<(script|style)>.*?</', '<\\1></', 'gs')"
_ARTICLE = "regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
_NAV = "regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')"
_PLAIN = "replace(replace(replace(replace(replace(regexp_extract({0}, '<h1>(.*?)</h1>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(f"SELECT page_id, (len(regexp_extract_all({_BODY}, '<[a-zA-Z]')))::bigint AS n_elements, nullif(trim(regexp_replace({_PLAIN.format(_ARTICLE)}, '\\s+', ' ', 'g')), '') AS title, len(regexp_extract_all({_NAV}, '<a '))::bigint AS n_links, array_to_string(regexp_extract_all({_NAV}, '<a href=\"([^\"]*)\"', 1), ' ') AS links, len(regexp_extract_all({_ARTICLE}, '<p>'))::bigint AS n_paragraphs FROM pages")
def page_outline(spark, d):
    """Elements, heading, paragraphs and navigation of every page, by its parsed elements."""
    return S.outline(read(spark, d, "pages"))


@query("SELECT page_id, (page_id%4+1)::int AS rung, CASE WHEN page_id%4=2 THEN 'The Band ' ELSE 'The band ' END || page_id AS title, make_date(2024,(page_id%6+2)::int,(page_id%28+1)::int)::timestamp + to_hours(20) AS at, CASE WHEN page_id%4<2 THEN (100+page_id%300)::double END AS price, CASE page_id%4 WHEN 2 THEN 'http://v.example/event/the-band-'||page_id||strftime(make_date(2024,(page_id%6+2)::int,(page_id%28+1)::int),'-%Y-%m-%d') WHEN 3 THEN NULL ELSE 'http://t.example/'||page_id END AS url FROM pages")
def venue_page_events(spark, d):
    """Events of every page of `pages` with an announcement put in front of its body's end: data, nested blocks with
    tags left open, a dated link, or a date under a line, each found by its own rung; past events and headings are not."""
    k = F.col("page_id")
    day = F.make_date(F.lit(2024), (k % 6 + 2).cast("int"), (k % 28 + 1).cast("int"))
    months = F.array(*map(F.lit, "februar marts april maj juni juli".split()))
    spelt = F.concat(F.dayofmonth(day).cast("string"), F.lit(". "), F.get(months, (k % 6).cast("int")), F.lit(" 2024"))
    n, price = k.cast("string"), (100 + k % 300).cast("string")
    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    data = said('<script type="application/ld+json">[{"@type":"Place","name":"House"},{"@type":"MusicEvent","name":"The band ', n, '","startDate":"', F.date_format(day, "yyyy-MM-dd"), 'T20:00:00","offers":{"price":"', price, ' kr","url":"http://t.example/', n, '"}},{"@type":"MusicEvent","name":"Past","startDate":"2023-05-01T20:00:00"}]</script>')
    block = said("<div class='events list'><h2>Program</h2><div class='event-card'><div class=event-head><h3>The band ", n, "</h3><p>live<span class=date>", spelt, "</span></div><p class=price>Entré ", price, ' kr<a href="/more">more</a><a class="ticket-link" href="http://t.example/', n, '">Køb</a></div><div class="event-card"><h3>Menu</h3><span class="date">', spelt, "</span></div></div>")
    link = said('<ul><li><a href="http://v.example/event/the-band-', n, F.date_format(day, "-yyyy-MM-dd"), '">more</a><li><a href="/event/gone-2023-01-02">gone</a></ul>')
    lines = said("<section><p>Kalender<p>The band ", n, "<p>", spelt, "</section>")
    put = F.element_at(F.array(data, block, link, lines), (k % 4 + 1).cast("int"))
    pages = read(spark, d, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), put).alias("html"))
    return S.laddered_events(pages, as_of(), 366)
