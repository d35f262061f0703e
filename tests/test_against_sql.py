"""Queries against their SQL on small tables that the test tables do not hold."""

import duckdb
from pyspark.sql import functions as F

from lumenfare import registry


def differences(spark, folder, name, **tables):
    """Rows that only the query gives and rows that only its SQL gives, over these tables alone."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = registry.queries()[name](spark, str(folder))
    r = c.execute(registry.oracle_sql()[name])
    at = [[x[0] for x in r.description].index(x) for x in df.columns]
    got, want = sorted(map(str, (tuple(row) for row in df.collect()))), sorted(str(tuple(row[i] for i in at)) for row in r.fetchall())
    return [x for x in got if x not in want], [x for x in want if x not in got], len(got)


def test_lines_with_dates_take_no_word_apart(spark, tmp_path):
    texts = ["lessons", "less ons", "a 12 b", "1 2", "12 May", "may 12", "x 4 maj", "id '4e9feb9cda834", "id \"9feb9cda", "56dec5 aa", "12dec1234ab", "", None, "man", " "]
    docs = spark.createDataFrame([(i * 30 + k, t) for i, t in enumerate(texts) for k in range(30)], "doc_id long, text string")
    natural = F.col("text").isin("12 May", "may 12", "x 4 maj")  # dates of the texts' own, which the SQL knows nothing of
    assert differences(spark, tmp_path, "document_dates", documents=docs.where(~natural | F.col("text").isNull())) == ([], [], 360)


def test_references_without_a_semicolon_stand(spark, tmp_path):
    page = "<html><body><nav><ul><li><a href=\"/a?b=1&copy=2\">x</a></li></ul></nav><article><h1>{}</h1><p>b</p></article></body></html>"
    titles = ["A &amp; B", "Cut short &amp;&amp", "&amp;lt; &lt &quot", "x&amp;#39;", "&nosuch; & 1", ""]
    pages = spark.createDataFrame([(k, page.format(t)) for k, t in enumerate(titles)], "page_id long, html string")
    assert differences(spark, tmp_path, "page_outline", pages=pages) == ([], [], 6)
    from lumenfare.sources.elements import page_nodes

    assert page_nodes("&copy;&#233;&#xE9;&eacute &#233")[0][6] == "©éé&eacute &#233"


def test_trailing_users_are_counted_exactly(spark, tmp_path):
    k = F.col("event_id")
    e = spark.range(40000).withColumnRenamed("id", "event_id").select(k, (F.timestamp_seconds(1704067200 + k * 30).cast("timestamp_ntz")).alias("ts"), F.when(k % 101 > 0, F.xxhash64(k) % 40000).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    assert differences(spark, tmp_path, "trailing_week_users", events=e) == ([], [], 14)


def test_weights_that_cancel_are_not_positive(spark):
    from lumenfare.operators.recommend import training_weights

    # In this order doubles leave 1.1e-16.
    cancel = [("went", 1.0), ("dislike", None), ("dislike", None), ("went", 1.0), ("dislike", None), ("went", 3.0)]
    rows = [(u, 1, *x) for u in range(4) for x in cancel[u:] + cancel[:u]] + [(4, 1, "save", None), (4, 1, "went", 1.0)]
    i = spark.createDataFrame(rows, "user_id long, event_id long, kind string, rating double").coalesce(1)
    assert sorted(map(tuple, training_weights(i).collect())) == [(u, 1, 0.0, False) for u in range(4)] + [(4, 1, 1.1, True)]


def test_pages_with_one_number_are_read_each(spark, tmp_path):
    html = ["<html><body><p>a</p></body></html>", "<p>b", None, "<p>b"]
    pages = spark.createDataFrame([(k, h) for k in range(8) for h in html], "page_id long, html string")
    assert differences(spark, tmp_path, "venue_page_events", pages=pages) == ([], [], 32)
