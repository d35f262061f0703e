"""Registered queries over documents, conversations and pages."""

from pyspark.sql import functions as F

from lumenfare.functions import text as X
from lumenfare.operators import recommend as R
from lumenfare.plans.query import ORACLE, query
from lumenfare.sources import listings as L
from lumenfare.sources.tables import catalog, read, sql, venues

# Fixed values of the registered queries: common words of the test corpus in the place of topic words.
TOPICS = {"tech": ["the", "of", "der"], "nightlife": ["la", "que", "el"], "music": ["les", "des", "est"], "sports": ["und", "nicht", "von"]}
NEGATIVES = {"tech": ["than"]}
STOP = ["the", "and", "that", "der", "die", "und", "les", "des", "que", "los"]
GENRES = ["ring", "house", "tion", "ment", "heit", "rock"]


@query("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,'(https?://|www\\.)[^ \\t\\n\\r]+','','g'),'#([\\pL\\pN_]+)','\\1','g'),'@[\\pL\\pN_]+','','g'),'[!?.,;:*#%&$-]{3,}',' ','g'),'[ \\t\\n\\r]+',' ','g'))) AS cleaned FROM documents")
def clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text,'@([\\pL\\pN_]+)',1), lambda x: lower(x)),',') AS mentions, array_to_string(list_transform(regexp_extract_all(text,'#([\\pL\\pN_]+)',1), lambda x: lower(x)),',') AS hashtags FROM documents")
def hashtags_mentions(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.array_join(X.mentions(t), ",").alias("mentions"), F.array_join(X.hashtags(t), ",").alias("hashtags"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(text,'([0-9]{3})-([0-9]{4})',1),',') AS numbers, len(regexp_extract_all(text,'\\b([0-9]{1,2}:[0-9]{2})',1)) AS n_times FROM documents")
def numbers_times(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.array_join(X.found(t, r"([0-9]{3})-([0-9]{4})"), ",").alias("numbers"), F.size(X.times(t)).cast("long").alias("n_times"))


@query("SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text,'[ \\t\\n\\r]+'), lambda w: length(w)>=3 AND NOT list_contains(['the','and','that','der','die','und','les','des','que','los'],w)),' ') AS kept FROM conversations")
def stopword_strip(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", X.without_stopwords(F.col("text"), STOP).alias("kept"))


@query("SELECT doc_id, array_to_string(list_filter(['ring','house','tion','ment','heit','rock'], lambda k: contains(lower(text),k)),',') AS genres FROM documents")
def genre_keywords(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(X.keywords(F.col("text"), GENRES), ",").alias("genres"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text),'[^\\pL\\pN_ \\t\\n]','','g'),'[ \\t\\n]+',' ','g')) AS title_key FROM documents WHERE lang='en'")
def title_norm(spark, d):
    return read(spark, d, "documents").where("lang = 'en'").select("doc_id", X.title_key(F.col("text")).alias("title_key"))


@query("SELECT doc_id, substring(regexp_replace(trim(string_split_regex(text,'[.!?]')[1]),'^[^\\pL\\pN_]+',''),1,100) AS title FROM documents WHERE lang='en'")
def first_sentence(spark, d):
    return read(spark, d, "documents").where("lang = 'en'").select("doc_id", X.first_sentence(F.col("text")).alias("title"))


@query(sql("SELECT event_id, title || ' . ' || v.name || ' . ' || array_to_string(genres,', ') AS text FROM catalog JOIN venues v USING (venue_id)", "catalog", "venues"))
def embedding_text(spark, d):
    j = catalog(spark, d).join(venues(spark, d), "venue_id")
    return j.select("event_id", X.embedding_text(F.col("title"), F.lit(""), F.col("name"), F.col("genres")).alias("text"))


def _topic_sql() -> str:
    cols = []
    for t, ks in TOPICS.items():
        hits = "+".join([f"CASE WHEN regexp_matches(lower(text),'(^|{X.EDGE}){k}({X.EDGE}|$)') THEN 1.0 ELSE 0.0 END" for k in ks] + [f"CASE WHEN contains(lower(text),'{k}') THEN -0.5 ELSE 0.0 END" for k in NEGATIVES.get(t, [])])
        cols.append(f"({hits})::double AS {t}")
    best = f"greatest({','.join(TOPICS)})"
    arms = " ".join(f"WHEN {t}={best} THEN '{t}'" for t in TOPICS)
    return f"SELECT doc_id, CASE WHEN {best}=0 THEN 'music' {arms} END AS topic, CASE WHEN {best}=0 THEN 0.3 ELSE least({best}/10,1.0) END::double AS confidence FROM (SELECT doc_id, {', '.join(cols)} FROM documents WHERE lang='en')"


def _topics(docs):
    return docs.select("doc_id", X.classified(F.col("text"), TOPICS, NEGATIVES).alias("c")).select("doc_id", "c.topic", "c.confidence")


@query(_topic_sql())
def topic_rules(spark, d):
    return _topics(read(spark, d, "documents").where("lang = 'en'"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(lower(text),'free') OR contains(lower(text),'than') THEN 'free' END, CASE WHEN contains(lower(text),'ring') THEN 'outdoor' END, CASE WHEN contains(lower(text),'heit') OR contains(lower(text),'keit') THEN 'danish' END], lambda x: x IS NOT NULL),',') AS tags FROM documents")
def tag_suggest(spark, d):
    t = X.tags(F.col("text"), F.lit(None).cast("double"), {"outdoor": ["ring"], "danish": ["heit", "keit"]}, ["free", "than"])
    return read(spark, d, "documents").select("doc_id", F.array_join(t, ",").alias("tags"))


@query("SELECT page_id, (unnest(range(len(h))))::int AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html,'<a [^>]*href=\"([^\"]*)\"',1) AS h FROM pages)")
def page_links(spark, d):
    return L.links(read(spark, d, "pages"))


@query("SELECT page_id, regexp_extract(html,'<title>([^<]*)</title>',1) AS title, regexp_extract(url,'://([^/:?#]+)',1) AS host, TRY_CAST(regexp_extract(url,'/([0-9]+)',1) AS BIGINT) AS number FROM pages")
def page_titles(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "://([^/:?#]+)", 1).alias("host"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("number"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'(?is)<script\\b.*?</script>',' ','g'),'(?is)<style\\b.*?</style>',' ','g'),'(?is)<(nav|header|footer)\\b.*?</(nav|header|footer)>',' ','g'),'(?s)<[^>]+>',' ','g'),'[ \\t\\n\\r]+',' ','g')) AS text FROM pages")
def page_visible_text(spark, d):
    return read(spark, d, "pages").select("page_id", L.visible_text(F.col("html")).alias("text"))


@query("SELECT doc_id, pos, block, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS current FROM (SELECT doc_id, pos, block, CASE WHEN length(block)<60 THEN block END AS header FROM (SELECT doc_id, (unnest(range(len(b))))::int AS pos, unnest(b) AS block FROM (SELECT doc_id, string_split(text,chr(10)) AS b FROM documents)))")
def header_carry_forward(spark, d):
    """Short lines stand for date headers that the lines after them inherit."""
    b = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "block"))
    return L.carried(b, "doc_id", "pos", F.when(F.length("block") < 60, F.col("block")))


@query("SELECT doc_id FROM documents WHERE length(text)>=30 AND (contains(lower(text),'tion') OR contains(lower(text),'ment')) AND (contains(lower(text),'heit') OR contains(lower(text),' the ') OR contains(lower(text),'que'))")
def event_like_blocks(spark, d):
    return read(spark, d, "documents").where(L.looks_like_event(F.col("text"), ["tion", "ment"], ["heit", " the "], ["que"])).select("doc_id")


@query("WITH t AS (SELECT doc_id AS id, w AS term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text),'[^a-z]+'), lambda x: length(x)>=3)) AS w FROM documents WHERE lang='en' AND n_chars<1500) GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents WHERE lang='en' AND n_chars<1500), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), x AS (SELECT id, t.term, tf*(ln((1.0+n)/(1.0+df))+1) AS w FROM t JOIN f USING (term), n WHERE df>=2 AND df<=n*0.95) SELECT id, term, round(w/sqrt(sum(w*w) OVER (PARTITION BY id)),6) AS weight FROM x")
def tfidf_vectors(spark, d):
    docs = read(spark, d, "documents").where("lang = 'en' and n_chars < 1500")
    terms = docs.select(F.col("doc_id").alias("id"), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 3).alias("terms"))
    return R.tf_idf(terms).withColumn("weight", F.round("weight", 6))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text),'[^\\pL\\pN_ \\t\\n]','','g'),'[ \\t\\n]+',' ','g')) AS title_key FROM documents")
def title_norm_all(spark, d):
    """title_norm of every document, of whatever language."""
    return read(spark, d, "documents").select("doc_id", X.title_key(F.col("text")).alias("title_key"))


@query("SELECT doc_id, substring(regexp_replace(trim(string_split_regex(text,'[.!?]')[1]),'^[^\\pL\\pN_]+',''),1,100) AS title FROM documents")
def first_sentence_all(spark, d):
    """first_sentence of every document, of whatever language."""
    return read(spark, d, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("title"))


@query(_topic_sql().replace(" WHERE lang='en'", ""))
def topic_rules_all(spark, d):
    """topic_rules of every document, of whatever language."""
    return _topics(read(spark, d, "documents"))


@query(ORACLE["tfidf_vectors"].replace(" WHERE lang='en' AND n_chars<1500", ""))
def tfidf_vectors_all(spark, d):
    """tfidf_vectors of every document, of whatever language and length; document frequencies are of all of them."""
    terms = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 3).alias("terms"))
    return R.tf_idf(terms).withColumn("weight", F.round("weight", 6))
