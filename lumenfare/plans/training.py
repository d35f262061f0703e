"""Registered queries of training sets and ranking quality."""

from pyspark.sql import functions as F

from lumenfare.operators import network as N
from lumenfare.operators import search as H
from lumenfare.operators import recommend as R
from lumenfare.operators import training as T
from lumenfare.plans.query import query
from lumenfare.sources.tables import catalog, interactions, read, sql

_POS = "pos AS (SELECT DISTINCT user_id, event_id FROM interactions WHERE (kind IN ('like','going','went','save') OR COALESCE(rating,0)>=4) AND user_id IN (SELECT user_id FROM interactions GROUP BY user_id HAVING count(*)>=3))"


@query(sql("SELECT DISTINCT user_id, event_id FROM interactions WHERE (kind IN ('like','going','went','save') OR COALESCE(rating,0)>=4) AND user_id IN (SELECT user_id FROM interactions GROUP BY user_id HAVING count(*)>=3)", "interactions"))
def positive_examples(spark, d):
    return T.positives(interactions(spark, d))


@query(sql(f", {_POS}, it AS (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS slot, count(*) OVER () AS n FROM catalog), d AS (SELECT user_id, event_id AS anchor, k, (user_id*7919+event_id*104729+k*15485863)%(SELECT max(n) FROM it) AS slot FROM pos, range(1,11) t(k)), f AS (SELECT d.user_id, anchor, it.event_id, min(k) AS k FROM d JOIN it USING (slot) WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id=d.user_id AND p.event_id=it.event_id) GROUP BY ALL) SELECT DISTINCT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, anchor ORDER BY k) AS r FROM f) WHERE r<=5", "interactions", "catalog"))
def negative_samples(spark, d):
    return T.negatives(T.positives(interactions(spark, d)), catalog(spark, d))


@query(sql(f", {_POS}, un AS (SELECT user_id, c.event_id, row_number() OVER (PARTITION BY user_id ORDER BY c.event_id)-1 AS r, count(*) OVER (PARTITION BY user_id) AS unseen FROM (SELECT DISTINCT user_id FROM pos) u, catalog c WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id=u.user_id AND p.event_id=c.event_id)), m AS (SELECT DISTINCT user_id, unseen FROM un), d AS (SELECT user_id, event_id AS anchor, ((user_id*7919+event_id*104729)%unseen+k*(unseen//least(unseen,5)))%unseen AS r FROM pos JOIN m USING (user_id), range(0,5) t(k) WHERE k<least(unseen,5)) SELECT user_id, anchor, event_id FROM d JOIN un USING (user_id, r)", "interactions", "catalog"))
def exact_negatives(spark, d):
    """Five different unseen events for each positive, or all if there are fewer."""
    return T.exact_negatives(T.positives(interactions(spark, d)), catalog(spark, d))


@query(sql("SELECT id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, id) <= floor(count(*) OVER (PARTITION BY user_id)*0.8::double) THEN 'train' ELSE 'test' END AS part FROM interactions", "interactions"))
def chronological_split(spark, d):
    return T.split(interactions(spark, d).select("id", "user_id", "ts"), "user_id", ["ts", "id"]).select("id", "user_id", "part")


_SCORED = "s AS (SELECT doc_id, quality AS label, (n_chars%1000)::double AS score, source FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.col("n_chars") % 1000).cast("double").alias("score"), "source")


@query(f"WITH {_SCORED}, c AS (SELECT score, sum(label) AS p, sum(1-label) AS q FROM s GROUP BY score), x AS (SELECT *, COALESCE(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS qb, sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(q) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cq FROM c) SELECT round((sum(p*(qb+q/2.0::double))/(sum(p)*sum(q)))::double,6) AS roc_auc, round((sum(p*cp::double/(cp+cq))/sum(p))::double,6) AS pr_auc FROM x")
def auc_scores(spark, d):
    return T.auc(_scored(spark, d), "score", "label").select(F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rp, row_number() OVER (PARTITION BY source ORDER BY label DESC, doc_id) AS rl FROM s) SELECT source, round(sum(CASE WHEN rp<=10 THEN label/log2(rp+1) ELSE 0 END)/sum(CASE WHEN rl<=10 THEN label/log2(rl+1) ELSE 0 END),6) AS ndcg FROM r GROUP BY source HAVING count(*)>=2 AND min(label)<max(label)")
def ndcg_at_10(spark, d):
    return T.ndcg(_scored(spark, d), "source", "score", "label", "doc_id").withColumn("ndcg", F.round("ndcg", 6))


@query(sql("SELECT round(avg(h)/10.0::double,6) AS precision, round(avg(h/n::double),6) AS recall, count(*) AS users, round(2*avg(h)/10.0::double*avg(h/n::double)/(avg(h)/10.0::double+avg(h/n::double)),6) AS f1 FROM (SELECT t.user_id, count(*) AS n, count(r.event_id) AS h FROM (SELECT DISTINCT user_id, event_id FROM interactions WHERE kind='going') t LEFT JOIN (SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_id) AS rank FROM interactions WHERE kind='like' GROUP BY user_id, event_id) WHERE rank<=10) r ON r.user_id=t.user_id AND r.event_id=t.event_id GROUP BY t.user_id)", "interactions"))
def precision_recall_at_10(spark, d):
    """A user's most liked items as recommendations, visited ones as truth."""
    i = interactions(spark, d)
    liked = i.where("kind = 'like'").groupBy("user_id", "event_id").agg(F.count("*").alias("score"))
    truth = i.where("kind = 'going'").select("user_id", "event_id").distinct()
    m = T.at_k(R.top(liked, "score", 10, "event_id", ["user_id"]), truth, "user_id", "event_id", 10)
    return m.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "users")


@query(sql("SELECT user_id, count(*) AS positives, least(count(*), 10) AS kept FROM (SELECT DISTINCT user_id, event_id FROM interactions WHERE kind='like') GROUP BY user_id", "interactions"))
def balanced_counts(spark, d):
    """How many positives of a user a balanced set of ten a user keeps."""
    p = interactions(spark, d).where("kind = 'like'").select("user_id", "event_id").distinct().groupBy("user_id").agg(F.count("*").alias("positives"))
    return p.withColumn("kept", F.least("positives", F.lit(10)))


_EX = "ex AS (SELECT user_id, event_id, max(CASE WHEN kind IN ('like','going','went','save') THEN 1 ELSE 0 END) AS label FROM interactions GROUP BY ALL)"


def _examples(spark, d):
    return interactions(spark, d).groupBy("user_id", "event_id").agg(F.max(F.col("kind").isin("like", "going", "went", "save").cast("int")).alias("label"))


@query(sql(f", {_EX}, t AS (SELECT greatest(10, floor(count(*)/(count(DISTINCT user_id)*2.0)))::int AS target FROM ex), x AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS own, sum(label) OVER (PARTITION BY user_id) AS pos, row_number() OVER (PARTITION BY user_id, label ORDER BY (user_id*7919+event_id*104729)%1000003, event_id) AS place FROM ex, t) SELECT user_id, event_id, label FROM x WHERE own<=target OR CASE WHEN label=1 THEN place<=least(pos,floor(target/2.0)) ELSE place<=target-least(pos,floor(target/2.0)) END", "interactions"))
def balanced_set(spark, d):
    """Positives and negatives of every user, cut to a target a user."""
    return T.balanced(_examples(spark, d))


@query("WITH s AS (SELECT quality AS label, (n_chars%1000)/1000.0::double AS score FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(CASE WHEN score>=0.5 AND label=1 THEN 1 END) AS tp, count(CASE WHEN score>=0.5 AND label=0 THEN 1 END) AS fp, count(CASE WHEN score<0.5 AND label=1 THEN 1 END) AS fn, count(*) AS n FROM s) SELECT round((n-fp-fn)/n::double,6) AS accuracy, round(tp/(tp+fp)::double,6) AS precision, round(tp/(tp+fn)::double,6) AS recall FROM c")
def threshold_scores(spark, d):
    s = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") % 1000 / 1000.0).alias("score"))
    return T.at_threshold(s, "score", "label").select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall")])


@query(sql("SELECT i.id, user_id, kind, len(genres) AS n_genres, price_min, v.name AS venue_name FROM interactions i JOIN catalog c USING (event_id) LEFT JOIN venues v USING (venue_id) WHERE ts >= timestamp '2024-01-15' - to_days(180) AND ts <= timestamp '2024-01-15'", "interactions", "catalog", "venues"))
def enriched_interactions(spark, d):
    from lumenfare.sources.tables import as_of, venues

    return T.enriched(interactions(spark, d), catalog(spark, d), venues(spark, d), as_of()).select("id", "user_id", "kind", F.size("genres").cast("long").alias("n_genres"), "price_min", "venue_name")


@query()
def ranker_weights(spark, d):
    """A logistic ranker of three features, trained on four fifths of every user's examples with early stopping; one row
    a feature. Held against numpy in the tests."""
    e = catalog(spark, d).select("event_id", "popularity", (F.hour("date_time") / 23.0).alias("hour"), F.coalesce(F.col("price_min") / 2000.0, F.lit(0.0)).alias("price"))
    rows = T.split(_examples(spark, d).join(e, "event_id"), "user_id", ["event_id"])
    names = ["popularity", "hour", "price"]
    w, loss = T.train_ranker(rows, names, "label", "part")
    return spark.createDataFrame([(n, float(x), float(loss)) for n, x in zip([*names, "bias"], w)], "feature string, weight double, loss double")


_INPUTS = ["popularity", "hour", "day", "price_low", "price_high", "n_genres", "free", "has_topic"]


def _inputs(spark, d):
    e = catalog(spark, d)
    return e.select("event_id", "popularity", (F.hour("date_time") / 23.0).alias("hour"), (F.weekday("date_time") / 6.0).alias("day"), (F.col("price_min") / 2000.0).alias("price_low"), (F.col("price_max") / 2000.0).alias("price_high"), (F.size("genres") / 5.0).alias("n_genres"), F.col("is_free").cast("double").alias("free"), F.col("topic").isNotNull().cast("double").alias("has_topic"))


@query()
def network_ranking(spark, d):
    """Every event's probability by a network of eight inputs, 64 and 32 units, trained on four fifths of every user's
    examples and stopped early by the others. No SQL can train; the tests hold training against plain steps."""
    rows = T.split(_examples(spark, d).join(_inputs(spark, d), "event_id"), "user_id", ["event_id"])
    w, _ = N.train(rows, _INPUTS, "label", "part", epochs=8, batches=2, patience=3)
    return N.scored(_inputs(spark, d), _INPUTS, [len(_INPUTS), 64, 32, 1], w).select("event_id", "score")


@query()
def settings_search(spark, d):
    """Eight settings of the ranking network by successive halving, best first. No SQL can train; the tests hold the
    search against a loop over trials."""
    rows = T.split(_examples(spark, d).join(_inputs(spark, d), "event_id"), "user_id", ["event_id"])
    found, _ = H.halved(rows, _INPUTS, "label", "part", H.drawn(8), epochs=1, batches=2)
    return spark.createDataFrame([(k, t["trial"], *t["hidden"], t["rate"], t["decay"], t["epochs"], t["loss"]) for k, t in enumerate(found, 1)], "rank long, trial long, units_1 long, units_2 long, rate double, decay double, epochs long, loss double")
