"""Queries over whole tables against plain versions, where a query beside them reads a part."""

import math
import re
from collections import Counter

import pytest
from lumenfare import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    long = " ".join(f"alpha beta{chr(97 + i % 26)}" for i in range(400))
    rows = [(1, "The alpha. Two", "en"), (2, " «Der» Beta! und", "de"), (3, long, "en"), (4, "alpha les, des", None), (5, "que la beta", "es"), (6, "", "fr")]
    spark.createDataFrame([(i, t, g, "s", len(t)) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d, {i: t for i, t, _ in rows}


def got(spark, folder, name):
    return [r.asDict() for r in registry.queries()[name](spark, folder).collect()]


def test_text_queries_read_every_document(spark, folder):
    d, texts = folder
    keys = {r["doc_id"]: r["title_key"] for r in got(spark, d, "title_norm_all")}
    assert keys == {i: " ".join(re.sub(r"[^a-z0-9_ \t\n]", "", t.lower()).split()) for i, t in texts.items()}
    titles = {r["doc_id"]: r["title"] for r in got(spark, d, "first_sentence_all")}
    assert titles == {i: re.sub(r"^[^A-Za-z0-9_]+", "", re.split(r"[.!?]", t)[0].strip())[:100] for i, t in texts.items()}
    topics = {r["doc_id"]: r["topic"] for r in got(spark, d, "topic_rules_all")}
    assert topics == {1: "tech", 2: "tech", 3: "music", 4: "music", 5: "nightlife", 6: "music"}


def test_tf_idf_of_every_document(spark, folder):
    d, texts = folder
    tf = {i: Counter(w for w in re.split("[^a-z]+", t.lower()) if len(w) >= 3) for i, t in texts.items()}
    df, n, want = Counter(w for c in tf.values() for w in c), len(texts), {}
    for i, c in tf.items():
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items() if 2 <= df[t] <= 0.95 * n}
        size = math.sqrt(sum(x * x for x in w.values()))
        want |= {(i, t): round(x / size, 6) for t, x in w.items()}
    assert {(r["id"], r["term"]): r["weight"] for r in got(spark, d, "tfidf_vectors_all")} == pytest.approx(want, abs=2e-6)
    assert {i for i, _ in want} == {1, 2, 3, 4, 5}


def test_catalogue_queries_read_the_whole_catalogue(spark):
    d = "/root/testdata/sf0.01"  # 2,000 catalogue events
    from lumenfare.sources.tables import catalog, interactions

    events = {r.event_id: r for r in catalog(spark, d).collect()}
    i = interactions(spark, d)
    seen = {r.event_id for r in i.where("user_id = 8").select("event_id").collect()}
    assert {r["event_id"] for r in got(spark, d, "items_not_seen_all")} == set(events) - seen
    top = i.agg({"id": "max"}).first()[0]
    assert sorted((r["id"], r["event_id"]) for r in got(spark, d, "next_ids_all")) == [(top + k, e) for k, e in enumerate(sorted(events), 1)]
    pool = [events[r["event_id"]] for r in got(spark, d, "candidate_pool")]
    assert max(e.event_id for e in pool) >= 100
    want = {}
    for b in pool:
        lost = 0.0
        for a in pool:
            if (a.popularity, -a.event_id) > (b.popularity, -b.event_id):
                x, y = set(a.genres), set(b.genres)
                lost += len(x & y) / len(x | y)
        want[b.event_id] = round(min(1, max(0, b.popularity - 0.05 * lost)), 6)
    assert {r["event_id"]: r["score"] for r in got(spark, d, "diversity_penalty_pool")} == pytest.approx(want, abs=2e-6)
