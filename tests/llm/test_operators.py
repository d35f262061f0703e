"""Training-data operators against brute force, on awkward rows and on the smallest tables."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfare.llm import audio, html_text, jaccard_join, mixing, packing, pii, quality_rules, token_counts, token_store, toxicity
from lumenfare.llm.common import connected_components, forest_roots, prepare, shared_path
from lumenfare.llm.queries import tokenizer

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score int, uid int, cls int, hash int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(*texts):
    """Odd documents: nulls in any column, repeated rows, clashing column names, a null id."""
    out = [(i, t, None if i % 3 else "en", None if i % 2 else "a", None, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]
    return [*out, out[0], (None, texts[0], "en", "b", 1, 1, 2, 3, 4, 5), (99, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    return spark.createDataFrame(rows("", " ", "one two", "a b c d e f g h i j k l m n o p q r s t", "A b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s u", long, long + " end", "é à ü 你好 𝔘"), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def sets(texts):
    out = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components(ids, texts, percent=80):
    s, up = sets(texts), list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(s[i] & s[j])
        if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both) or ids[i] == ids[j] and ids[i] is not None:
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    out = []
    for i in range(len(texts)):
        group = [ids[j] for j in range(len(texts)) if top(j) == top(i) and ids[j] is not None]
        out.append((ids[i], len(s[i]), (min(group) if group else None) if s[i] else ids[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_jaccard_join_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    p = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in jaccard_join.similar_documents(df).collect()], key=str)
    assert got == components([a for a, _ in p], [b for _, b in p])


def test_jaccard_join_of_chains(spark):
    """Links that only meet through others, across components of the first round, with many near copies of two texts."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):
        words = [w if rng.random() > 0.02 else f"v{k}x{j}" for j, w in enumerate(words)]
        texts.append(" ".join(words[int(rng.integers(0, 3)) :]))
    texts += [" ".join(f"z{i}" for i in range(80 - k % 6)) for k in range(25)] + texts[5:9]
    ids = [int(i) for i in rng.permutation(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    assert sorted([tuple(r) for r in jaccard_join.similar_documents(df).collect()], key=str) == components(ids, texts)


def test_sets_of_texts_that_cannot_link_do_not_move(spark, monkeypatch):
    """Texts with two fifths in common meet in their prefixes, yet only the two near ones are held against each other."""
    texts = []
    for k in range(20):
        texts += [" ".join([f"c{k}x{i}" for i in range(124)] + [f"{side}{k}x{i}" for i in range(180)]) for side in "lr"]
    texts += [" ".join(f"n{i}" for i in range(304 - k)) for k in range(2)]
    pairs, stored = [], jaccard_join.stored

    def watched(df):
        out = stored(df)
        if out.columns == ["a", "b"]:  # candidates, then links, of both rounds
            pairs.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", watched)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted([tuple(r) for r in jaccard_join.similar_documents(df).collect()], key=str) == components(list(range(len(texts))), texts)
    assert pairs == [1, 1, 0, 0]


@pytest.mark.parametrize("percent", [20, 80])
def test_parities_never_differ_more_than_sets(percent):
    """Whatever the sizes, and where one set's classes are folded to those of the other."""
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 128, 129, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, n * percent // 100)], rng.integers(0, 1 << 64, n // 5, dtype=np.uint64)]))
        x, y = (jaccard_join._parities(s) for s in (a, b))
        while len(x) != len(y):
            x, y = (v[: len(v) // 2] ^ v[len(v) // 2 :] if len(v) > len(w) else v for v, w in ((x, y), (y, x)))
        assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_links_of_small_shares_at_folded_sizes(spark):
    """A low percentage links sets of which one has several times as many classes as the other."""
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (70, 150, 400, 1500)] + [" ".join(f"v{i}" for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted([tuple(r) for r in jaccard_join.similar_documents(df, 20).collect()], key=str)
    assert got == components(list(range(len(texts))), texts, 20)


def test_keep_one_keeps_columns(odd):
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {3, 99, None} <= set(ids) and 4 not in ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_keep_one_row_of_each_id(spark):
    words = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(5)]
    rows = [(1, words[0]), (1, words[0]), (2, words[1]), (2, words[2]), (3, words[2]), (4, words[3]), (None, words[3]), (5, ""), (5, None)]
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert [i for i, _ in got] == [1, 2, 4, 5, None] or sorted(str(i) for i, _ in got) == sorted(["1", "2", "4", "5", "None"])


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 20)] + [(30, 31), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_forest_roots(spark):
    parents = [(i, i - 1) for i in range(1, 40)] + [(100 + i, 100) for i in range(1, 5)] + [(60, 3)]
    got = {r.node: r.component for r in forest_roots(spark.createDataFrame(parents, "node long, parent long")).collect()}
    assert got == {**{i: 0 for i in range(40)}, 60: 0, **{100 + i: 100 for i in range(5)}}
    assert forest_roots(spark.createDataFrame([], "node long, parent long")).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_packing(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    got = packing.pack_documents(df, tokenizer("byte_bpe_50k.json")).toPandas()
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        cut = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    have = [tuple(None if v is None or v != v else int(v) for v in x) for x in got[cols].astype(object).values.tolist()]
    assert sorted(have, key=str) == sorted(want, key=str)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400)
    empty = np.full(400, -1, np.int32)
    a, b = (packing.best_fit(sizes, empty, rng.permutation(400), 100) for _ in range(2))
    child = packing.crossover(sizes, a, b, 100, rng)
    assert (child >= 0).all() and np.bincount(child, sizes).max() <= 100
    best = packing.evolve(sizes, [], 100, rng)
    assert best.max() <= a.max()


@pytest.mark.parametrize("low, high", [(400, 700), (500, 1000)])
def test_evolution_beats_its_starts_on_hard_sizes(low, high):
    sizes = np.random.default_rng(1).integers(low, high, 4000)
    fit = packing.best_fit(sizes, np.full(4000, -1, np.int32), np.argsort(-sizes, kind="stable"), 2048)
    full = packing.filled(sizes, 2048, np.random.default_rng(2))
    best = packing.evolve(sizes, [], 2048, np.random.default_rng(2))
    for p in (fit, full, best):
        assert (p >= 0).all() and np.bincount(p, sizes).max() <= 2048
    assert best.max() + 4 <= min(fit.max(), full.max())


@pytest.mark.parametrize("seed", range(5))
def test_filled_bins_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, rng.integers(3, 60), int(rng.integers(1, 80)))
    bins = packing.filled(sizes, 60, rng)
    assert np.bincount(bins, sizes).max() <= 60 and set(bins) == set(range(bins.max() + 1))


def test_islands_pack_hard_sizes_in_blocks(spark, monkeypatch):
    """Blocks, migration and meetings on sizes where best fit is far from good."""
    monkeypatch.setattr(packing, "BLOCK", 400)
    sizes = [int(x) for x in np.random.default_rng(3).integers(300, 1100, 1200)]
    got = packing.pack(spark.createDataFrame([(n, i) for i, n in enumerate(sizes)], "length long, seq long")).toPandas()
    assert len(got) == 1200 and got.groupby("sequence_id").length.sum().max() <= 2048 and sorted(got.length) == sorted(sizes)
    fit = packing.best_fit(np.array(sizes), np.full(1200, -1, np.int32), np.argsort(-np.array(sizes), kind="stable"), 2048).max() + 1
    assert got.sequence_id.nunique() < fit


def test_token_counts_equal_library(docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = token_counts.sentencepiece_vocabulary(tokenizer("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *v], unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c = token_counts.Counter(v)
    for text in ["", " a", "a  b ", "日本語 𝔘𝔘x", "a\n\nb", *[r.text for r in docs.limit(60).collect()]]:
        assert c.count(text) == len(t.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(odd):
    """Nulls, blanks, repeats and clashing columns through Spark: a row each."""
    v = token_counts.sentencepiece_vocabulary(tokenizer("piece_bpe_32k.model"))
    c = token_counts.Counter(v)
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd.withColumn("n_tokens", F.lit("x")), v).collect()), key=str)
    assert got == sorted(((r.doc_id, c.count(r.text or "")) for r in odd.collect()), key=str)


def test_counts_of_tied_paths():
    from tokenizers import Tokenizer, models

    v = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0), ("▁", 0.0), ("bc", -2.0)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *v], unk_id=0, byte_fallback=False))
    c = token_counts.Counter(v)
    for text in ["ab", "abc", "abcabc", "xxab", "cxxc", "bcab"]:
        assert c[text] == len(t.encode(text, add_special_tokens=False).ids)


def test_toxicity_finds_sentences(spark):
    good = [f"plain words number {i} stand here. And more of them follow now." for i in range(60)]
    bad = [f"plain words number {i} stand here. You zorgling fool. And more of them follow now." for i in range(60)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (None, "zorgling")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    r = {x.doc_id: x for x in toxicity.score(d, labels).collect()}
    assert all(r[i].predicted == int(i >= 60) for i in range(120))
    a, b = map(int, r[70].offending.split(",")[0].split(":"))
    assert "zorgling" in bad[10][a:b]
    assert r[500].score == r[501].score == 0 and r[None].predicted == 1
    assert r[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert toxicity.reject(d, labels).columns == d.columns


def test_toxicity_sample_is_bounded_by_ids(spark):
    """Repeated ids stand once in the sample, under one text, in whatever order the rows come."""
    rows = [(i, f"calm words number {i} here.") for i in range(1, 60)] + [(i, f"a vile slur {i}. calm words.") for i in range(60, 90)]
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(1, 90)], "doc_id long, toxic int")
    more = rows + [(60, "a")] * 300
    plain, again, back = (toxicity.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, more, more[::-1]))
    assert plain.weights == again.weights == back.weights and plain.bias == again.bias == back.bias and plain.weights


def test_toxicity_of_words_at_sentence_marks(spark):
    """A word counts alike before a mark, joined to the next word by one, and in the middle of a sentence."""
    bad = ["You zorgling fool.", "You are a zorgling.", "Such a zorgling! Go home.", "Is it a zorgling?", "A zorgling.you see.", "Go home.zorgling"]
    d = spark.createDataFrame([(i, f"plain words number {i} stand here. {bad[i % 6] if i >= 60 else 'More of them.'} Calm ones follow.") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    m = toxicity.fit(d, labels)
    for s in bad:
        total, found = m.score(s)
        assert total >= toxicity.THRESHOLD and any("zorgling" in s[a:b] for a, b in found)
    assert m.score("Calm words. More of them follow!") == (m.score("Calm words. x!")[0], [])
    # a word that only ever stands behind a mark without a space is learned too
    d = spark.createDataFrame([(i, f"plain words{i}.{'vargling' if i >= 60 else 'calm'} here") for i in range(120)], "doc_id long, text string")
    assert toxicity.fit(d, labels).score("vargling here")[0] >= toxicity.THRESHOLD


def test_toxicity_of_odd_tables(odd, none, spark):
    """Empty tables and columns named like outputs: score and reject keep a row each and the columns given."""
    labels = spark.createDataFrame([(i, int(i > 3)) for i in range(7)], "doc_id long, toxic int")
    clash = odd.withColumns({"score": F.lit("x"), "predicted": F.lit(7), "held_out": F.lit(None).cast("string"), "toxic": F.lit(9)})
    got = toxicity.score(clash, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    kept = toxicity.reject(clash, labels)
    assert kept.columns == clash.columns and all(r.score == "x" for r in kept.collect())
    assert toxicity.score(none, labels).count() == 0 and toxicity.reject(none, labels).count() == 0


def test_toxicity_without_labels(odd, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(odd, empty).where("predicted = 1").count() == 0
    assert toxicity.reject(odd, empty).count() == odd.count()


def plain_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base_spans(docs):
    odd = ["a@b@c.d", "x@y.z@w.v", "@a.b", "a@@b.c", "1.2.3.4.5.6.7.8", "0000000001.2.3.4", "256.1.1.1", "+1 2 3 4 5 6 7 8 9", "4111-1111-1111-1111 1", "9" * 5000, "a" * 5000]
    for t in [*odd, *[r.text for r in docs.collect()]]:
        assert pii.base_spans(t) == plain_pii(t)


def test_pii_field_adds_and_leaves_alone(odd):
    field = pii.trained()
    s = "mail bob [at] example [dot] com or call (555) 123-4567 now, version 3.1.2 of 2024-01-02"
    base, every = pii.all_spans(s, field)
    assert not base and [(k, s[a:b]) for k, a, b in every] == [("email", "bob [at] example [dot] com"), ("phone", "(555) 123-4567")]
    r = pii.find(odd).collect()
    assert len(r) == odd.count() and all(x.spans == "" for x in r)
    assert pii.redact(odd).columns == odd.columns


@pytest.mark.parametrize("text, want", [
    ("alice.smith@example.org or bob [at] x [dot] org", ["alice.smith@example.org", "bob [at] x [dot] org"]),
    ("bob [at] x [dot] org or alice.smith@example.org", ["bob [at] x [dot] org", "alice.smith@example.org"]),
    ("write to averylongfirstnameindeed_averylonglastname [at] example [dot] org today", ["averylongfirstnameindeed_averylonglastname [at] example [dot] org"]),
    ("write to bob [at] averyveryveryverylongdomainnameindeed [dot] org today", ["bob [at] averyveryveryverylongdomainnameindeed [dot] org"]),
    ("averylongfirstnameindeed_averylong at example dot org", ["averylongfirstnameindeed_averylong at example dot org"]),
    ("averyveryverylonglocalpartname.withmoretext_andmore [at] example [dot] com", ["averyveryverylonglocalpartname.withmoretext_andmore [at] example [dot] com"]),
    ("to bob.middle.last [at] mail.example [dot] co [dot] uk or so", ["bob.middle.last [at] mail.example [dot] co [dot] uk"]),
    ("mail bob at example dot com", ["bob at example dot com"]),
    ("call 020 7946 0958 now", ["020 7946 0958"]),
])
def test_pii_windows_hold_whole_segments(text, want):
    field = pii.trained()
    assert sorted(text[a:b] for _, a, b in pii.all_spans(text, field)[1]) == sorted(want)
    for low, high, first, end in pii.windows(text):
        assert 0 <= low <= first < end <= high <= len(text)
        assert not text[max(0, low - 1) : low + 1].isalnum() or low == 0
        assert high == len(text) or not text[high - 1 : high + 1].isalnum()
    assert not any(x in pii.hidden(text, field) for x in ("bob", "alice", "averylong", "averyvery"))


def test_pii_added_spans_on_held_out_windows():
    """Precision and recall of the field's spans on generated windows that it was not trained on."""
    field, right, found, gold = pii.trained(), 0, 0, 0
    for text, want in pii.examples(300, 4321):
        base, every = pii.all_spans(text, field)
        added, sought = set(every) - set(base), want - set(base)
        right, found, gold = right + len(added & sought), found + len(added), gold + len(sought)
    assert gold > 100 and right / found >= 0.95 and right / gold >= 0.95


def test_pii_probabilities_equal_all_segmentations():
    """Forward and backward sums against every segmentation of small windows."""
    import math

    field, index = pii.trained(), {}
    for text in ("to +1 (555) 123-4567 8", "a@b.cd x 1.2.3.4", "x at y dot com"):
        x = pii._Lattice(field, text, set(), index)
        weights = np.array([field.weights.get(n, 0.0) for n in index])
        s = np.add.reduceat(weights[x.features], x.first)

        def paths(i, x=x, s=s):
            if i == x.n:
                yield 0.0, []
            for k in (k for k in range(len(s)) if x.begin[k] == i):
                for score, rest in paths(x.end[k]):
                    yield score + s[k], [k, *rest]

        every = list(paths(0))
        top = max(p for p, _ in every)
        whole = sum(math.exp(p - top) for p, _ in every)
        want = np.zeros(len(s))
        for p, arcs in every:
            want[arcs] += math.exp(p - top) / whole
        assert np.allclose(x.probabilities(weights), want, atol=1e-9)


def test_field_reads_the_best_segmentation():
    """Dynamic programming against all segmentations of a small window."""
    field, text = pii.trained(), "to +1 (555) 123-4567 8"
    places, arcs = field.lattice(text, 0, len(text))

    def paths(i):
        if i == len(places):
            yield 0.0, []
            return
        for end, kind, names in arcs[i]:
            for s, rest in paths(end):
                yield s + field._score(names), ([(kind, places[i][0], places[end - 1][1])] if kind else []) + rest

    assert field.best(text, 0, len(text)) == max(paths(0), key=lambda x: x[0])[1]


def test_html(spark):
    menu = "<div>Home About Prices Contact Terms Help Jobs Press Blog</div>"
    page = lambda i, body: (i, "http://h.example/1", f"<html><body>{menu}{body}</body></html>")
    p = spark.createDataFrame([page(1, "<p>first page of text &amp; more"), page(2, "<p>second   one<p>tail"), (3, None, None), (4, "::", ""), page(5, "<article><h1>T</h1><p>x<br>y</p><div class='comments'>no</div></article><p>out"), page(5, "<script>if(a<b){'</p>'}</script><nav>n</nav>kept")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.extract(p).collect())
    assert got == [(1, "first page of text & more"), (2, "second one\ntail"), (3, ""), (4, ""), (5, "T\nx y"), (5, "kept")]


def test_html_keeps_unique_tokens_of_blocks(spark):
    """A block loses the runs that another page of the host has and nothing else, whatever their share of it."""
    quote = " ".join(f"q{i}" for i in range(20))
    own = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    page = lambda i, *blocks: (i, "http://h.example/1", "".join(f"<div>{b}</div>" for b in blocks))
    p = [page(1, f"{own('a', 10)} {quote} {own('b', 10)}", own("c", 5)), page(2, f"{own('d', 90)} {quote}", own("e", 3)), page(3, own("f", 4), quote)]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(p, "page_id long, url string, html string")).collect()}
    assert got[1].text == f"{own('a', 10)} {own('b', 10)}\n{own('c', 5)}"
    assert got[2].text == f"{own('d', 90)}\n{own('e', 3)}"
    assert got[3].text == own("f", 4)
    assert all(r.repeated_words == 20 and r.n_chars == len(r.text) for r in got.values())


def test_html_articles_stay_whole(spark):
    """Two pages show an article's last paragraph outside their articles; the article keeps it."""
    line = "and so the story ends with words that others use in a box"
    page = lambda i, body: (i, "http://h.example/1", body)
    p = [page(1, f"<article><p>one</p><p>{line}</p></article>"), page(2, f"<article>two</article><p>{line}</p>"), page(3, f"<article>three</article><footer>{line}</footer>"), page(4, f"<p>four</p><p>{line}</p>")]
    got = {r.page_id: (r.text, r.repeated_words) for r in html_text.extract(spark.createDataFrame(p, "page_id long, url string, html string")).collect()}
    assert got == {1: (f"one\n{line}", 0), 2: ("two", 0), 3: ("three", 0), 4: ("four", 13)}


def test_html_notices_in_articles_go(spark):
    """Two blocks in a row that articles of different headings hold, and that pages show outside theirs, are a notice; an
    article's opening in lists, one block, a stretch of one heading, of articles only, or that boxes hold as one, stay."""
    notice = ["read more of us every week in your own letter box", "sign up below"]
    lead, other = ["a long first line which lists of this host quote in full", "and its second line"], ["only articles hold this line of quite a few words", "with this one behind"]
    p = lambda *lines: "".join(f"<p>{x}</p>" for x in lines)
    article = lambda *lines: f"<article>{p(*lines)}</article>"
    bodies = [
        article("one", "text", *notice, "end"), article("two", *notice), article("three", "x", notice[0]), article("four", *other), article("five", *other),
        article("own box", *notice) + p(*notice), article("six") + f"<footer>{p(*notice)}</footer>", p("seven", *lead), p("eight", *lead), article(*lead, "nine"), article("ten", *lead), article("ten", *lead, "again"),
    ]
    pages = [(i, "http://h.example/1", b) for i, b in enumerate(bodies)] + [(20, "http://g.example/", article("one", *notice))]
    box = [(30 + i, "http://b.example/", article(h, *notice) + f"<div class='ad'>{' '.join(notice)}</div>") for i, h in enumerate(("one", "two", "three"))]
    pages += box
    got = {r.page_id: (r.text, r.repeated_words) for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    n = len(" ".join(notice).split())
    want = {0: ("one\ntext\nend", n), 1: ("two", n), 2: ("three\nx\n" + notice[0], 0), 5: ("own box", n), 6: ("six", 0), 7: ("seven", 16), 8: ("eight", 16), 20: ("\n".join(["one", *notice]), 0)}
    want |= {k: ("\n".join([h, *other]), 0) for k, h in ((3, "four"), (4, "five"))} | {9: ("\n".join([*lead, "nine"]), 0), 10: ("\n".join(["ten", *lead]), 0), 11: ("\n".join(["ten", *lead, "again"]), 0)}
    want |= {30 + i: ("\n".join([h, *notice]), 0) for i, h in enumerate(("one", "two", "three"))}
    assert got == want


def plain_extract(pages):
    """Repeated runs by comparing all pages of a host with each other, window by window."""
    parsed = [(i, html_text.host_of(u), html_text.blocks(h or ""), (i, u, h)) for i, u, h in pages]
    shingles = lambda words: [tuple(words[i : i + html_text.RUN]) for i in range(len(words) - html_text.RUN + 1)]
    outer = [shingles([w for state, t in parts if state != html_text.KEEP for w in t.split()]) for _, _, parts, _ in parsed]
    out = []
    for i, host, parts, row in parsed:
        found = {s for s in {s for o in outer for s in o} if len({r for o, (_, h, _, r) in zip(outer, parsed) if h == host and s in o}) > 1}
        article, lines = any(state == html_text.KEEP for state, _ in parts), []
        if article:
            lines = [t for state, t in parts if state == html_text.KEEP]
        else:
            words = [(k, w) for k, (_, t) in enumerate(parts) for w in t.split()]
            hit = {j + k for j, s in enumerate(shingles([w for _, w in words])) if s in found for k in range(html_text.RUN)}
            for k, (state, _) in enumerate(parts):
                left = [w for j, (b, w) in enumerate(words) if b == k and j not in hit]
                lines += [" ".join(left)] if state == html_text.OPEN and left else []
        out.append((i, "\n".join(lines)))
    return sorted(out, key=str)


def test_html_equals_brute_force(spark):
    """Pages with and without articles, repeats within, across and outside them, repeated rows, other hosts."""
    rng = np.random.default_rng(4)
    phrase = [" ".join(f"p{i}w{j}" for j in range(n)) for i, n in enumerate((7, 8, 9, 12, 20, 30))]
    own = lambda i, n: " ".join(f"o{i}x{j}" for j in range(n))
    pages = []
    for i in range(60):
        body = []
        for k in range(int(rng.integers(1, 6))):
            text = " ".join([own(100 * i + k, int(rng.integers(0, 6))), phrase[rng.integers(6)] if rng.random() < 0.6 else "", own(7000 + 100 * i + k, int(rng.integers(0, 3)))])
            body.append(f"<{('p', 'div', 'footer', 'nav')[rng.integers(4)]}>{text}")
        inner = f"<article><h1>t{i}</h1><p>{phrase[rng.integers(6)]}<p>{own(i, 9)} {phrase[rng.integers(6)]}</article>" if i % 2 else ""
        pages.append((i, f"http://{'www.' if i % 5 else ''}h{i % 3}.example/{i}", "".join(body) + inner))
    pages += [pages[3], pages[4], (70, None, pages[5][2]), (71, "http://h0.example/", None), (None, None, pages[6][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "key", "host", "run", "parts", "places")})
    got = html_text.extract(df).collect()
    want = plain_extract(pages)
    assert sorted([(r.page_id, r.text) for r in got], key=str) == want
    assert sum(r.repeated_words > 0 for r in got) > 10
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("page", ["<a ", "<a x='", "<![CDATA[", "<!", "</", "<b>", "</i>", "<div class='", '<p class="a', "<script>", "<a \">\" ", "&lt", "<p>"])
def test_html_parser_is_linear(page):
    """A megabyte of what is left open takes no longer than a page of that length should."""
    import time

    begin = time.perf_counter()
    html_text.blocks(page * (1_000_000 // len(page)))
    assert time.perf_counter() - begin < 10


@pytest.mark.parametrize("page, want", [
    ("<p class=it's>hello", ["hello"]),
    ("<div class='comments-enabled'>body</div>", ["body"]),
    ("<div class='post-content share-buttons-enabled'>body</div>", ["body"]),
    ("<div class='site-footer'>foot</div><div id=comments>c</div>body", ["body"]),
    ("a < b <c>d</c> &lt;e", ["a < b d <e"]),
    ("<article><header><h1>T</h1></header>x<footer>f</footer></article>", ["T", "x"]),
    ("x<a href='", ["x"]),
    *[(f"<article>x<div class='{c}'>no</div>y</article>", ["x", "y"]) for c in ("reader-comments", "user-comments", "article-comments", "comment-thread", "commentlist", "related-articles", "related-posts", "social-links", "share-buttons", "ad-slot", "gdpr-notice", "newsletter-form", "notice-board")],
    *[(f"<article>x<p {c}>no</p>y</article>", ["x", "y"]) for c in ("hidden", "hidden=''", "id=a hidden", "style='color:red; display: none'", 'style="visibility:hidden"')],
    ("<article>x<p class=hidden-gems style='display:block'>y</p><p data-hidden=1>z</p></article>", ["x", "y", "z"]),
    ("<article><div class='article-header'><h1>T</h1></div>x</article>", ["T", "x"]),
    ("<article class=card>one</article><article>main<article class='comment'>c</article></article><article class='teaser-item'>two</article>", ["main"]),
    ("<article class=card>one</article><article class=card>two</article>", ["one", "two"]),
    ("<main><article class=card>one</article>text</main>", ["text"]),
])
def test_html_markup(page, want):
    assert [t for state, t in html_text.blocks(page) if state != html_text.DROP] == want


def test_quality_counts(docs, odd):
    for df in (docs, odd):
        for r in quality_rules.measure(df).join(df.dropDuplicates(["doc_id"]).select("doc_id", F.col("text").alias("t")), "doc_id").collect():
            t, seen, dup = r.t or "", set(), 0
            w, at = WORD.findall(t), {}
            for i in range(len(w) - 2):
                at.setdefault(tuple(w[i : i + 3]), []).append(i)
            covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
            for line in t.split("\n"):
                if WORD.search(line):
                    dup += line in seen
                    seen.add(line)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in t), dup, len(covered))
            assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_quality_distances_equal_plain_ones(spark):
    """Histograms, references of two passes, divergence and verdict, document by document."""
    import math
    from collections import Counter

    def shares(text):
        kind = lambda c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if c in quality_rules.MARKS else 5 if c in quality_rules.SYMBOLS else 6 if c in "\t\n\x0b\x0c\r " else 7 if c < "\xc0" else 2 if c < "\u2000" else 7 if c < "\u3000" else 8 if c < "\ue000" else 7
        chars, words = Counter(kind(c) for c in text), Counter(w if w in listed else w[:1].lower() + w[1:] if w[:1].lower() + w[1:] in listed and w == (w[:1].lower() + w[1:]).capitalize() else "" for w in WORD.findall(text))
        return {k: v / sum(chars.values()) for k, v in chars.items()}, {k: v / sum(words.values()) for k, v in words.items()}

    def distance(p, q):
        m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
        side = lambda x: sum(v * math.log2(v / m[k]) for k, v in x.items() if v)
        return math.sqrt(max(0.0, (side(p) + side(q)) / 2))

    def mean(rows):
        return [{k: sum(r[j].get(k, 0) for r in rows) / len(rows) for k in {k for r in rows for k in r[j]}} for j in (0, 1)]

    listed = {w for words in quality_rules.COMMON.values() for w in words.split()}
    rng, of = np.random.default_rng(2), {lang: words.split() for lang, words in quality_rules.COMMON.items()}
    made = lambda lang, n, share: " ".join((str(rng.choice(of[lang])) if rng.random() < share else "".join(rng.choice(list("aeinrst"), 6))) for _ in range(n))
    rows = [(i, made(lang, int(rng.integers(50, 400)), 0.4), lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 12)]
    rows += [(100, made("en", 400, 0.0), "en"), (101, "中" * 30 + " 文字 " * 60, "en"), (102, made("en", 30, 0.4), "en"), (103, "The " * 10 + made("en", 300, 0.5), None), (104, " ".join(f"{rng.integers(10**6)}" for _ in range(300)), "de"), (105, None, "en"), (106, "\U0001f600 " * 5 + made("fr", 200, 0.4), "")]
    measured = {i: (shares(t or ""), len(WORD.findall(t or "")), lang) for i, t, lang in rows}
    refs, near = None, lambda x, n, refs: min(distance(x[0], r[0]) for r in refs) <= quality_rules.MOST_CHARS and min(distance(x[1], r[1]) for r in refs) <= quality_rules.MOST_WORDS + 1 / math.sqrt(n)
    for _ in range(2):
        use = [(x, lang) for x, n, lang in measured.values() if n >= 50 and lang and (refs is None or near(x, n, refs))]
        refs = [mean([x for x, at in use if at == lang]) for lang in sorted({at for _, at in use})]
    got = {r.doc_id: r for r in quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, (x, n, _) in measured.items():
        r = got[i]
        if n:
            assert abs(r.char_distance - min(distance(x[0], q[0]) for q in refs)) < 1e-6 and abs(r.word_distance - min(distance(x[1], q[1]) for q in refs)) < 1e-6
            assert r.kept == (not r.base_failed and near(x, n, refs))
    assert not got[100].base_failed and not got[100].kept and got[100].char_distance < quality_rules.MOST_CHARS  # words alone reject
    assert not got[104].kept and got[0].kept and got[103].kept and not got[102].kept and got[102].base_failed


def test_js_distance_bounds():
    p = np.array([[1.0, 0], [0, 1], [1, 1], [0, 0]])
    d = quality_rules.js_distance(p, p[:2])
    assert d[0].tolist() == [0, 1] and d[3].tolist() == [1, 1] and 0 < d[2, 0] < 1


def plain_targets(size, weights=(5, 2, 1), most=3):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > most * size[s] + 1e-9}
        if not over:
            target |= {s: left * w[s] / total for s in free}
            break
        target |= {s: float(most * size[s]) for s in over}
        left -= sum(most * size[s] for s in over)
        free -= over
    return target


def test_mixing(docs, odd, none):
    for df in (docs, odd):
        r = mixing.mix(df).collect()
        assert len(r) == df.count()
        text = [(x.source, len(WORD.findall(x.text or ""))) for x in df.collect()]
        size = {s: sum(n for t, n in text if t == s) for s, _ in text}
        want = plain_targets(size)
        by: dict = {}
        for x in r:
            assert x.taken % max(1, x.size) == 0 and 0 <= x.taken <= 3 * x.size
            by.setdefault((x.source_size, round(x.target, 6)), []).append(x)
        assert sorted({t for _, t in by}) == sorted({round(t, 6) for t in want.values()})
        for (_, target), xs in by.items():
            groups = sum(1 for s, t in want.items() if round(t, 6) == target and size[s] == xs[0].source_size)
            assert abs(sum(x.taken for x in xs) - groups * target) <= groups * max(x.size for x in xs)
        assert sorted(map(str, r)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
        assert mixing.mix_documents(df).columns == df.columns
    assert mixing.mix(none).count() == 0


def test_mixed_documents_are_those_of_the_mix(spark):
    """Ids repeated within a source, across sources and with other texts: every source's words are the mix's."""
    rows = [(i % 7 if i % 3 else None, " ".join(["w"] * (1 + i % 5)), "abc"[i % 3 if i % 4 else 0]) for i in range(300)]
    rows += [(1, "x y z", "a")] * 50 + [(None, "x y z", None)] * 20 + [(1, None, "a"), (2, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("size", "copies", "times", "again", "k")})
    mixed = mixing.mix_documents(df)
    assert mixed.columns == df.columns
    words = {}
    for r in mixed.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    want = {}
    for r in mixing.mix(df).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert words == want
    assert mixing.mix(df).count() == len(rows)


def test_token_store(spark, docs, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    prepare(spark)
    for df in (docs, odd, none):
        path = shared_path(spark, "store")
        token_store.write_store(df, path, tokenizer("word_bpe_49k.json"))
        got = sorted([tuple(r) for r in token_store.read_store(spark, path).collect()], key=lambda r: r[1])
        start, want = 0, []
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
            ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
    assert token_store.read_documents(spark, path, [1]).count() == 0


def test_token_store_reads_the_blocks_asked_for(spark, docs, monkeypatch):
    """Random access: the ids of each document, and a scan that leaves out blocks by their bounds."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "BLOCK_IDS", 200)
    path = shared_path(prepare(spark), "store")
    token_store.write_store(docs, path, tokenizer("word_bpe_49k.json"))
    t = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)[3::40]
    got = token_store.read_documents(spark, path, [*ids, 10**9])
    assert {r.doc_id: r.ids for r in got.collect()} == {i: [*t.encode(texts[i], add_special_tokens=False).ids, 1] for i in ids}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or" in plan and "LessThanOrEqual(low," in plan and "GreaterThanOrEqual(high," in plan
    read = spark.read.parquet(path)
    assert read.where("high is not null and low > high").count() == 0 and read.count() > 20
    assert token_store._spans([1, 2, 3, 50]) == [(1, 1), (2, 2), (3, 3), (50, 50)] and len(token_store._spans(list(range(0, 10000, 7)))) == token_store.MOST_SPANS


@pytest.mark.parametrize("width", [1, 7, 16, 17, 20])
def test_bit_packing_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    b = token_store.pack_bits(ids, width)
    assert len(b) == -(-1001 * width // 8)
    assert (token_store.unpack_bits(b, width, 0, 1001) == ids).all()
    assert (token_store.unpack_bits(b, width, 333, 50) == ids[333:383]).all()


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_library_on_all_of_unicode(name, spaced):
    """Every character alone and between letters, and random strings of all planes."""
    import random

    from tokenizers import Tokenizer

    from lumenfare.llm.encoding import Encoder

    rng = random.Random(8)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    near = [c for c in points if c < 0x3000] + rng.sample(points, 3000)
    texts = [chr(c) for c in near] + [f"a{chr(c)}b" for c in near] + [f"{chr(c)}{m}" for c in near for m in (".", ",", ". x")]
    letter = lambda: chr(rng.choice(points) if rng.random() < 0.3 else rng.randrange(32, 0x250))
    texts += ["".join(rng.choice((" ", "\n", "a", "é", ".", "'s")) if rng.random() < 0.3 else letter() for _ in range(rng.randrange(1, 12))) for _ in range(10000)]
    t, e = Tokenizer.from_file(tokenizer(name)), Encoder(tokenizer(name), spaced)
    for text, want, got in zip(texts, t.encode_batch(texts, add_special_tokens=False), e.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, ascii(text)


@pytest.mark.parametrize("name,spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_marks_behind_words_are_looked_up_apart(name, spaced):
    """Words with several marks or capitals have the library's ids, and the library is asked for their marks alone."""
    from tokenizers import Tokenizer

    from lumenfare.llm.encoding import Encoder

    words = ["ended", "Ended", "ENDED", "Èoie", "èoie"]
    texts = [" ".join(w + m for w in words for m in ("", ".", ".###", ",%%%", "***", "?!?!", "$$$$$$$$")) for _ in range(2)]
    e, asked = Encoder(tokenizer(name), spaced), []
    for known in {id(x): x for x in (e.first, e.later)}.values():
        known._any = lambda text, f=known._any: (asked.append(text), f(text))[1]
    t = Tokenizer.from_file(tokenizer(name))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert asked and not any(c.isalpha() for text in asked for c in text)


def test_encoder_forgets_in_turn(monkeypatch):
    from lumenfare.llm import encoding

    texts = [f"word{i % 37} odd{i} word{i % 5}." for i in range(300)]
    want = encoding.Encoder(tokenizer("byte_bpe_50k.json"), True).encode(texts)
    monkeypatch.setattr(encoding, "REMEMBERED", 20)
    e = encoding.Encoder(tokenizer("byte_bpe_50k.json"), True)
    assert [x for t in texts for x in e.encode([t])] == want and len(e.later) + len(e.later.older) <= 30


def test_audio_alignment(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=64) for _ in range(6)]
    rec = [(i, audio.render(x)) for i, x in enumerate(v)]
    x, rate = audio.from_wav(rec[0][1])
    shifted = (x + rng.normal(0, 300, len(x)))[audio.HOP * 5 :]
    rec += [(50, audio.to_wav(shifted, rate)), (51, rec[1][1]), (100, rec[1][1]), (60, None), (61, b"junk"), (None, rec[2][1])]
    got = {r.vec_id: r for r in audio.align(spark.createDataFrame(rec, "vec_id long, media binary")).collect()}
    assert got[50].matches.startswith("0:5:") and got[0].matches.startswith("50:-5:")
    assert got[51].class_id == got[100].class_id == 1 and got[1].matches is None and got[100].matches == ""
    assert got[60].n_ints == 0 and got[60].class_id == got[61].class_id == 60 and got[None].class_id is None


def wav(samples, rate=4000, width=2, channels=1):
    import io
    import wave

    x = np.repeat(np.asarray(samples, np.int64)[:, None], channels, 1).ravel()
    raw = {1: (x // 256 + 128).astype(np.uint8).tobytes(), 2: x.astype("<i2").tobytes(), 3: (x * 256).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), 4: (x * 65536).astype("<i4").tobytes()}[width]
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return f.getvalue()


def test_media_cut_anywhere_has_its_whole_frames():
    whole = wav(np.arange(-40, 40) * 300, channels=2)
    for n in range(len(whole) + 1):
        x, rate = audio.from_wav(whole[:n])
        assert x.tolist() == (np.arange(-40, 40) * 300)[: max(0, n - 44) // 4].tolist() and (rate == 4000 or not len(x))


@pytest.mark.parametrize("width, loss", [(1, 256), (2, 1), (3, 1), (4, 1)])
def test_media_of_all_widths(width, loss):
    x = np.random.default_rng(width).integers(-32768, 32767, 500)
    assert np.abs(audio.from_wav(wav(x, width=width))[0] - x).max() < loss


@pytest.mark.parametrize("rate", [2500, 8000, 11025, 16000, 44100])
def test_media_of_other_rates_align(spark, rate):
    """The same melody sampled at another rate, at another width and a little later is found again."""
    z = np.random.default_rng(5).integers(-8, 9, 48)
    tune = lambda r, late: (12000 * np.sin(np.cumsum(np.repeat(2 * np.pi * 440 * 2 ** (z / 12) / r, int(r * 0.064)))))[int(r * late) :]
    other = np.random.default_rng(6).integers(-8, 9, 48)
    z2 = 12000 * np.sin(np.cumsum(np.repeat(2 * np.pi * 440 * 2 ** (other / 12) / 4000, 256)))
    rec = [(1, wav(tune(4000, 0))), (50, wav(tune(rate, 0.192), rate, 3, 2)), (2, wav(z2))]
    got = {r.vec_id: r.matches for r in audio.align(spark.createDataFrame(rec, "vec_id long, media binary")).collect()}
    offset, hits, error = got[50].split(",")[0].removeprefix("1:").split(":")
    assert got[50].startswith("1:") and offset == "3" and int(hits) >= 4 and float(error) < 0.1


def plain_alignment(a, b):
    """offset:hits:error of two fingerprints by brute force over all offsets, or None."""
    best = None
    for offset in range(1 - len(a), len(b)):
        x, y = a[max(0, -offset) :], b[max(0, offset) :]
        n = min(len(x), len(y))
        hits, error = int((x[:n] == y[:n]).sum()), sum(bin(int(u) ^ int(v)).count("1") for u, v in zip(x[:n], y[:n])) / (32 * n)
        if int(error * 1e4 + 0.5) / 1e4 <= 0.25 and (hits >= 4 or 4 * n >= 3 * min(len(a), len(b))):
            best = min(best or (-hits, error, offset), (-hits, error, offset))
    return best and f"{best[2]}:{-best[0]}:{int(best[1] * 1e4 + 0.5) / 1e4}"


def test_audio_alignment_equals_brute_force(spark, monkeypatch):
    """Noise spread over the bits, other lengths, one or two integers, and repeated notes: all offsets of all pairs count."""
    rng = np.random.default_rng(7)
    noisy = lambda x, k: x ^ np.array([sum(1 << int(i) for i in rng.choice(32, k, False)) for _ in x], np.uint32)
    base = rng.integers(0, 1 << 32, 40, np.uint64).astype(np.uint32)
    tune = np.tile(rng.integers(0, 1 << 32, 4, np.uint64).astype(np.uint32), 6)
    given = {0: base, 1: noisy(base, 7), 2: noisy(base[25:], 5), 3: base[10:12], 50: noisy(base[10:11], 3), 51: tune, 100: np.concatenate([tune[:8], noisy(base, 12)]), 52: np.concatenate([noisy(tune[:13], 20), tune[1:7]]), 53: np.empty(0, np.uint32), 54: base}
    monkeypatch.setattr(audio, "fingerprints", lambda recordings: recordings)
    for block, part, batch in ((1 << 18, 1 << 16, 1 << 16), (30, 50, 100)):
        for name, value in (("BLOCK", block), ("PART", part), ("BATCH", batch)):
            monkeypatch.setattr(audio, name, value)
        rows = spark.createDataFrame([(i, [int(x) for x in v.view(np.int32)]) for i, v in given.items()], "vec_id long, ints array<int>")
        got = {r.vec_id: r.matches for r in audio.align(rows).collect()}
        for q in (0, 50, 100):
            pairs = {r: plain_alignment(given[q], b) for r, b in given.items() if r not in (q, 53, 54)}
            assert got[q] == ",".join(f"{r}:{p}" for r, p in sorted(pairs.items()) if p)
        assert "1:0:0:0.2188" in got[0] and ",50:-10:0:" in got[0] and got[50].startswith("0:10:0:")


def test_empty_tables(spark, none):
    assert jaccard_join.similar_documents(none).count() == 0
    assert packing.pack_documents(none, tokenizer("byte_bpe_50k.json")).count() == 0
    assert quality_rules.measure(none).count() == 0
    assert pii.find(none).count() == 0
    assert token_counts.count_tokens(none, [("a", -1.0)]).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert audio.align(spark.createDataFrame([], "vec_id long, media binary")).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Every stage against a plain version on its own input: toxic documents, near copies, personal data, mix, packing."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("aeioubcdfgklmnprst"), int(rng.integers(3, 8))))
    clean = lambda n: " ".join(word() + ("." if k % 11 == 10 else "") for k in range(n))
    docs = [(i, clean(int(rng.integers(20, 90))) + (" You zorgling fool." if i % 5 == 0 else ""), None if i % 9 == 0 else "en", ("web", "web", "news", None)[i % 4], 0) for i in range(240)]
    docs += [(300 + i, docs[i][1] + " tail", "en", "copies", 1) for i in range(1, 60)]
    docs += [(400 + i, f"{clean(12)} bob{i}@example.org or +1 (555) 123-45{i:02d} or bob [at] example [dot] com", "en", "pii", None) for i in range(20)]
    docs += [(500, None, None, None, None), (501, "", "en", "web", 0), (None, clean(30), "en", "web", 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        seen[name] = (now.collect(), (now := spark.read.parquet(str(tmp_path / name))).collect())
    key = lambda rows: sorted(map(str, rows))

    before, after = seen["toxicity"]
    assert key(after) == key(r for r in before if "zorgling" not in (r.text or ""))
    before, after = seen["ngram_jaccard_join"]
    group = {i: c for i, _, c in components([r.doc_id for r in before], [r.text for r in before])}
    assert key(after) == key(r for r in before if r.doc_id is None or group[r.doc_id] == r.doc_id) and len(after) < len(before)
    before, after = seen["pii"]
    field = pii.trained()
    want = [(r.doc_id, r.text if r.text is None else pii.hidden(r.text, field)) for r in before]
    assert key((r.doc_id, r.text) for r in after) == key(want) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    assert not any(x in (r.text or "") for r in after for x in ("example", "555"))
    before, after = seen["mixing"]
    assert {str(r) for r in after} <= {str(r) for r in before}
    size = {s: sum(len(WORD.findall(r.text or "")) for r in before if r.source == s) for s in {r.source for r in before}}
    most = max(len(WORD.findall(r.text or "")) for r in before)
    for s, target in plain_targets(size).items():
        taken = [r for r in after if r.source == s]
        assert abs(sum(len(WORD.findall(r.text)) for r in taken) - target) <= most
        assert all(sum(x == r for x in taken) <= 3 for r in taken)
    before, after = seen["packing"]
    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    lengths = [len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before]
    assert sorted(r.length for r in after) == sorted(lengths) and len({r.sequence_id for r in after}) <= -(-sum(lengths) // 2048) + 1


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
