"""Alignment of two tokenizers, order MinHash and the conversation trie against plain versions, on awkward rows."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfare.llm import alignment, order_minhash, prefix_trie
from lumenfare.llm.queries import tokenizer

FOLDER = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
DOCS = "doc_id long, text string, lang string, row int, other string, links int, n_a int, part int, kind int, tie int"


def odd_documents(spark, texts):
    rows = [(i if i % 7 else None, t, "en", 1, "x", 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[1], rows[1], (3, None, None, None, None, None, None, None, None, None)], DOCS)


# ---------------------------------------------------------------- alignment

def aligned_plainly(use, text):
    """(n_a, n_b, groups, links) by byte ranges of whole encodings; None without tokens."""
    if not text:
        return None
    a, b = use.a.encode(" " + text, add_special_tokens=False).ids, use.b.encode(text)
    spell_a, spell_b = use.transducer.sides
    if not b"".join(spell_a[i] for i in a) == b"".join(spell_b[i] for i in b) == (" " + text).encode():
        return None
    ends_a, ends_b = (np.cumsum([len(s[i]) for i in x]).tolist() for s, x in ((spell_a, a), (spell_b, b)))
    groups, low = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        inside = lambda x, ends: ",".join(str(i) for i, e in zip(x, ends) if low < e <= end)  # noqa: B023, E731
        groups.append(f"{inside(a, ends_a)}|{inside(b, ends_b)}")
        low = end
    range_a, range_b = ([(e - len(s[i]), e) for i, e in zip(x, ends)] for s, x, ends in ((spell_a, a, ends_a), (spell_b, b, ends_b)))
    links = [(i, j) for i, (p, q) in zip(a, range_a) for j, (r, s) in zip(b, range_b) if p < s and r < q]
    return len(a), len(b), groups, links


def alignment_plainly(use, texts):
    found = [aligned_plainly(use, t) for t in texts]
    count = Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((f[0], f[1], len(f[2]), len(f[3]), sum(count[p] == best[p[0]] for p in f[3]), sum(count[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()))
    return out


BITS = ["a", "the", "foo", "'s", "’", "é", "ß", " ", " ", "  ", "\n", "\n\n", " \n", "\t", "\r", "\x1c", "\x85", "\xa0", "​", ".", ",", "?)", "...", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "Ġ", "12", "3,4", "²", "你好", "😀", "é", "ﬁ", "½", "́", "Å", "İ", "\x00", "don't", "x.y", "A.B."]


@pytest.fixture(scope="module")
def use():
    return alignment.Aligner(tokenizer(A), tokenizer(B))


def test_pieces_equal_whole_texts(use):
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + [*BITS, "", None, " ", "\n", "x" * 300, "word, word. word"]
    some = 0
    for low in range(0, len(texts), 64):
        for t, found in zip(texts[low : low + 64], use.texts(texts[low : low + 64])):
            want = aligned_plainly(use, t)
            assert (found is None) == (want is None)
            if want:
                some += 1
                n_a, n_b, n_groups, n_links, digest, codes, times = alignment.summed(found)
                assert (n_a, n_b, n_groups, n_links) == (want[0], want[1], len(want[2]), len(want[3]))
                assert digest == hashlib.sha256(";".join(want[2]).encode()).hexdigest()
                assert dict(zip(codes.tolist(), times.tolist())) == Counter(i << 32 | j for i, j in want[3])
    assert some > 1000


def test_remembering_little_changes_nothing(monkeypatch, use):
    texts = ["one two, three three. one", "two three four\nfive", "one, six"] * 3
    want = [alignment.summed(f)[:5] for f in use.texts(texts)]
    for name in ("REMEMBERED", "STATES", "SHORT"):
        monkeypatch.setattr(alignment, name, 2)
    short = alignment.Aligner(tokenizer(A), tokenizer(B))
    for low in range(0, len(texts), 2):
        assert [alignment.summed(f)[:5] for f in short.texts(texts[low : low + 2])] == want[low : low + 2]
    assert not any(len(p) > 2 for p in short.known)


def test_transducer_refuses_other_bytes():
    t = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"x", b"abcd"])
    groups, links = t.align([0, 1], [0, 1])
    assert groups == b"0,1|0,1" and len(links) == 3 * 8
    assert t.align([0], [2]) is None and t.align([0], [0]) is None and t.align([2], [3]) is None and t.align([2], [0, 1, 2]) is None
    assert t.align([], []) == (b"", b"") and t.align([], [0]) is None


@pytest.mark.parametrize("pairs", [1 << 22, 40])
def test_alignment_equals_brute_force(spark, use, monkeypatch, pairs):
    monkeypatch.setattr(alignment, "AT_ONCE", pairs)
    df = odd_documents(spark, ["", " ", "one two", "one two", "The cat, the hat.\nThe end", "a\tb", "x " * 400, "naïve café 你好", "foo\n\nbar  baz"])
    p = df.select("doc_id", "text").collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = alignment.align(df, tokenizer(A), tokenizer(B))
    assert got.columns == ["doc_id", *names]
    want = [(r.doc_id, *x) for r, x in zip(p, alignment_plainly(use, [r.text for r in p]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_alignment_of_documents(spark, use):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 2500")
    p = df.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(p, alignment_plainly(use, [r.text for r in p]))}
    assert {r[0]: tuple(r)[1:] for r in alignment.align(df, tokenizer(A), tokenizer(B)).collect()} == want and len(want) > 100


# ---------------------------------------------------------------- order MinHash

def fingerprint_plainly(text):
    """By sorting every k-mer with its occurrence number under each ordering."""
    k, raw, seen, h = order_minhash.K, order_minhash.kmers(text).tolist(), Counter(), []
    kinds = [text[i : i + k] for i in range(max(1, len(text) - k + 1))] if text else []
    assert len(raw) == len(kinds)
    step = int(order_minhash._STEP)
    for value, kind in zip(raw, kinds):
        n = seen[kind]
        seen[kind] += 1
        h.append(value if not n else int(order_minhash._mixed(np.array([(value + n * step) % 2**64], np.uint64))[0]))
    if not h:
        return [0] * order_minhash.FUNCTIONS
    out = []
    for flip, times in zip(order_minhash._FLIP[:, 0].tolist(), order_minhash._TIMES[:, 0].tolist()):
        least = sorted(range(len(h)), key=lambda i: (((h[i] >> 32) ^ flip) * times % 2**32, i))[: order_minhash.TUPLE]
        mixed = sum(h[i] * int(t) for i, t in zip(sorted(least), order_minhash._TAIL)) % 2**64
        out.append(int(order_minhash._mixed(np.array([mixed], np.uint64))[0]) >> 32)
    return out


def test_fingerprints_equal_sorting_everything():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdé你😀 ") for _ in range(rng.randint(1, 9)))
    texts = ["", "a", "ab", "abcdefgh", "abcdefghi", "x" * 50, "ab" * 40, *("".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60))]
    for t, u in zip(texts, texts[1:] + texts[:1]):
        assert order_minhash.fingerprint(t).tolist() == fingerprint_plainly(t)
        new = order_minhash.edited(t, u)
        assert (order_minhash.spliced(t, u, order_minhash.kmers(t), order_minhash.kmers(u)) == order_minhash.kmers(new)).all()


def test_likeness_falls_with_edits_and_with_moved_passages():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    near = lambda a, b: order_minhash.likeness(order_minhash.fingerprint(" ".join(a)), order_minhash.fingerprint(" ".join(b)))
    changed = lambda n: [w if i % n else "changed" for i, w in enumerate(words)]
    steps = [near(words, words), near(words, changed(50)), near(words, changed(10)), near(words, changed(3))]
    assert steps[0] == 1 and steps == sorted(steps, reverse=True) and steps[1] > 0.6 and steps[3] < 0.4
    # the same k-mers but for a few, in another order of the two halves: half of all pairs of k-mers turn round
    assert near(words, words[200:] + words[:200]) < 0.75 and near(words, words[::-1]) < 0.3
    assert near(words, [w[::-1] for w in words]) == 0


@pytest.mark.parametrize("texts", [["", "a", "abc " * 30, None, "the cat sat on the mat", "the cat sat on the mat", "é你😀" * 9, "x" * 2000, "tail"], ["only one row"]])
def test_compare_with_next_equals_brute_force(spark, texts):
    df = odd_documents(spark, texts) if len(texts) > 1 else spark.createDataFrame([(5, texts[0])], "doc_id long, text string")
    tie = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.h, r.text) for r in tie), reverse=True)
    print_ = lambda t: "".join(f"{x:08x}" for x in fingerprint_plainly(t))
    near = lambda a, b: sum(x == y for x, y in zip(fingerprint_plainly(a), fingerprint_plainly(b))) / order_minhash.FUNCTIONS
    want = []
    for (i, _, t), (_, _, u) in zip(rows, rows[1:] + rows[:1]):
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((None if i < 0 else i, len(t), hashlib.sha256(new.encode()).hexdigest(), print_(t), print_(new), near(t, new), near(t, u)))
    assert sorted(map(tuple, order_minhash.compare_with_next(df).collect()), key=str) == sorted(want, key=str)


def test_fingerprints_of_documents(spark):
    got = order_minhash.compare_with_next(spark.read.parquet(f"{FOLDER}/documents.parquet")).toPandas()
    assert len(got) == 200 and got.near_edited.mean() > 0.08 > 0.02 > got.near_next.mean()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    by_text = {}
    for r in got.itertuples():
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    ids = sorted(text, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(text[i]) // 2
        assert got.set_index("doc_id").edited_sha256[i] == hashlib.sha256((text[i][: len(text[i]) - half] + text[j][:half]).encode()).hexdigest()


# ---------------------------------------------------------------- conversation trie

TURNS = "conv_id long, turn long, role string, text string, depth int, length int, p1 int, n int, words int"


def trie_by_sql(df):
    c = duckdb.connect()
    c.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    got = c.execute(prefix_trie.SQL).fetchall()
    return [d[0] for d in c.description], got


@pytest.mark.parametrize("block", [1024, 2])
def test_trie_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "JOINED", 8)
    rng = random.Random(block)
    said = ["hello there", "hi", "", None, "one two  three", " \t"]
    rows = []
    for c in [*range(-45, 90), 1000, 10**12 + 3]:
        if c % 7 == 3 or c in (40, 60):
            continue  # absent conversations, bases among them
        for t in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", "user", None]), rng.choice(said[: 2 + t % 5]), 1, 2, 3, 4, 5))
    rows += [(20, 9, "user", "tail", 1, 2, 3, 4, 5)] * 2  # two rows of one turn, alike
    rows += [(c, t, "user", f"line {t}", 0, 0, 0, 0, 0) for c in (81, 83, 85) for t in range(20, 60)]
    rows += [(None, 1, "user", "nobody's", 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, TURNS)
    names, want = trie_by_sql(df)
    got = prefix_trie.rebuilt_trie(df).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want) if None not in {r[2] for r in want} else sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert max(r[1] for r in want) >= 40 and any(r[3] > 20 for r in want)


def test_trie_of_few(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.rebuilt_trie(none).count() == 0
    one = spark.createDataFrame([(c, 0, "user", "a b", 1, 1, 1, 1, 1) for c in range(21, 30)], TURNS)
    names, want = trie_by_sql(one)
    assert sorted(map(str, map(tuple, prefix_trie.rebuilt_trie(one).select(*names).collect()))) == sorted(map(str, want))
