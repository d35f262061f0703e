"""Quality rules by distribution divergence: a document's character classes and common words against its language's.

The references are the mean histograms of the documents of each language that have `LEAST_WORDS` words: first of all of
them, then, in a second pass over the corpus, of those that are near a first reference, so that junk does not shape what
it is held against. A document is measured against every language, so a wrong language tag does not matter, and the
nearest counts. The Jensen-Shannon distance (square root of the divergence in bits) lies in 0 to 1. Short documents
make noisy histograms; below `LEAST_WORDS` words they are not judged by distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.llm.common import Words, batches, forget, prepare

LEAST_WORDS = 50
#: Distances above which a document has no language's characters, or (with an allowance for its length) no language's
#: words. Set from labelled documents: all 3,243 good ones of 50 words or more lie below 0.25 and 0.23.
MOST_CHARS, MOST_WORDS = 0.30, 0.27

# The most common words of four languages.
COMMON = {
    "de": "der die und das ist nicht von mit den ein eine zu im des auf für sich dem auch es als",
    "en": "the of and to in is that for are was with as on be this by from at or an it he not",
    "es": "el la los las de que y en un una es por con para del se no su al lo como",
    "fr": "le la les de des et un une est que qui dans pour sur pas au par du en avec ce",
}
# The characters counted as symbols, and as marks of a sentence.
SYMBOLS, MARKS = "#*$%&|<>", ".,;:!?'\"()-"
_CLASSES = 9  # lower, upper, other letters, digits, marks, symbols, white space, the rest, ideographs and syllables


def _class_table() -> np.ndarray:
    """A character's class by its first byte in UTF-8: two-byte letters from U+00C0 on and three-byte ones to U+1FFF are
    other letters, U+3000 to U+DFFF are ideographs and syllables; signs, private use and emoji are the rest."""
    t = np.full(256, 7, np.uint8)
    t[97:123], t[65:91], t[48:58] = 0, 1, 3
    t[0xC3:0xE2], t[0xE3:0xEE] = 2, 8
    t[128:192] = 255  # bytes that continue a character
    t[[ord(c) for c in MARKS]], t[[ord(c) for c in SYMBOLS]], t[[9, 10, 11, 12, 13, 32]] = 4, 5, 6
    return t


_CLASS = _class_table()
_LIST = sorted({w for words in COMMON.values() for w in words.split()})
_FORMS = [(f, i) for i, w in enumerate(_LIST) for f in (w, w.capitalize())]
_hashes: list[np.ndarray] = []


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    if not _hashes:
        h = Words([f.encode() for f, _ in _FORMS]).hash
        order = np.argsort(h)
        _hashes.extend([h[order], np.array([i for _, i in _FORMS])[order]])
    return _hashes[0], _hashes[1]


def histograms(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n texts' character classes and of common words, the last column for all other words."""
    kind = _CLASS[w.raw]
    doc = np.repeat(np.arange(n), np.diff(w.offset))
    kind[w.offset[1:] - 1] = 255  # the line feeds between texts
    seen = kind < 255
    chars = np.bincount(doc[seen] * _CLASSES + kind[seen], minlength=n * _CLASSES).reshape(n, _CLASSES)
    keys, index = _common_hashes()
    at = np.minimum(np.searchsorted(keys, w.hash), len(keys) - 1)
    word = np.where(keys[at] == w.hash, index[at], len(_LIST))
    words = np.bincount(w.doc * (len(_LIST) + 1) + word, minlength=n * (len(_LIST) + 1)).reshape(n, len(_LIST) + 1)
    return chars, words


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of each row of p from each row of q, both of nonnegative counts; an empty row is 1 away from all."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    out = np.ones((len(p), len(q)))
    for j, r in enumerate(q):
        m = (p + r) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
            b = np.where(r > 0, r * np.log2(r / m), 0).sum(1)
        out[:, j] = np.where(p.sum(1) > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 1)
    return out


#: Languages that references are kept for, the most frequent ones: a free-text column can hold any number.
MOST_LANGS = 200


class References:
    """Mean shares of character classes and words by language, and the verdict of nearness to one of them."""

    def __init__(self, table: pd.DataFrame):
        self.langs = table.lang.tolist()
        self.chars = np.array(table.chars.tolist()).reshape(len(table), _CLASSES)
        self.words = np.array(table.words.tolist()).reshape(len(table), len(_LIST) + 1)

    def distances(self, chars: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return js_distance(chars.astype(float), self.chars), js_distance(words.astype(float), self.words)

    def near(self, n_words: np.ndarray, char_d: np.ndarray, word_d: np.ndarray) -> np.ndarray:
        """A sample of n words is away from its own language by about 1 / sqrt(n), which the bound of words allows."""
        if not self.langs:
            return np.ones(len(n_words), bool)
        return (char_d.min(1) <= MOST_CHARS) & (word_d.min(1) <= MOST_WORDS + 1 / np.sqrt(np.maximum(n_words, 1)))


def references(documents: DataFrame, rough: pd.DataFrame | None = None) -> pd.DataFrame:
    """lang, and chars and words as arrays: the mean shares over the documents of each language (null and "" left out),
    of the MOST_LANGS languages with most documents.

    With rough references only documents near one of them count, so that junk does not shape what it is held against.
    Sums of one row per task and language come together in Spark, not documents.
    """
    shared = documents.sparkSession.sparkContext.broadcast(References(rough) if rough is not None else None)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        sums: dict[str, np.ndarray] = {}
        for pdf in frames:
            langs, texts = pdf.lang.tolist(), pdf.text.tolist()
            for begin, w in batches(texts):
                n = len(w.first) - 1
                chars, words = histograms(w, n)
                share = np.concatenate([chars / np.maximum(chars.sum(1, keepdims=True), 1), words / np.maximum(words.sum(1, keepdims=True), 1), np.ones((n, 1))], axis=1)
                use = np.diff(w.first) >= LEAST_WORDS
                if shared.value is not None:
                    use &= shared.value.near(np.diff(w.first), *shared.value.distances(chars, words))
                for i in np.flatnonzero(use):
                    if lang := langs[begin + i]:
                        sums[lang] = sums[lang] + share[i] if lang in sums else share[i]
        if sums:
            yield pd.DataFrame({"lang": list(sums), "share": [s.tolist() for s in sums.values()]})

    parts = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInPandas(emit, "lang string, share array<double>")
    sums = parts.select("lang", F.posexplode("share").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    sums = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("share"))
    rows = sums.orderBy(F.desc(F.element_at("share", -1)), "lang").limit(MOST_LANGS).collect()
    full = [(r.lang, np.array(r.share[:-1]) / r.share[-1]) for r in sorted(rows, key=lambda r: r.lang)]
    shared.destroy()
    return pd.DataFrame({"lang": [x for x, _ in full], "chars": [v[:_CLASSES] for _, v in full], "words": [v[_CLASSES:] for _, v in full]}, columns=["lang", "chars", "words"])


_BLANK = " \t\n\x0b\x0c\r"
_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double, nearest_lang string"


def measure(documents: DataFrame, window: int = 3) -> DataFrame:
    """doc_id, counts, base_failed, kept and distances for every row of documents (doc_id, text, lang).

    Words are `[^\\x20\\x09-\\x0D]+`. word_chars: code points in words; n_symbols: characters of SYMBOLS; n_dup_lines:
    lines with a word that equal an earlier line; n_repeat_words: words in windows of three words that the text holds
    twice or more. base_failed: fewer than LEAST_WORDS words, or more than half of them repeated. kept: not base_failed
    and, if there are references, near enough to one language in characters and in words. A null text counts as
    empty: it fails. Rows are judged one by one, so repeated rows and null ids keep their places; no rows, no result.
    """
    spark = prepare(documents.sparkSession)
    shared = spark.sparkContext.broadcast(References(references(documents, references(documents))))

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        ref = shared.value
        for pdf in frames:
            texts = pdf.text.tolist()
            rows = []
            for begin, w in batches(texts):
                n = len(w.first) - 1
                n_words = np.diff(w.first)
                chars, words = histograms(w, n)
                points = np.add.reduceat((w.raw & 0xC0) != 0x80, w.offset[:-1]) - 1
                spaces = chars[:, 6]
                symbols = chars[:, 5]
                repeat = np.zeros(n, np.int64)
                total = len(w.hash)
                if total >= window:
                    h = np.zeros(total - window + 1, np.uint64)
                    for j in range(window):
                        h = (h ^ w.hash[j : total - window + 1 + j]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)
                    same = w.doc[: total - window + 1] == w.doc[window - 1 :]
                    h = (h ^ (w.doc[: len(h)].astype(np.uint64) << np.uint64(40))) * np.uint64(0xBF58476D1CE4E5B9)
                    at = np.flatnonzero(same)
                    _, inverse, times = np.unique(h[at], return_inverse=True, return_counts=True)
                    hit = at[times[inverse] > 1]
                    cover = np.zeros(total, bool)
                    for j in range(window):
                        cover[hit + j] = True
                    repeat = np.bincount(w.doc[cover], minlength=n)
                char_d, word_d = ref.distances(chars, words)
                near = ref.near(n_words, char_d, word_d)
                for i in range(n):
                    lines = [x for x in (texts[begin + i] or "").split("\n") if x.strip(_BLANK)]
                    failed = bool(n_words[i] < LEAST_WORDS or 100 * repeat[i] > 50 * n_words[i])
                    k = int((char_d[i] + word_d[i]).argmin()) if ref.langs else -1
                    rows.append((n_words[i], points[i] - spaces[i], symbols[i], len(lines) - len(set(lines)), repeat[i], failed, bool(near[i] and not failed), *((float(char_d[i].min()), float(word_d[i].min()), ref.langs[k]) if ref.langs else (None, None, None))))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in _OUT.split(", ")][1:])
            out.insert(0, "doc_id", pdf.doc_id.astype("Int64").array)
            yield out

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(emit, _OUT)
