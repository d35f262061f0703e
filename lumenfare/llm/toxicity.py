"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels.

A document is a bag of sentences. A sentence's probability is a logistic function of the features of its distinct
words: the word and its beginnings of 4, 5 and 6 letters, hashed. The document's is 1 - prod(1 - p_sentence), and the
weights maximise the likelihood of the documents' labels, so nothing but a document's label is needed and the sentences
that carry it come out by themselves.

The model is fitted on a bounded sample of labelled documents (`MOST_LABELLED`, by hash of the id) and on `FEATURES`
features, those that tell the labels apart most among features more frequent in toxic ones. Feature counts of the
sample are summed in Spark; only the chosen features' places come to the driver. Scoring reads every text whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.llm.common import durable, forget, held_out, prepare

#: Labelled documents that the model is fitted on, at most.
MOST_LABELLED = 24_000
FEATURES = 8_192
#: A feature must stand in this many sampled documents, and this many times as often in toxic ones.
LEAST_DOCS, LEAST_RATIO = 3, 10.0
STEPS = 300
THRESHOLD = 0.3
REMEMBERED = 1 << 18
_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")
_MARKS = str.maketrans(".!?", "   ")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿"


def word_features(word: str) -> list[int]:
    """Hashes, in 40 bits, of a lower-case word without marks at its ends, and of its beginnings."""
    import xxhash

    word = word.strip(_EDGE)
    names = [f"={word}"] + [f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n]
    return [xxhash.xxh64_intdigest(n) & 0xFFFFFFFFFF for n in names] if word else []


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the runs between `.`, `!`, `?` and line feeds that hold more than white space."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def words(text: str) -> set[str]:
    """Distinct lower-case words of all sentences: sentence marks part words as white space does."""
    return set(text.translate(_MARKS).lower().split())


class Model:
    """Weights by feature, the sentences' bias, and what is known of words."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.weights, self.bias = {int(f): float(w) for f, w in zip(features, weights) if abs(w) > 1e-3}, float(bias)
        self.known: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return w

    def score(self, text: str) -> tuple[float, list[tuple[int, int]]]:
        """(document's score, places of sentences with a score of THRESHOLD or more). An empty text has no sentence: 0."""
        known = self.known
        hot = {w for w in words(text) if known.get(w, 1.0) and self._weight(w)}
        spans = sentences(text)
        if not hot:
            return float(-np.expm1(len(spans) * -np.log1p(np.exp(self.bias)))), []
        quiet, found = 0.0, []
        for a, b in spans:
            z = self.bias + sum(self._weight(w) for w in hot.intersection(text[a:b].lower().split()))
            quiet -= float(np.logaddexp(0.0, z))
            if z >= np.log(THRESHOLD / (1 - THRESHOLD)):
                found.append((a, b))
        return float(-np.expm1(quiet)), found


def noisy_or_fit(doc: np.ndarray, sent: np.ndarray, feat: np.ndarray, value: np.ndarray, empty: np.ndarray, label: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the noisy-or likelihood.

    sent, feat, value: nonzero features of the sentences that have any; doc: each such sentence's document; empty: how
    many sentences without features a document has besides.
    """
    n_sent, w, b = len(doc), np.zeros(n_features), -6.0
    m, v, y = np.zeros(n_features + 1), np.zeros(n_features + 1), label.astype(float)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sent, w[feat] * value, n_sent)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        quiet = np.bincount(doc, np.logaddexp(0, z), len(y)) + empty * np.logaddexp(0, b)
        whole = np.clip(-np.expm1(-quiet), 1e-9, 1)
        pull = np.where(y == 1, -(1 - whole) / whole, 1.0)
        dz = pull[doc] * p
        grad = np.append(np.bincount(feat, dz[sent] * value, n_features), dz.sum() + (pull * empty * p0).sum()) / len(y)
        grad[:-1] += 2e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], float(np.clip(b - move[-1], -16, 4))
    return w, b


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """A model of labels (doc_id, toxic), from documents (doc_id, text) outside the held-out fold.

    Labels of null id or value are ignored; of several for one id the highest counts, and of
    several texts for one id the last in code point order, so that the sample keeps its bound. Without labels, or with one value
    only, the model has no features and scores every text by its number of sentences with a small bias.
    """
    spark = prepare(documents.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic").cast("int") > 0).cast("int")).alias("toxic")).where(~held_out())
    chosen = durable(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = durable(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))  # MOST_LABELLED rows at most

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for pdf in frames:
            for text, y in zip(pdf.text, pdf.toxic):
                seen[int(y > 0)].update({f for w in words(text) for f in word_features(w)})
        for y, c in enumerate(seen):
            yield pd.DataFrame({"f": list(c.keys()), "y": y, "n": list(c.values())}, columns=["f", "y", "n"]).astype({"f": "int64", "y": "int32", "n": "int64"})

    docs = {int(y > 0): n for y, n in sample.groupBy("toxic").count().collect()}
    bad, good = docs.get(1, 0), docs.get(0, 0)
    if not bad or not good:
        return Model(np.empty(0, np.int64), np.empty(0), -8.0)
    c = sample.select("text", "toxic").mapInPandas(count, "f long, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    rate = (F.col("a") / F.lit(float(bad))) / ((F.col("b") + 0.5) / F.lit(float(good)))
    c = c.where((F.col("a") + F.col("b") >= LEAST_DOCS) & (rate >= LEAST_RATIO)).withColumn("gain", F.col("a") * F.log(rate))
    features = np.array(sorted(r.f for r in c.orderBy(F.desc("gain"), "f").limit(FEATURES).collect()), np.int64)
    place = spark.sparkContext.broadcast({int(f): k for k, f in enumerate(features)})

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        at, known = place.value, {}
        for pdf in frames:
            out = []
            for text, y in zip(pdf.text, pdf.toxic):
                spans, hits = sentences(text), []
                for a, b in spans:
                    c: Counter = Counter()
                    for w in set(text[a:b].lower().split()):
                        if w not in known:
                            if len(known) > REMEMBERED:
                                known.clear()
                            known[w] = [at[f] for f in word_features(w) if f in at]
                        c.update(known[w])
                    if c:
                        hits.append(c)
                flat = [(k, f, n) for k, c in enumerate(hits) for f, n in c.items()]
                out.append((int(y > 0), len(spans) - len(hits), len(hits), np.array(flat, np.int32).reshape(-1).tobytes()))
            yield pd.DataFrame(out, columns=["y", "empty", "hits", "flat"])

    rows = sample.select("text", "toxic").mapInPandas(places, "y int, empty int, hits int, flat binary").toPandas().sort_values(["y", "empty", "hits", "flat"])
    place.destroy()
    first = np.concatenate([[0], np.cumsum(rows.hits)])
    flat = [np.frombuffer(x, np.int32).reshape(-1, 3) + np.array([f, 0, 0], np.int64) for x, f in zip(rows.flat, first)]
    cells = np.concatenate(flat) if flat else np.empty((0, 3), int)
    w, b = noisy_or_fit(np.repeat(np.arange(len(rows)), rows.hits), cells[:, 0], cells[:, 1], cells[:, 2].astype(float), rows["empty"].to_numpy(float), rows.y.to_numpy(), len(features))
    return Model(features, w, b)


def score(documents: DataFrame, labels: DataFrame, keep_text: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted, offending) for every row of documents; with keep_text all its columns too.

    predicted: 1 from THRESHOLD on. offending: places `start:end` (code points, end exclusive) of sentences that reach
    it on their own, comma-joined; "" if none. A null text counts as empty and scores 0. Repeated rows score alike;
    a null doc_id is not held out. Columns of documents that have an output's name are replaced.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))
    extra = [f for f in documents.schema.fields if keep_text and f.name not in ("held_out", "score", "predicted", "offending")]

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        m = model.value
        for pdf in frames:
            found = [m.score(t or "") for t in pdf.text.tolist()]
            pdf["score"] = [s for s, _ in found]
            pdf["predicted"] = (pdf.score >= THRESHOLD).astype("int32")
            pdf["offending"] = [",".join(f"{a}:{b}" for a, b in x) for _, x in found]
            yield pdf

    if keep_text:
        from pyspark.sql import types as T

        schema = T.StructType([*extra, *T._parse_datatype_string("held_out boolean, score double, predicted int, offending string").fields])
        given = documents.select(*[f.name for f in extra], held_out().alias("held_out"))
        return given.mapInPandas(_nullable(emit, given), schema)
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def slim(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in emit(frames):
            yield pdf.drop(columns="text")

    return given.mapInPandas(_nullable(slim, given), "doc_id long, held_out boolean, score double, predicted int, offending string")


def _nullable(f, df: DataFrame):
    """f over frames whose integer columns keep nulls and all digits."""
    whole = [n for n, t in df.dtypes if t in ("bigint", "int")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return f(pdf.astype({n: "Int64" for n in whole}) for pdf in frames)

    return run


def reject(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that are not predicted toxic, with their columns; those named like outputs keep their values."""
    aside = {c: f"given_{c}_" for c in ("held_out", "score", "predicted", "offending") if c in documents.columns}
    kept = score(documents.withColumnsRenamed(aside), labels, keep_text=True).where("predicted = 0")
    return kept.select(*[F.col(aside.get(c, c)).alias(c) for c in documents.columns])
