"""Order MinHash fingerprints (Marçais et al., 2019): likeness that falls with edits and with moved passages alike.

A text's k-mers are numbered by occurrence, so that a repeated one counts as often as it stands there. Each of
FUNCTIONS orderings picks the TUPLE numbered k-mers that are least by its hash, puts them back into text order and
hashes the tuple. Two texts agree in an ordering when the same k-mers are least in both and stand in the same order; the
share of orderings that agree is their likeness. A text of fewer than K characters is one k-mer, and one of fewer
k-mers than a tuple takes has all of them in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import forget, prepare, stored

K, TUPLE, FUNCTIONS = 8, 2, 64
#: Hashes that are compared at once, about.
AT_ONCE = 1 << 18
_rng = np.random.default_rng(20)
_FLIP, _TIMES = (_rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)[:, None] for _ in range(2))
_TIMES |= np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.uint64(pow(int(_STEP), 1 << i, 1 << 64)) for i in range(K.bit_length())]
_TAIL = np.array([pow(int(_STEP), i, 1 << 64) for i in range(1, max(K, TUPLE) + 1)], np.uint64)
_ROWS = np.arange(FUNCTIONS)


def _mixed(x: np.ndarray) -> np.ndarray:
    """x itself, scrambled in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kmers(text: str) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points, in text order."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < K:
        return _mixed((c * _TAIL[: len(c)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(c))) if len(c) else c
    for i, power in enumerate(_POWERS[:-1]):  # K is a power of two: widths 2, 4, .. are put together of halves
        h = c[: -(1 << i)] * power
        h += c[1 << i :]
        c = h
    return _mixed(c)


def spliced(text: str, other: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The k-mers of edited(text, other), from those of both: only those across the joint are hashed anew."""
    kept, taken = len(text) - len(text) // 2, min(len(text) // 2, len(other))
    if kept < K or taken < K:
        return kmers(edited(text, other))
    return np.concatenate((a[: kept - K + 1], kmers(text[kept - K + 1 : kept] + other[: K - 1]), b[: taken - K + 1]))


def numbered(h: np.ndarray) -> np.ndarray:
    """h with repeated values changed by the number of their occurrences before. Values are sorted with their places in
    the low bits, so that 64 bits less those decide what is a repeat."""
    bits = np.uint64(max(1, len(h)).bit_length())
    s = h >> bits
    s <<= bits
    s |= np.arange(len(h), dtype=np.uint64)
    s.sort()
    value = s >> bits
    again = np.flatnonzero(value[1:] == value[:-1]) + 1
    if not len(again):
        return h
    run = np.flatnonzero(np.diff(again, prepend=-1) > 1)  # where another value's repeats begin
    times = again - np.repeat(again[run] - 1, np.diff(np.append(run, len(again))))
    at = (s[again] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    h = h.copy()
    h[at] = _mixed(h[at] + times.astype(np.uint64) * _STEP)
    return h


def signature(h: np.ndarray) -> np.ndarray:
    """FUNCTIONS 32-bit tuple hashes of a text's k-mers; those of an empty text are zeros."""
    n = len(h)
    if not n:
        return np.zeros(FUNCTIONS, np.uint32)
    h = numbered(h)
    x, picks = (h >> np.uint64(32)).astype(np.uint32), min(TUPLE, n)
    at = np.empty((FUNCTIONS, picks), np.int64)
    step = max(1, AT_ONCE // n)
    for low in range(0, FUNCTIONS, step):
        y = x ^ _FLIP[low : low + step]
        y *= _TIMES[low : low + step]
        row = _ROWS[: len(y)]
        for j in range(picks):
            at[low : low + step, j] = best = y.argmin(axis=1)
            y[row, best] = 0xFFFFFFFF
    at.sort(axis=1)
    out = _mixed((h[at] * _TAIL[:picks]).sum(axis=1, dtype=np.uint64))
    return (out >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    return signature(kmers(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of orderings in which two fingerprints agree."""
    return np.count_nonzero(a == b) / FUNCTIONS


def edited(text: str, other: str) -> str:
    """text with its last half, floor(n/2) characters, replaced by the first as many of other, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _RESULT.split(", ")]


class _Seen:
    """A text with its k-mers and its fingerprint."""

    def __init__(self, text: str):
        self.text, self.kmers = text, kmers(text)
        self.own = signature(self.kmers)


def _compared(doc_id, a: _Seen, b: _Seen) -> tuple:
    text, own, others, new = a.text, a.own, b.own, edited(a.text, b.text)
    changed = own if new == text else signature(spliced(text, b.text, a.kmers, b.kmers))
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes(), changed.astype(">u4").tobytes(), likeness(own, changed), likeness(own, others))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def compare_with_next(documents: DataFrame) -> DataFrame:
    """For each row its fingerprint, that of its edited text, and how like it is to that and to the next row, in falling
    order of doc_id (null last; ties by hash of the text, then text; after the last row comes the first).

    Texts are dealt once, by ranges of doc_id, and stream by in rising order, so that a row's next one has just passed:
    a worker holds two texts. A range's first row waits for the last one of the range before; these two rows a range
    are written with their texts and meet in a join. A null text is empty; a single row is its own next; only doc_id
    and text are read.
    """
    prepare(documents.sparkSession)
    columns = ["part", "kind", *_COLUMNS, "text"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        part, before = TaskContext.get().partitionId(), None
        for pdf in frames:
            out = []
            for doc_id, text in zip(pdf.doc_id.astype("Int64").tolist(), pdf.text.tolist()):
                now = _Seen(text)
                if before is None:
                    out.append((part, 1, doc_id, *[None] * 6, text))
                else:
                    out.append((part, 0, *_compared(doc_id, now, before), None))
                before = now
            yield _frame(out, columns)
        if before is not None:
            yield _frame([(part, 2, None, *[None] * 6, before.text)], columns)

    def close(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = zip(pdf.doc_id.astype("Int64").tolist(), pdf.text.tolist(), pdf.other.tolist())
            yield _frame([_compared(i, _Seen(t), _Seen(o)) for i, t, o in rows], _COLUMNS)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rising = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    walked = stored(texts.repartitionByRange(*rising).sortWithinPartitions(*rising, "text").select("doc_id", "text").mapInPandas(walk, f"part int, kind int, {_RESULT}, text string"))

    last = walked.where("kind = 2").select("part", F.col("text").alias("other"))
    every = W.orderBy("part")  # one row a range
    links = last.select("part", F.coalesce(F.lag("part").over(every), F.max("part").over(W.partitionBy())).alias("from_part"))
    first = walked.where("kind = 1").select("part", "doc_id", "text").join(links, "part").join(last.withColumnRenamed("part", "from_part"), "from_part")
    out = walked.where("kind = 0").select(*_COLUMNS).unionByName(first.select("doc_id", "text", "other").mapInPandas(close, _RESULT))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
