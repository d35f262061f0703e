"""What the training-data operators share: durable intermediate tables, null-safe texts, word arithmetic."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once, whichever is reached first; a longer row goes alone.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the Arrow batch size and, where a local run names none, a checkpoint folder; a cluster has to name one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for tables that are written and read back."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as durable() has it, but as a Parquet table in that folder: for many rows, in a fraction of the bytes."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, *arrays: np.ndarray) -> Broadcast:
    """The arrays as a broadcast of compressed bytes: bitmaps that are mostly zeros travel small."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return spark.sparkContext.broadcast([(a.dtype.str, pack(a.tobytes())) for a in arrays])


def shared(arrays: Broadcast) -> list[np.ndarray]:
    """What share() was given, unpacked once for a task."""
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(b), dtype) for dtype, b in arrays.value]


def bitmap_of(rows: DataFrame, number: Column, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits, with the bit of each row's number (a long) modulo 2**bits set; made by grouped
    aggregation, so what comes to the driver has that size whatever the rows."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    at = rows.select((F.pmod(number, F.lit(1 << bits)) + 1).alias("x"))  # these functions count from 1
    pieces = at.groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))
    for k, piece in pieces.collect():
        low = (k - 1) * 4096
        part = np.frombuffer(piece, np.uint8)[: len(out) - low]
        out[low : low + len(part)] |= part
    return out


def in_bitmap(bitmap: np.ndarray, numbers: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each number (int64) is set."""
    at = numbers & np.int64((1 << bits) - 1)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text leaves 2 on division by 4; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- vectorised word arithmetic on UTF-8 bytes

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
#: Bytes of text that are hashed at once, about, and powers that are kept for that; longer texts make their own.
_PIECE = 1 << 18
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, n: int, key: str) -> np.ndarray:
    found = _powers.get(key)
    if found is None or len(found) < n:
        steps = np.full(max(n, 2 * _PIECE), base, np.uint64)
        steps[0] = 1
        found = np.cumprod(steps, dtype=np.uint64)
        if n <= 2 * _PIECE:
            _powers[key] = found
    return found[:n]


#: What operators keep between a worker's tasks. A worker serves operators in turn, so each empties the others' first.
kept: list[dict] = []


def forget(mine: dict | None = None) -> None:
    """Empties what other operators than the one that keeps `mine` have kept in this worker process."""
    for other in kept:
        if other is not mine:
            other.clear()


class Words:
    """The words of several texts, as arrays over one byte buffer.

    raw: the bytes; start, end: each word's place in raw; hash: 64 bits that depend on the word's bytes alone;
    doc: the number of the word's text; first: for each text, the number of its first word, with the total at the end.
    """

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        n = len(self.raw)
        inside = ~_IS_SPACE[self.raw]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.raw] * _power_table(_MULT, n, "up"), dtype=np.uint64, out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * _power_table(_INV, n, "down")[self.start])
        self.offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))


def batches(texts: list[str | None], most: int = _PIECE, lower: bool = False):
    """(number of the first text, Words) for runs of texts of about `most` bytes; null is empty; lower: A-Z only."""
    run, size, begin = [], 0, 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        b = b.lower() if lower else b
        if run and size + len(b) > most:
            yield begin, Words(run)
            run, size, begin = [], 0, i
        run.append(b)
        size += len(b)
    if run:
        yield begin, Words(run)


_SHINGLE = mix64(np.arange(101, 201, dtype=np.uint64) * _MULT) | np.uint64(1)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles as sorted 64-bit hashes.

    A text of fewer than k words has its whole word sequence as one shingle; one without words has none.
    """
    out: list[np.ndarray] = []
    for _, w in batches(texts, lower=True):
        n = len(w.hash)
        sums = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            sums += w.hash[j : n - k + 1 + j] * _SHINGLE[j] if n >= k else 0
        sums = mix64(sums)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(sums[a : b - k + 1]))
            elif b > a:
                part = (w.hash[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64, keepdims=True)
                out.append(mix64(part + _SHINGLE[50 + b - a]))
            else:
                out.append(np.empty(0, np.uint64))
    return out


# ---------------------------------------------------------------- connected components

def forest_roots(parents: DataFrame) -> DataFrame:
    """(node, component): the root that each node of `parents` (node, parent < node, one row a node) reaches.

    Every round replaces a parent by its parent, so there are as many rounds as the depth has binary digits; a round is
    one join. Roots themselves are added at the end.
    """
    p = stored(parents.select("node", "parent"))
    while True:
        up = p.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        next_ = stored(p.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
        if not next_.where("moved").take(1):
            break
        p = next_.select("node", "parent")
    out = p.select("node", F.col("parent").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `edges` reaches, itself included.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the set of edges stands still; each
    step's edges go to the checkpoint folder. No node's neighbours are gathered in one place: a step is a grouped
    minimum and a join, whose hot keys adaptive execution splits. Null ends are ignored; an empty input gives no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, seen = durable(e), None
    while True:
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
