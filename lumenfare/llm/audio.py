"""Chroma audio fingerprints of media columns, and the alignment of recordings by them.

A recording (WAV bytes of any rate) becomes frames of energy by pitch class. A summed-area table over (frame, class)
gives each of 16 rectangle filters its two sums in eight reads; the log ratio, quantised to two bits in Gray code,
makes one 32-bit integer per place. Recordings with equal fingerprints are one class. Queries meet all classes at every
offset: the share of differing bits along an offset is the distance, and the offset histogram of equal integers chooses
among offsets within its bound. Blocks of queries and parts of the classes meet by join, so that a task holds one of each.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import durable, forget, prepare

RATE, FRAME, HOP = 4000, 1024, 256
#: Frames that a filter sees; integers are one frame apart.
DEPTH = 16
LEVELS = (-0.25, 0.0, 0.25)
#: Equal integers at one offset that a match of less than LEAST_COVER of the shorter recording has at least, and the
#: share of differing bits that every match has at most.
LEAST_HITS, MOST_ERROR = 4, 0.25
LEAST_COVER = 0.75
#: Integers, about, of a block of queries, of a part of the classes, and of the recordings that are compared at once.
BLOCK, PART, BATCH = 1 << 18, 1 << 16, 1 << 16
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int, int]]:
    """16 filters (kind, first class, classes, first frame, frames) by rule: four kinds at four places and widths."""
    return [(kind, (3 * k + 2 * kind) % 9, 3 if kind % 2 else 4 - k % 2, k * 2, DEPTH - 4 * k if k else DEPTH) for kind in range(4) for k in range(4)]


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """Energy by pitch class (A = 0) of each frame, scaled to unit length; silence is zeros."""
    if len(samples) < FRAME:
        samples = np.pad(samples, (0, FRAME - len(samples)))
    frames = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = (hz >= 55) & (hz <= min(rate / 2, 3520))
    note = np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12
    out = np.zeros((len(frames), 12))
    for c in range(12):
        out[:, c] = power[:, use][:, note == c].sum(1)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-6)


def fingerprint(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """One uint32 per frame from which DEPTH frames follow; a shorter recording is padded with silence to one."""
    image = chroma(samples, rate)
    if len(image) < DEPTH:
        image = np.pad(image, ((0, DEPTH - len(image)), (0, 0)))
    table = np.zeros((len(image) + 1, 13))
    table[1:, 1:] = image.cumsum(0).cumsum(1)
    n = len(image) - DEPTH + 1
    at = np.arange(n)
    area = lambda t0, t1, c0, c1: table[at + t1, c1] - table[at + t0, c1] - table[at + t1, c0] + table[at + t0, c0]
    out = np.zeros(n, np.uint32)
    for kind, c0, nc, t0, nt in filters():
        t1, c1, tm, cm = min(DEPTH, t0 + nt), c0 + nc, t0 + max(1, min(DEPTH - t0, nt) // 2), c0 + max(1, nc // 2)
        whole = area(t0, t1, c0, c1)
        if kind == 0:
            a, b = whole, area(t0, t1, 0, 12) - whole
        elif kind == 1:
            a = area(t0, t1, c0, cm)
            b = whole - a
        elif kind == 2:
            a = area(t0, tm, c0, c1)
            b = whole - a
        else:
            a = area(t0, tm, c0, cm) + area(tm, t1, cm, c1)
            b = whole - a
        level = np.digitize(np.log((1e-2 + np.maximum(a, 0)) / (1e-2 + np.maximum(b, 0))), LEVELS)
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def to_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())
    return f.getvalue()


def from_wav(media: bytes | None) -> tuple[np.ndarray, int]:
    """(samples on the 16-bit scale, rate); null, broken or empty media has no samples.

    Samples have 8, 16, 24 or 32 bits; of several channels the first counts, and of media cut short the whole frames.
    """
    try:
        with wave.open(io.BytesIO(media or b"")) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return np.empty(0, np.float64), RATE
    if width not in (1, 2, 3, 4) or rate <= 0:
        return np.empty(0, np.float64), RATE
    frames = np.frombuffer(raw, np.uint8)[: len(raw) // (width * channels) * width * channels].reshape(-1, channels, width)[:, 0]
    if width == 1:
        return (frames[:, 0].astype(np.float64) - 128) * 256, rate
    wide = np.zeros((len(frames), 4), np.uint8)
    wide[:, 4 - width :] = frames  # the sample's bytes are the upper ones of 32 bits
    return wide.view("<i4")[:, 0] / 65536.0, rate


def at_rate(samples: np.ndarray, rate: int, wanted: int = RATE) -> np.ndarray:
    """Samples of one rate at another: means over the new steps where it is lower, linear between where it is higher."""
    if rate == wanted or not len(samples):
        return samples
    n = max(1, len(samples) * wanted // rate)
    edge = np.arange(n + 1) * (rate / wanted)
    if rate < wanted:
        return np.interp(edge[:-1], np.arange(len(samples)), samples)
    total = np.concatenate([[0.0], np.cumsum(samples, dtype=np.float64)])
    return np.diff(np.interp(edge, np.arange(len(total)), total)) * (wanted / rate)


def render(vector, step: int = FRAME // 4) -> bytes:
    """A melody of one note per value of a vector, so that a table of vectors can stand in for a media column.

    A value's note is its standard score within the vector in steps of 3 semitones about A4, within two octaves.
    """
    v = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in (vector if vector is not None else [])], float)
    if not len(v):
        return to_wav(np.empty(0))
    z = (v - v.mean()) / (v.std() or 1.0)
    hz = 440 * 2 ** (np.clip(np.round(3 * z), -12, 12) / 12)
    phase = np.cumsum(np.repeat(2 * np.pi * hz / RATE, step))
    return to_wav(12000 * np.sin(phase))


def media_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, media) rendered from embeddings (vec_id, embedding); the bytes are made where they are read."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in frames:
            yield pd.DataFrame({"vec_id": pdf.vec_id.astype("Int64"), "media": [render(v) for v in pdf.embedding]})

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(emit, "vec_id long, media binary")


def fingerprints(recordings: DataFrame) -> DataFrame:
    """(vec_id, ints) of recordings (vec_id, media); integers as signed 32-bit, none for media without samples. All rates
    are brought to RATE first, so that frames last equally long."""
    prepare(recordings.sparkSession)

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in frames:
            ints = []
            for m in pdf.media:
                x = at_rate(*from_wav(m))
                ints.append(fingerprint(x).view(np.int32) if len(x) else np.empty(0, np.int32))
            yield pd.DataFrame({"vec_id": pdf.vec_id.astype("Int64"), "ints": ints})

    return recordings.select("vec_id", "media").mapInPandas(emit, "vec_id long, ints array<int>")


def best_offsets(a: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number, offset, hits, error in ten-thousandths) for those of the others that align with a at some offset."""
    return next(_aligned([a], others))


def _aligned(queries: list[np.ndarray], others: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """best_offsets of each query. Every other that some offset can align is compared at every offset: those that stay
    within MOST_ERROR at an offset of LEAST_COVER, and those that hold LEAST_HITS integers of the query anywhere."""
    size = np.array([len(b) for b in others])
    n, k = int(size.max()), len(others)
    whole, within = np.zeros((n, k), np.uint32), np.arange(n)[:, None] < size
    for c, b in enumerate(others):
        whole[: len(b), c] = b
    values, code = np.unique(whole, return_inverse=True)
    code, bands = code.reshape(n, k).astype(np.int32), {}
    for a in queries:
        m = len(a)
        if m not in bands:
            bands[m] = _band(m, size)
        low, limit = bands[m]
        wrong = np.zeros(limit.shape, np.uint16 if min(m, n) < 2048 else np.uint32)
        for i in range(m):
            begin, end = max(0, i + low), min(n, i + low + len(limit))
            if begin < end:
                bits = np.bitwise_count(whole[begin:end] ^ a[i])
                wrong[begin - i - low : end - i - low] += bits if size.min() == n else bits * within[begin:end]
        held, at = np.zeros(len(values), bool), np.searchsorted(values, a)
        held[at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == a)]] = True
        hit = (held[code] & within).sum(0) >= LEAST_HITS
        may = np.flatnonzero((wrong <= limit).any(0) | hit)
        which, *rest = _compared(a, whole[:, may], size[may])
        yield may[which], *rest


def _band(m: int, size: np.ndarray) -> tuple[int, np.ndarray]:
    """The first offset at which a query of m integers covers LEAST_COVER of the shorter recording for any of the sizes,
    and, for each offset from there to the last such one and each size, the most wrong bits that a match by its cover may
    have (-1: the cover is less)."""
    offset = np.arange(1 - m, int(size.max()))
    overlap = np.minimum(m, size - offset[:, None]) - np.maximum(0, -offset)[:, None]
    covers = overlap >= LEAST_COVER * np.minimum(m, size)
    low, high = np.flatnonzero(covers.any(1))[[0, -1]]
    most = np.where(covers, np.ceil((MOST_ERROR + 5e-5) * 32 * overlap), -1)[low : high + 1]
    return int(offset[low]), most.astype(np.int64)


def _compared(a: np.ndarray, stack: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """best_offsets of one query by all offsets; stack: the others as columns of as many integers as size says."""
    (n, k), m = stack.shape, len(a)
    if not k:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    inside = (np.arange(n)[:, None] < size).astype(np.uint8) if size.min() < n else None
    offset = np.arange(1 - m, n)
    overlap = np.minimum(m, size - offset[:, None]) - np.maximum(0, -offset)[:, None]
    kind = np.uint16 if min(m, n) < 2048 else np.uint32
    wrong = np.zeros((m + n - 1, k), kind)
    for i in range(m):
        bits = np.bitwise_count(stack ^ a[i])
        wrong[m - 1 - i : m - 1 - i + n] += bits if inside is None else bits * inside
    covers = overlap >= LEAST_COVER * np.minimum(m, size)
    allowed = (covers | (overlap >= LEAST_HITS)) & (wrong <= (MOST_ERROR + 5e-5) * 32 * overlap)
    which = np.flatnonzero(allowed.any(0))
    allowed, covers, part, within = allowed[:, which], covers[:, which], stack[:, which], None if inside is None else inside[:, which]
    hits = np.zeros((m + n - 1, len(which)), np.int32)
    for i in range(m):
        same = part == a[i]
        hits[m - 1 - i : m - 1 - i + n] += same if within is None else same & (within > 0)
    hits[~(allowed & (covers | (hits >= LEAST_HITS)))] = -1
    keep = hits.max(0, initial=-1) >= 0
    which, hits = which[keep], hits[:, keep]
    error = np.where(hits == hits.max(0, initial=-1), wrong[:, which] / (32.0 * np.maximum(overlap[:, which], 1)), np.inf)
    at, here = error.argmin(0), np.arange(len(which))
    return which, offset[at], hits[at, here], np.floor(error[at, here] * 1e4 + 0.5).astype(np.int32)


def _meet(key: tuple, queries: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
    """One row for each query of a block with the classes of a part that align with it."""
    out = {int(q): [] for q in queries.class_id}
    asked = [np.asarray(x, np.int32).view(np.uint32) for x in queries.ints]
    ints = [np.asarray(x, np.int32).view(np.uint32) for x in classes.ints]
    ids, order, longest = classes.class_id.to_numpy(), np.argsort([len(x) for x in ints], kind="stable"), max(map(len, asked), default=0)
    first = 0
    while first < len(order):
        last = first + 1  # as many recordings of like length as a batch holds, one at least
        while last < len(order) and (last + 1 - first) * (longest + len(ints[order[last]])) <= 2 * BATCH:
            last += 1
        batch = order[first:last]
        for q, (which, offset, hits, error) in zip(out, _aligned(asked, [ints[k] for k in batch])):
            r = ids[batch[which]]
            out[q].append(np.array([r, offset, hits, error])[:, r != q])
        first = last
    rows = [(q, *np.concatenate(x, axis=1)) for q, x in out.items() if x]
    return pd.DataFrame([r for r in rows if len(r[1])], columns=["q", "r", "offset", "hits", "error"])


def align(recordings: DataFrame, every: int = 50) -> DataFrame:
    """(vec_id, class_id, n_ints, matches) for every recording (vec_id, media).

    class_id: the smallest vec_id of the same fingerprint. matches: for queries, which are the rows whose id `every`
    divides, `class:offset:hits:error` of each other class that aligns, by class, comma-joined; null for other rows.
    offset: frames by which the class lags; hits: equal integers at it; error: share of differing bits to 4 places over
    the overlap. Classes align when some offset has at most MOST_ERROR and either LEAST_HITS or an overlap of LEAST_COVER
    of the shorter one; of such offsets the one of most hits is given, then of least error, then the smallest. All
    offsets that can hold such a match are compared for all classes, so no pair is missed, at a cost of queries times
    classes.
    Only classes move in the search, so copies are never paired. Rows of null id have no class and no matches; media
    without samples are one class that aligns with none; repeated rows keep a row each.
    """
    rows = durable(fingerprints(recordings).withColumn("sum", F.xxhash64("ints")))
    classes = durable(rows.where("vec_id is not null").groupBy("sum").agg(F.min("vec_id").alias("class_id"), F.first("ints").alias("ints"), F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked")))
    whole = classes.where(F.size("ints") > 0)
    total = whole.agg(F.sum(F.size("ints").cast("long")).alias("all"), F.sum(F.when(F.col("asked") == 1, F.size("ints").cast("long"))).alias("asked")).first()
    blocks, parts = 1 + (total["asked"] or 0) // BLOCK, 1 + (total["all"] or 0) // PART
    dealt = lambda n: F.pmod(F.xxhash64("class_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tasks = max(1, min(blocks * parts, 4096))
    q = whole.where("asked = 1").select("class_id", "ints", dealt(blocks).alias("block"), each(parts).alias("part")).repartition(tasks, "block", "part")
    r = whole.select("class_id", "ints", dealt(parts).alias("part"), each(blocks).alias("block")).repartition(tasks, "block", "part")
    met = q.groupBy("block", "part").cogroup(r.groupBy("block", "part")).applyInPandas(_meet, "q long, r array<long>, offset array<int>, hits array<int>, error array<int>")
    pairs = F.flatten(F.collect_list(F.arrays_zip("r", "offset", "hits", "error")))
    said = lambda p: F.concat_ws(":", p["r"], p["offset"], p["hits"], p["error"] / 10000.0)
    found = met.groupBy("q").agg(F.array_join(F.transform(F.array_sort(pairs), said), ",").alias("matches"))
    named = classes.join(found.withColumnRenamed("q", "class_id"), "class_id", "left").select("sum", "class_id", "matches")
    asked = F.col("vec_id") % every == 0
    return rows.join(named, "sum", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("class_id")).alias("class_id"), F.size("ints").cast("long").alias("n_ints"), F.when(asked, F.coalesce("matches", F.lit(""))).alias("matches"))
