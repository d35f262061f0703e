"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Plan, in the order in which data move:

1. Every document becomes its set of hashed shingles inside the scan. Counting the shingles takes one shuffle of
   delta-coded 32-bit fingerprints, dealt by fingerprint range and added up as they stream by. It returns two tables of fixed size: the `FREQUENT` most frequent fingerprints, which give the
   rare-first order (rarer ones stand in hash order; any fixed order gives the same links), and a bitmap of
   fingerprints that occur twice or more, without which a shingle has no partner. Where the bitmap saturates, more
   prefix rows move and the links stay the same.
2. A second scan sorts each set by that order, keeps the prefix of length n - ceil(t n) + 1 without the shingles that
   occur once, and sums the set to 128 bits. Equal sets become one class, so that copies move as one.
3. Prefix rows meet by shingle. Each list first offers the pair (smallest class, member); the best such pair of each
   class is verified, and the links make components. This is linear in the rows.
4. Only lists that still hold two components offer pairs, and only pairs across components that pass the length and
   positional filters within the join, and the suffix filter after it: a Hamming bound from the counts of about as many
   hash classes as a set has shingles, of which the parities travel. No pair that links is lost to it, and hardly
   another passes. A pair is verified once, against the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import bitmap_of, connected_components, durable, forest_roots, forget, prepare, share, shared, shingle_sets, stored

#: Shingles that one counting range holds, about, and log2 of the number of ranges at most: beyond, a range holds more
#: rows, but no more different fingerprints than 2**32 / 2**MOST_RANGES.
RANGE, MOST_RANGES = 1 << 19, 14
#: Shingles that a task gathers before it hands them on.
FLUSH = 1 << 21
#: Fingerprints in the rare-first order at most.
FREQUENT = 1 << 17
#: A fingerprint below this document frequency is not put in order by frequency.
LEAST_DF = 8
#: log2 of the bits in the bitmap of repeated fingerprints (32 MB), and the bits of a piece in which it comes together.
BITMAP, PIECE = 28, 1 << 17
#: log2 of the bits in the bitmap of classes that need verifying (8 MB, few of them set).
WANTED = 26
#: log2 of the hash classes whose parities a set keeps at most; a set has 64 at least, and as many as shingles.
CLASSES = 17


def _parities(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of the set's hash classes (low bits of the hash), 64 to a long. Two sets' parities differ
    in no more classes than there are shingles in one set only."""
    bits = min(CLASSES, max(6, (len(s) - 1).bit_length()))
    counts = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _counted(prints: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in rising order, and the sums of their counts."""
    every = np.concatenate(prints)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[first], np.add.reduceat(np.concatenate(times)[order], first)


def _fingerprints(shift: int):
    """Tasks' sorted fingerprints, cut by range; differences in 16 bits, those that don't fit apart."""

    def rows(parts: list[np.ndarray]) -> pd.DataFrame:
        every = np.concatenate(parts)
        every.sort()
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        seen, times = every[first], np.diff(first, append=len(every)).astype(np.uint32)
        cut = np.flatnonzero(np.concatenate([[True], seen[1:] >> shift != seen[:-1] >> shift, [True]]))
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            r = int(seen[a]) >> shift
            step = np.diff(seen[a:b], prepend=np.uint32(r << shift))
            wide, more = step >= 65535, np.flatnonzero(times[a:b] > 1).astype(np.uint32)
            out.append((r, np.where(wide, 65535, step).astype(np.uint16).tobytes(), step[wide].tobytes(), more.tobytes(), times[a:b][more].tobytes()))
        return pd.DataFrame(out, columns=["r", "steps", "wide", "more", "times"])

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        held, size = [], 0
        for pdf in frames:
            for s in shingle_sets(pdf.text.tolist()):
                held.append((s >> np.uint64(32)).astype(np.uint32))
                size += len(s)
            if size >= FLUSH:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return emit


def _frequencies(shift: int):
    """Adds up the rows of each range, which come one after the other; what is held is summed as it doubles."""

    def done(r: int, seen: np.ndarray, df: np.ndarray) -> tuple:
        bits = np.unique(seen[df > 1] >> np.uint32(32 - BITMAP)).astype(np.int64)
        cut = np.flatnonzero(np.diff(bits // PIECE, prepend=-1))
        pieces = []
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(bits)]):
            map_ = np.zeros(PIECE, np.uint8)
            map_[bits[a:b] % PIECE] = 1
            pieces.append((int(bits[a]) // PIECE, zstandard.compress(np.packbits(map_, bitorder="little").tobytes(), 1)))
        often = df >= LEAST_DF
        return seen[often], df[often], pieces

    def table(found: list[tuple]) -> pd.DataFrame:
        prints, df, pieces = zip(*found)
        often = pd.DataFrame({"fp": np.concatenate(prints).astype(np.int64), "df": np.concatenate(df), "bitmap": None})
        pieces = [x for p in pieces for x in p]
        return pd.concat([often, pd.DataFrame({"fp": [k for k, _ in pieces], "df": -1, "bitmap": [b for _, b in pieces]}).astype({"fp": "int64", "df": "int64"})])

    def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        now, prints, counts, size, least, found = -1, [], [], 0, RANGE, []
        for pdf in frames:
            for r, steps, wide, more, times in zip(pdf.r, pdf.steps, pdf.wide, pdf["more"], pdf.times):
                if r != now:
                    if now >= 0:
                        found.append(done(now, *_counted(prints, counts)))
                    now, prints, counts, size, least = r, [], [], 0, RANGE
                step = np.frombuffer(steps, np.uint16).astype(np.uint32)
                step[step == 65535] = np.frombuffer(wide, np.uint32)
                n = np.ones(len(step), np.int64)
                n[np.frombuffer(more, np.uint32)] = np.frombuffer(times, np.uint32)
                prints.append(np.cumsum(step, dtype=np.uint32) + np.uint32(r << shift))
                counts.append(n)
                size += len(n)
                if size >= least:
                    prints, counts = ([x] for x in _counted(prints, counts))
                    size = len(prints[0])
                    least = 2 * size + RANGE
            if len(found) > 64:
                yield table(found)
                found = []
        if now >= 0:
            yield table([*found, done(now, *_counted(prints, counts))])

    return total


def _statistics(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequent fingerprints in rising order, their document frequencies, bitmap of repeated ones)."""
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(MOST_RANGES, max(1, math.ceil(math.log2(max(1, chars / 6 / RANGE)))))
    rows = texts.mapInPandas(_fingerprints(32 - bits), "r int, steps binary, wide binary, more binary, times binary")
    counted = durable(rows.repartition(max(1, (1 << bits) // 8), "r").sortWithinPartitions("r").mapInPandas(_frequencies(32 - bits), "fp long, df long, bitmap binary"))
    bitmap = np.zeros(1 << (BITMAP - 3), np.uint8)
    for k, bits in counted.where("df = -1").select("fp", "bitmap").toLocalIterator():
        bitmap[k * PIECE // 8 : (k + 1) * PIECE // 8] |= np.frombuffer(zstandard.decompress(bits), np.uint8)
    level = F.floor(F.log2("df") * 4)
    above, least = 0, 1 << 62
    for at, n in sorted(counted.where("df > 0").groupBy(level.alias("at")).count().collect(), reverse=True):
        if above + n > FREQUENT:
            break
        above, least = above + n, at
    often = counted.where(F.col("df") > 0).where(level >= least).select("fp", "df").toPandas().sort_values("fp")
    return often.fp.to_numpy(np.uint32), often["df"].to_numpy(np.int64), bitmap


def _signatures(arrays: Broadcast, percent: int):
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        prints, often, bitmap = shared(arrays)
        for pdf in frames:
            rows = []
            for doc_id, s in zip(pdf.doc_id.tolist(), shingle_sets(pdf.text.tolist())):
                n, fp = len(s), (s >> np.uint64(32)).astype(np.uint32)
                df = np.zeros(n, np.int64)
                if len(prints) and n:
                    at = np.minimum(np.searchsorted(prints, fp), len(prints) - 1)
                    df = np.where(prints[at] == fp, often[at], 0)
                order = np.lexsort((s, df))[: n - -(-percent * n // 100) + 1] if n else np.empty(0, int)
                bit = fp[order] >> np.uint32(32 - BITMAP)
                keep = (bitmap[bit >> np.uint32(3)] >> (bit & np.uint32(7)).astype(np.uint8)) & 1 == 1
                sums = (int(s.sum(dtype=np.uint64)), int((s * (s | np.uint64(1))).sum(dtype=np.uint64)))
                rows.append((doc_id, n, *(x - (x >> 63 << 64) for x in sums), _parities(s), s[order[keep]].view(np.int64), np.flatnonzero(keep).astype(np.int32)))
            out = pd.DataFrame(rows, columns=["doc_id", "n", "h1", "h2", "odd", "ps", "pp"])
            out["doc_id"] = out.doc_id.astype("Int64")
            yield out

    return emit


def _sets(wanted):
    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        (bits,) = shared(wanted)
        for pdf in frames:
            at = pdf.bucket.to_numpy(np.int64)
            pdf = pdf[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            items = [s.tobytes() for s in shingle_sets(pdf.text.tolist())]
            yield pd.DataFrame({"cls": pdf.doc_id, "items": items})

    return emit


def _overlap(percent: int):
    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return linked


def _folded(a: str, b: str) -> Column:
    """The parities a, where there are more of them than of b put together to those of half as many classes."""
    half = F.shiftright(F.size(a), 1)
    return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, half), F.slice(a, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))


def _least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """The smallest intersection with which sets of these sizes link."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def similar_documents(documents: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text; other columns are ignored).

    n_shingles: the size of the set of distinct 5-word shingles over words lower-cased in A-Z; a shorter text is one
    shingle; a null, empty or blank text has none and its component is itself. component_id: the smallest doc_id that
    links (100 |A∩B| >= percent |A∪B|) reach. Equal sets are linked. Rows that repeat a doc_id with another text count
    as texts of their own under that id; a row of null id gets its set's component, null if only it has that set.
    An empty table gives an empty result.
    """
    spark = prepare(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    arrays = share(spark, *_statistics(texts.select("text")))
    marks = stored(texts.mapInPandas(_signatures(arrays, percent), "doc_id long, n int, h1 long, h2 long, odd array<long>, ps array<long>, pp array<int>"))
    arrays.destroy()
    key = ["n", "h1", "h2"]
    classes = stored(marks.where("n > 0 and doc_id is not null").groupBy(key).agg(F.min("doc_id").alias("cls"), F.first("odd").alias("odd"), F.first("ps").alias("ps"), F.first("pp").alias("pp")))
    if not classes.take(1):
        return marks.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))

    by = W.partitionBy("shingle")
    posted = classes.select("cls", "n", F.explode(F.arrays_zip("ps", "pp")).alias("p")).select("cls", "n", F.col("p.ps").alias("shingle"), F.col("p.pp").alias("pos"))
    lead = F.min(F.struct("cls", "n", "pos")).over(by)
    lists = posted.withColumns({"lead": lead, "last": F.max("cls").over(by)}).where("lead.cls < last")
    lists = stored(lists.select("shingle", "cls", "n", "pos", F.col("lead.cls").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.pos").alias("lead_pos")))

    sizes = classes.select("cls", "n", "odd")
    linked = _overlap(percent)
    addressed = texts.where("doc_id is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(1 << WANTED)))

    def sets(ids: DataFrame) -> tuple[DataFrame, Broadcast]:
        """(cls, items) of the documents named in the one column of ids, and of a few others: a bitmap of the ids goes
        to the scan, so that texts never move."""
        wanted = share(spark, bitmap_of(ids.toDF("cls"), F.xxhash64("cls"), WANTED))
        return addressed.mapInPandas(_sets(wanted), "cls long, items binary"), wanted

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b), those that pass the suffix filter and link; sets of b move twice, of a once."""
        x = pairs.join(sizes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob")), "b")
        for _ in range(math.ceil(math.log2(100 / percent))):  # sizes that may link differ by so many doublings at most
            x = x.withColumns({"oa": _folded("oa", "ob"), "ob": _folded("ob", "oa")})
        apart = F.aggregate(F.zip_with("oa", "ob", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
        x = stored(x.where(apart <= F.col("na") + F.col("nb") - 2 * _least_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b"))
        (b, of_b), (a, of_a) = sets(x.select("b")), sets(x.select("a"))
        out = stored(x.join(b.toDF("b", "ib"), "b").join(a.toDF("a", "ia"), "a").where(linked("ia", "ib")).select("a", "b"))
        of_a.destroy()
        of_b.destroy()
        return out

    def possible(na: Column, pa: Column, nb: Column, pb: Column) -> Column:
        """Length and positional filters at the first shingle that two sets have in common."""
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa, nb - pb) >= _least_overlap(na, nb, percent))

    led = lists.where("cls <> lead").where(possible(F.col("n"), F.col("pos"), F.col("lead_n"), F.col("lead_pos")))
    best = led.groupBy(F.col("cls").alias("b"), F.col("lead").alias("a")).count().groupBy("b").agg(F.max(F.struct("count", (-F.col("a")).alias("a"))).alias("m"))
    star = verified(best.select((-F.col("m.a")).alias("a"), "b"))
    first = stored(forest_roots(star.select(F.col("b").alias("node"), F.col("a").alias("parent"))))

    comp = lists.select("shingle", "cls", "n", "pos").join(first.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    open_ = stored(comp.withColumns({"low": F.min("comp").over(by), "high": F.max("comp").over(by)}).where("low < high").select("shingle", "cls", "n", "pos", "comp"))
    l, r = open_.alias("l"), open_.alias("r")
    pairs = l.join(r, (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.comp") < F.col("r.comp")) & possible(F.col("l.n"), F.col("l.pos"), F.col("r.n"), F.col("r.pos")))
    rest = verified(pairs.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct())
    joined = first
    if rest.take(1):  # the components that these links join, and what became of each
        of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
        links = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = stored(connected_components(links).withColumnRenamed("component", "into"))
        known = first.join(merged.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
        joined = known.unionByName(merged.join(first.select("node"), "node", "left_anti").select("node", F.col("into").alias("component")))

    found = classes.select(*key, "cls").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").select(*key, F.coalesce("component", "cls").alias("component"))
    return marks.select("doc_id", *key).join(found, key, "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, percent: int = 80) -> DataFrame:
    """documents without the rows whose component has a smaller doc_id, with one row of each doc_id; columns as given.

    An id is one document: its rows make one component, and of rows that repeat an id the one with the smallest hash of
    its text stays. Rows of null id stay.
    """
    found = similar_documents(documents, percent).where("doc_id > component_id").select("doc_id").distinct()
    kept = documents.join(found, "doc_id", "left_anti").select(*documents.columns)
    again = stored(documents.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n_")).where("n_ > 1").select("doc_id"))
    if not again.take(1):
        return kept
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64(F.col("text").cast("string"))))
    first = kept.join(again, "doc_id", "left_semi").withColumn("place_", place).where("place_ = 1")
    return kept.join(again, "doc_id", "left_anti").select(*documents.columns).unionAll(first.select(*documents.columns))
