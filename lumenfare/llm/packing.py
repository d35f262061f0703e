"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents are dealt at random into blocks of about `BLOCK` pieces, whatever the corpus holds. Several islands evolve
packings of the same block, each from its own random start: a child takes whole well-filled bins of one parent, keeps
the other parent's bins that share no piece with them, and best-fits the displaced pieces, largest first. After an
epoch each island receives the elite of the next one. The best packing of a block stands. The bins that it leaves less
than well filled then meet the badly filled bins of other blocks in new blocks, starting from the packing that they
have, so that a round never adds a sequence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import durable, prepare
from lumenfare.llm.encoding import encoder

CAPACITY = 2048
#: Pieces that one task packs together, about.
BLOCK = 8192
ISLANDS = 3
#: Rounds of evolution with a migration of elites between them.
EPOCHS = 2
GENERATIONS = 80
POPULATION = 5
#: A bin with at most this much room is well filled.
SLACK = CAPACITY // 256
#: Rounds in which badly filled bins of different blocks meet.
MEETINGS = 2
#: Tasks of an epoch at most; beyond, a task evolves several islands one after the other.
MOST_TASKS = 100_000


class _Room:
    """Open bins by the room they have left: best fit in the time of a few operations on one long integer."""

    def __init__(self, capacity: int, room: np.ndarray):
        self.by, self.mask = [[] for _ in range(capacity + 1)], 0
        for i, r in enumerate(room.tolist()):
            if r > 0:
                self.by[r].append(i)
                self.mask |= 1 << r

    def take(self, size: int) -> int:
        """The bin with the least room that is enough, or -1; its room shrinks."""
        fits = self.mask >> size
        if not fits:
            return -1
        r = size + (fits & -fits).bit_length() - 1
        stack = self.by[r]
        i = stack.pop()
        if not stack:
            self.mask ^= 1 << r
        if r > size:
            self.open(i, r - size)
        return i

    def open(self, i: int, room: int) -> None:
        if not self.by[room]:
            self.mask |= 1 << room
        self.by[room].append(i)


def best_fit(sizes: np.ndarray, bins: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """bins with the pieces of `order` (which have bin -1) put where they fit best; new bins get the next numbers."""
    bins = bins.copy()
    used = int(bins.max(initial=-1)) + 1
    placed = bins >= 0
    room = _Room(capacity, capacity - np.bincount(bins[placed], sizes[placed], minlength=used).astype(np.int64))
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        at = room.take(size)
        if at < 0:
            at, used = used, used + 1
            if size < capacity:
                room.open(at, capacity - size)
        bins[i] = at
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def filled(sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A packing bin by bin: the largest piece left, then again and again the one or two pieces that leave least room."""
    order = np.argsort(sizes, kind="stable")
    starts = np.searchsorted(sizes[order], np.arange(capacity + 2))
    left, next_ = np.diff(starts), starts[:-1].copy()  # pieces of each size, and the place in order of the next of them
    bins, used, todo, top = np.empty(len(sizes), np.int32), 0, len(sizes), capacity
    while todo:
        while not left[top]:
            top -= 1
        room, put = capacity, (top,)
        while put:
            for size in put:
                bins[order[next_[size]]] = used
                next_[size] += 1
                left[size] -= 1
                room -= size
                todo -= 1
            have = np.flatnonzero(left[: room + 1])
            put = (int(have[-1]),) if len(have) else ()
            if put and put[0] < room:
                at = np.searchsorted(have, room - have, side="right") - 1
                at = np.where((at >= 0) & (have[at] == have) & (left[have] < 2), at - 1, at)
                total = np.where(at >= 0, have + have[at], 0)
                if total.max() > put[0]:
                    k = rng.choice(np.flatnonzero(total == total.max()))
                    put = (int(have[k]), int(have[at[k]]))
        used += 1
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray) -> float:
    """Fewer bins first, then uneven filling, which leaves room in one piece: higher is better."""
    fill = np.bincount(bins, sizes)
    return -float(len(fill)) + float((fill.astype(float) ** 2).mean()) / (4.0 * float(fill.max()) ** 2)


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with whole well-filled bins of b."""
    fill = np.bincount(b, sizes)
    good = np.flatnonzero(capacity - fill <= SLACK)
    if not len(good):
        good = np.argsort(-fill)[: max(1, len(fill) // 4)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.4))), replace=False)] = True
    taken = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[taken]] = True
    worst = np.bincount(a, sizes)
    hit[np.argsort(worst)[: max(1, len(worst) // 50)]] = True  # the emptiest bins are always opened
    displaced = hit[a] & ~taken
    child = np.where(displaced, -1, a)
    child[taken] = int(a.max()) + 1 + b[taken]
    kept = child >= 0
    child[kept] = np.unique(child[kept], return_inverse=True)[1]
    loose = np.flatnonzero(displaced)
    return best_fit(sizes, child, loose[np.argsort(-(sizes[loose] * rng.uniform(0.97, 1.03, len(loose))), kind="stable")], capacity)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The best packing after some generations from the elites, or else from best fit by falling size, from bins filled
    one by one, and from random best-fit starts. It ends early at the bound that no packing is below."""
    empty = np.full(len(sizes), -1, np.int32)
    people = list(elites) or [best_fit(sizes, empty, np.argsort(-sizes, kind="stable"), capacity)]
    bound = math.ceil(sizes.sum() / capacity)
    if min(int(p.max()) + 1 for p in people) <= bound:
        return max(people, key=lambda p: fitness(sizes, p))
    people.append(filled(sizes, capacity, rng))
    while len(people) < POPULATION:
        people.append(best_fit(sizes, empty, np.argsort(-(sizes * rng.uniform(0.9, 1.1, len(sizes))), kind="stable"), capacity))
    scores = [fitness(sizes, p) for p in people]
    for _ in range(GENERATIONS):
        if min(int(p.max()) + 1 for p in people) <= bound:
            break
        i, j = rng.choice(len(people), 2, replace=False)
        if scores[j] > scores[i] and rng.random() < 0.7:
            i, j = j, i
        child = crossover(sizes, people[i], people[j], capacity, rng)
        score, low = fitness(sizes, child), int(np.argmin(scores))
        if score > scores[low]:
            people[low], scores[low] = child, score
    return people[int(np.argmax(scores))]


def token_pieces(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and end_id, cut into pieces of capacity ids at most.

    The first piece takes what does not fill a whole one.
    """

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer, True), np.array([end_id], "<u4").tobytes()
        for pdf in frames:
            rows = []
            for doc_id, ids in zip(pdf.doc_id.tolist(), enc.encode(pdf.text.tolist())):
                ids += end
                n = len(ids) // 4
                cut = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(emit, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _round(items: DataFrame, blocks: int, capacity: int, seed: int, given: bool) -> DataFrame:
    """items (uid, length, seq, ...) with seq, the bin of each; given: items have a seq to begin with, whose pieces stay in one block."""
    key = F.col("seq") if given else F.col("uid")
    dealt = items.withColumn("block", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).cast("int"))
    if given:
        dealt = dealt.withColumn("bin", F.dense_rank().over(W.partitionBy("block").orderBy("seq")) - 1)
    else:
        dealt = dealt.withColumn("bin", F.lit(-1))
    dealt = durable(dealt.withColumn("rn", F.row_number().over(W.partitionBy("block").orderBy(F.desc("length"), "uid")) - 1))
    listed = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("rn", "length", "bin"))).alias("x"))
    start = F.array(F.col("x.bin")) if given else F.array().cast("array<array<int>>")
    state = listed.select("block", F.col("x.length").cast("array<int>").alias("sizes"), start.alias("elites")).withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))

    def emit(epoch: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                for block, sizes, elites, island in zip(pdf.block, pdf.sizes, pdf.elites, pdf.island):
                    rng = np.random.default_rng([seed, epoch, int(block), int(island)])
                    sizes = np.asarray(sizes, np.int64)
                    best = evolve(sizes, [np.asarray(e, np.int32) for e in elites], capacity, rng)
                    yield pd.DataFrame({"block": [block], "sizes": [sizes], "island": [island], "best": [best], "score": [fitness(sizes, best)]})

        return run

    for epoch in range(EPOCHS):
        spread = state.repartition(max(1, min(MOST_TASKS, blocks * ISLANDS)), "block", "island")
        done = durable(spread.select("block", "sizes", "elites", "island").mapInPandas(emit(epoch), "block int, sizes array<int>, island int, best array<int>, score double"))
        guest = done.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("best").alias("guest"))
        state = done.join(guest, ["block", "island"]).select("block", "sizes", "island", F.array("best", "guest").alias("elites"))
    best = done.groupBy("block").agg(F.max_by("best", F.struct("score", "island")).alias("best"))
    bins = best.select("block", F.posexplode("best").alias("rn", "at"))
    return dealt.drop("bin", "seq").join(bins, ["block", "rn"]).withColumn("seq", F.col("block").cast("long") * (1 << 24) + F.col("at")).drop("block", "rn", "at")


def pack(pieces: DataFrame, capacity: int = CAPACITY, seed: int = 11) -> DataFrame:
    """pieces with sequence_id and offset: every sequence holds at most capacity ids, gapless from 0.

    pieces needs a length from 1 to capacity; its rows are kept as they are, repeated ones too, with all their columns
    but `uid`, `seq`, `sequence_id` and `offset`, which this operator uses. Pieces of full length are sequences of
    their own. Ties break by row number. An empty table gives an empty result. Each block ends with bins in numbers of
    its own, so numbers are unique but not dense.
    """
    prepare(pieces.sparkSession)
    pieces = durable(pieces.drop("uid", "seq", "sequence_id", "offset").withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") >= capacity).select("uid", F.lit(0).alias("kind"), F.col("uid").alias("seq"), "length")
    items = pieces.where(F.col("length") < capacity).select("uid", "length", F.lit(None).cast("long").alias("seq"))
    n, kept, given = items.count(), [full], False
    for meeting in range(MEETINGS + 1):
        if not n:
            break
        blocks = max(1, round(n / BLOCK))
        packed = durable(_round(items, blocks, capacity, seed + meeting, given))
        if meeting == MEETINGS or blocks == 1:
            kept.append(packed.select("uid", F.lit(meeting + 1).alias("kind"), "seq", "length"))
            break
        room = capacity - F.sum("length").over(W.partitionBy("seq"))
        split = durable(packed.withColumn("well", room <= SLACK))
        kept.append(split.where("well").select("uid", F.lit(meeting + 1).alias("kind"), "seq", "length"))
        items = split.where("not well").select("uid", "length", "seq")
        n, given = items.count(), True
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    before = F.sum("length").over(W.partitionBy("kind", "seq").orderBy(F.desc("length"), "uid").rowsBetween(W.unboundedPreceding, -1))
    placed = out.select("uid", (F.col("seq") * 4 + F.col("kind")).alias("sequence_id"), F.coalesce(before, F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed, "uid").drop("uid")


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of documents.

    A null or empty text is the end id alone. Repeated rows are packed as often as they stand there; a null doc_id is
    kept. Only doc_id and text are read, so other columns can't clash.
    """
    prepare(documents.sparkSession)
    packed = pack(token_pieces(documents, tokenizer, end_id, capacity), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
