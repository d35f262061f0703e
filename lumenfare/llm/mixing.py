"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A source of size S words with target T gives each of its documents T / S expected copies: a whole part that all
documents get, and a fraction that is rounded. Two documents of fractions f, g and sizes s, t exchange word mass until
one fraction is 0 or 1: up by min((1-f)s, gt) or down by min(fs, (1-g)t), with the odds that keep every document's
expected copies. So the expected words of a source never change while its documents become whole one by one.

The exchange runs in groups of at most `GROUP` documents, dealt by a hash of the id, within one `aggregate` call each;
a group leaves at most one open document, and these meet in the next level's groups, `GROUP` to one, until a source has
one left. Documents above their source's mean size are rounded first. Their last open document is drawn, and the words
that the draw adds or lacks are spread over the fractions of the smaller documents, which are rounded after them; so a
source misses its target by less than one document of mean size, unless the smaller ones can't take that much.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import durable, prepare

WEIGHTS = (5, 2, 1)
MOST = 3
#: Documents that one group exchanges mass among, at most.
GROUP = 64
#: Tables of one row per source are broadcast up to so many sources, a few MB; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: A fraction this near to 0 or 1 is whole.
NEAR = 1e-9
_ITEM = "struct<k:bigint,doc_id:bigint,size:bigint,f:double>"
_DONE = "array<struct<doc_id:bigint,size:bigint,up:int>>"


def target_words(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, docs, source_size, target, number) for sources of `sizes` (source, size).

    Weights repeat over the sources in code point order, null last; targets share all words by weight and stop at
    `most` times the source's size, the excess shared by weight among the others. That is the level at which capped
    targets fill the total: sorted by cap / weight, each source in turn is capped while the level of those from it on
    is above its cap. One row per source passes through one task here, never documents.
    """
    s = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("number", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("w"), "number")
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(everything))
    return s.select("source", "docs", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"), "number")


def _exchange(seed: int) -> str:
    """Folds the array `items` to c, the document left open if any, and d, those that became whole."""
    uniform = f"(pmod(xxhash64(p.a.k, p.b.k, {seed}), 1000003) + 0.5D) / 1000003"
    whole = lambda f: f"({f} <= {NEAR} or {f} >= 1 - {NEAR})"
    put = lambda x, f: f"case when {whole(f)} then named_struct('doc_id', {x}.doc_id, 'size', {x}.size, 'up', cast(round({f}) as int)) end"
    left = lambda x, f: f"when not {whole(f)} then named_struct('k', {x}.k, 'doc_id', {x}.doc_id, 'size', {x}.size, 'f', {f})"
    after = f"named_struct('c', case {left('p.a', 'q.f')} {left('p.b', 'q.g')} end, 'd', concat(s.d, filter(array({put('p.a', 'q.f')}, {put('p.b', 'q.g')}), z -> z is not null)))"
    moved = f"transform(array(case when {uniform} * (p.up + p.down) < p.down then p.up else -p.down end), m -> transform(array(named_struct('f', p.a.f + m / p.a.size, 'g', p.b.f - m / p.b.size)), q -> {after})[0])[0]"
    pair = "named_struct('a', s.c, 'b', x, 'up', least((1 - s.c.f) * s.c.size, x.f * x.size), 'down', least(s.c.f * s.c.size, (1 - x.f) * x.size))"
    return f"aggregate(items, named_struct('c', cast(null as {_ITEM}), 'd', cast(array() as {_DONE})), (s, x) -> case when s.c is null then named_struct('c', x, 'd', s.d) else transform(array({pair}), p -> {moved})[0] end)"


def _rounded(items: DataFrame, most_docs: int, seed: int) -> DataFrame:
    """(number, doc_id, size, up, off): up in 0 or 1 for items (number, docs, k, doc_id, size, f); off: words by which the last, drawn document misses."""
    level = items.withColumn("cell", F.pmod("k", F.greatest(F.lit(1), F.ceil(F.col("docs") / (GROUP // 2)))).cast("long"))
    cells, settled = max(1, -(-most_docs // (GROUP // 2))), []
    while True:
        rank = F.row_number().over(W.partitionBy("number", "cell").orderBy("k", "doc_id", "size"))
        grouped = level.withColumn("part", F.floor((rank - 1) / GROUP)).groupBy("number", "cell", "part").agg(F.array_sort(F.collect_list(F.struct("k", "doc_id", "size", "f"))).alias("items"))
        folded = durable(grouped.withColumn("s", F.expr(_exchange(seed))).select("number", "cell", "s"))
        settled.append(folded.select("number", F.explode("s.d").alias("d")).select("number", "d.*", F.lit(0.0).alias("off")))
        level = folded.where("s.c is not null").select("number", (F.floor(F.col("cell") / GROUP)).alias("cell"), "s.c.*")
        if cells == 1 and not level.groupBy("number").count().where("count > 1").take(1):
            break
        cells, seed = -(-cells // GROUP), seed + 1
    drawn = F.when((F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1000003)) + 0.5) / 1000003 < F.col("f"), 1).otherwise(0)
    settled.append(level.withColumn("up", drawn).select("number", "doc_id", "size", "up", ((F.col("up") - F.col("f")) * F.col("size")).alias("off")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of documents (doc_id, text, source).

    size: words `[^\\x20\\x09-\\x0D]+` of the whole text, null: 0. taken = copies * size; copies is the floor or the
    ceiling of target / source_size, so at most `most`. A row without words, or of a source without words, is taken 0
    times (copies 0). A null source is a source, the last; a null doc_id is an id. Rows that repeat a source, doc_id and
    size are rows of their own and interchangeable: they are counted first and drawn under numbers, so that no group of
    repeats comes together. The draw depends on ids, sizes and seed, not on how rows lie in files; an empty table gives an
    empty result. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    given = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"))
    rows = given.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times"))
    rows = durable(rows.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times"))
    sources = durable(target_words(rows, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("base", F.floor(rate + NEAR).cast("int")).withColumn("f", F.greatest(F.lit(0.0), rate - F.col("base")))
    most_docs, n_sources = sources.agg(F.max("docs"), F.count("*")).first()
    most_docs = most_docs or 0
    side = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    s = side(sources.withColumnRenamed("source", "source_"))
    rows = rows.join(s, F.col("source").eqNullSafe(F.col("source_")))
    open_ = (F.col("f") > NEAR) & (F.col("size") > 0)
    items = rows.where(open_).select("number", "docs", F.abs(F.xxhash64("doc_id", "size", "again", F.lit(seed))).alias("k"), "doc_id", "size", "f", (F.col("size") * F.col("docs") > F.col("source_size")).alias("large"))
    large = durable(_rounded(items.where("large").drop("large"), most_docs, seed))
    small = items.where("not large").drop("large")
    spread = sources.select("number").join(large.groupBy("number").agg(F.sum("off").alias("off")), "number", "left").join(small.groupBy("number").agg(F.sum("size").alias("words")), "number", "left")
    spread = durable(spread.select("number", F.coalesce(F.col("off") / F.col("words"), F.lit(0.0)).alias("shift")))
    shifted = small.join(side(spread), "number").withColumn("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f") - F.col("shift")))).drop("shift")
    out = large.unionByName(_rounded(shifted, most_docs, seed + 100)).select("number", "doc_id", "size", "up")
    out = out.unionByName(rows.where(~open_).select("number", "doc_id", "size", F.lit(0).alias("up")))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("up")).otherwise(0)
    return out.join(side(sources), "number").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), copies.cast("long").alias("copies"), "source")


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """documents with each row as many times as the mix takes it, with its columns; rows without words go.

    The copies of a source differ by one at most, so of rows that repeat a source, doc_id and size the first ones, by a
    hash of the text, get the larger number as often as the mix gave it: each source's words are those of the mix.
    """
    taken = mix(documents, weights, most, seed).groupBy(F.col("source").alias("source_"), F.col("doc_id").alias("doc_id_"), F.col("size").alias("size_")).agg(F.count("*").alias("times_"), F.min("copies").alias("low_"), F.max("copies").alias("high_"), F.sum("copies").alias("sum_"))
    taken = durable(taken.where("high_ > 0").withColumn("up_", F.col("sum_") - F.col("low_") * F.col("times_")))
    size = F.regexp_count(F.coalesce(documents["text"].cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    same = lambda t: documents.join(t, documents["source"].eqNullSafe(F.col("source_")) & documents["doc_id"].cast("long").eqNullSafe(F.col("doc_id_")) & (size == F.col("size_")))
    uneven = (F.col("times_") > 1) & (F.col("up_") > 0)
    again = lambda df: df.withColumn("again_", F.explode(F.array_repeat(F.lit(1), F.col("copies_").cast("int")))).select(*[documents[c] for c in documents.columns])
    out = again(same(taken.where(~uneven)).withColumn("copies_", F.col("sum_") / F.col("times_")))
    if not taken.where(uneven).take(1):
        return out
    place = F.row_number().over(W.partitionBy("source_", "doc_id_", "size_").orderBy(F.xxhash64(documents["text"].cast("string"))))
    return out.unionAll(again(same(taken.where(uneven)).withColumn("copies_", F.col("low_") + F.when(place <= F.col("up_"), 1).otherwise(0))))
