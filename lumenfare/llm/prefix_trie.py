"""The trie of conversations that begin alike, from rows of (conversation, depth) alone.

Each node belongs to its smallest member. A conversation that is the smallest member of a node is so of every deeper
node on its path, so what it owns is a suffix of its path and one number says it: the depth from which it owns. Every
sum over a subtree is then a sum over the members of its top: a member adds the words it has from there on, less those
of its owned nodes from there on, and one leaf if it owns the childless node at its end. One grouping by prefix gives
members, children, leaves and saved words of every node.

A prefix is 128 bits: two exclusive-or sums of hashes of (depth, role, text), which running windows carry. Windows run
over blocks of BLOCK places of one conversation, and the blocks' totals are summed apart, so that a long conversation
takes many tasks. No window goes by prefix: the root and common openings hold any share of all conversations, and
grouped minima with map-side combining find the owners instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.llm.common import WORD, prepare, stored

#: Places of a conversation whose running sums one window makes; conversations whose ids one string of a digest joins.
BLOCK, JOINED = 1024, 1 << 14
_NODE = ["depth", "p1", "p2"]
_MIX = {"n": (F.sum, lambda a, b: a + b), "x": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def running(df: DataFrame, key: str, block: Column, order: list, what: dict[str, tuple[str, str]], total: str | None = None) -> DataFrame:
    """df with, for each name of `what`, the running sum ("n") or exclusive or ("x") of a column over a key's rows up to
    and with this one, by block and order; `total`: a name whose sum over all of the key's rows is added as all_<name>."""
    df = df.withColumn("_block", block)
    near = W.partitionBy(key, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inner = df.withColumns({f"_{n}": _MIX[k][0](c).over(near) for n, (k, c) in what.items()})
    whole = df.groupBy(key, "_block").agg(*[_MIX[k][0](c).alias(f"_b_{n}") for n, (k, c) in what.items()])
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    first = whole.select(key, "_block", *[F.coalesce(_MIX[k][0](f"_b_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n, (k, _) in what.items()], *([F.sum(f"_b_{total}").over(W.partitionBy(key)).alias(f"all_{total}")] if total else []))
    out = inner.join(first, [key, "_block"])
    return out.select(*[c for c in df.columns if c != "_block"], *[_MIX[k][1](F.col(f"_b_{n}"), F.col(f"_{n}")).alias(n) for n, (k, _) in what.items()], *([f"all_{total}"] if total else []))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, z1, z2, words): every turn's place in its conversation from 0, by turn (null first), then role and
    hash, and two hashes of role and text. Rows without a conv_id are in no conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("z1"), F.xxhash64(text, F.lit(2), role).alias("z2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 63)))
    placed = running(t, "conv_id", block, [F.asc_nulls_first("turn"), "role", "z1", "z2"], {"place": ("n", "one")})
    return placed.select("conv_id", (F.col("place") - 1).alias("pos"), "z1", "z2", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, depth, length, z1, z2, words) of conversations rebuilt with their family's opening, depth 0 included.

    A conversation c takes the first h turns of c - c % family, h = crc32(decimal c) % most, and its own after its first
    h; at most most - 1 turns of one conversation in `family` are repeated, for `family` conversations each.
    """
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % family
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    c = n.select("conv_id", "n", base.alias("base"), h.alias("h")).join(n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    c = c.select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"), "n")
    c = c.withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    heads = heads.join(c, "base").where("pos < k").select("conv_id", (F.col("pos") + 1).alias("depth"), "length", "z1", "z2", "words")
    tails = turns.join(c, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k") + 1).alias("depth"), "length", "z1", "z2", "words")
    roots = c.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", *[F.lit(0).cast("long").alias(x) for x in ("z1", "z2", "words")])
    return heads.unionByName(tails).unionByName(roots)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the conv_ids of each node, ascending. Ids are joined by ranges of JOINED of them;
    a node's ranges then stream through its digest, so no list of a node's ids is held."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for pdf in frames:
            out = []
            for *here, ids in zip(*[pdf[c].tolist() for c in (*_NODE, "ids")]):
                if here == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        out.append((*node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256()
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=[*_NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*_NODE, "ends_sha256"])

    part = ends.groupBy(*_NODE, F.floor(F.col("conv_id") / JOINED).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return part.repartition(*_NODE).sortWithinPartitions(*_NODE, "range").mapInPandas(emit, "depth long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node of paths
    (conv_id, depth, length, z1, z2, words), where each conversation has the depths from 0 to its length.

    Exact copies share all their nodes; a conversation of no turns ends at the root; no paths have no nodes.
    """
    tag = lambda k: F.when(F.col("depth") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(k), "depth", f"z{k}")).alias(f"t{k}")
    p = paths.select("conv_id", "depth", "length", "words", tag(1), tag(2))
    rows = stored(running(p, "conv_id", F.floor(F.col("depth") / BLOCK), ["depth"], {"p1": ("x", "t1"), "p2": ("x", "t2"), "words_to": ("n", "words")}, total="words_to").withColumn("words_before", F.col("words_to") - F.col("words")).drop("words_to", "words"))

    nodes = rows.groupBy(*_NODE).agg(F.min(F.struct("conv_id", "words_before")).alias("o"), F.max("length").alias("longest"))
    owners = nodes.groupBy("o.conv_id").agg(F.min(F.struct("depth", "o.words_before")).alias("f"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    owners = owners.select("conv_id", F.col("f.depth").alias("own_from"), F.col("f.words_before").alias("unowned"), "leaf")

    m = rows.join(owners, "conv_id", "left").withColumn("own_from", F.coalesce("own_from", F.col("length") + 1))
    saved = F.when(F.col("depth") >= F.col("own_from"), 0).otherwise(F.coalesce("unowned", "all_words_to") - F.col("words_before"))
    child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("own_from"))
    up = F.struct("conv_id", F.col("own_from").alias("from"), F.col("p1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("p2"))
    g = m.groupBy(*_NODE).agg(F.min(up).alias("o"), F.count("*").alias("n_convs"), F.count_if(child).alias("n_children"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    g = stored(g.select(*_NODE, F.col("o.conv_id").alias("conv_id"), F.col("o.from").alias("own_from"), F.col("o.p1").alias("up1"), F.col("o.p2").alias("up2"), "n_convs", "n_children", "n_leaves", "saved_tokens"))

    # Only where a conversation begins to own is a parent another's; the root's owner is one row.
    root = g.where("depth = 0").select(F.col("conv_id").alias("root_id"))
    stray = g.where("depth > 1 and depth = own_from").select(*_NODE, (F.col("depth") - 1).alias("up_depth"), "up1", "up2")
    above = g.select(F.col("depth").alias("up_depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("up_id"))
    found = stray.join(above, ["up_depth", "up1", "up2"]).select(*_NODE, "up_id")
    out = g.join(_digests(rows.where("depth = length").select(*_NODE, "conv_id")), _NODE, "left").join(found, _NODE, "left").join(F.broadcast(root))
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, F.col("root_id")).otherwise(F.coalesce("up_id", "conv_id"))
    return out.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all conversations rebuilt with their families' openings. Null roles and texts are empty; rows without
    a conv_id and columns but conv_id, turn, role and text are ignored; an empty table has no nodes."""
    prepare(conversations.sparkSession)
    return prefix_trie(rebuilt(stored(turns_of(conversations))))


#: The same by grouping lists of whole turns and pairing every node with each node below it; crc32 is spelled out.
SQL = """
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda j: ascii(substr(conv_id::VARCHAR, j, 1))::BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (SELECT c.conv_id, 0 AS own, pos, said FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h UNION ALL SELECT conv_id, 1, pos, said FROM convs JOIN turns USING (conv_id) WHERE pos >= h),
paths AS (SELECT conv_id, row_number() OVER w AS depth, list(said) OVER w AS node, len(regexp_extract_all(said.x, '[^\\x20\\x09-\\x0D]+')) AS words FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos) UNION ALL SELECT conv_id, 0, [], 0 FROM convs),
ended AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM paths),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM ended GROUP BY node, depth),
links AS (SELECT n.node, n.depth, p.conv_id AS parent_conv_id, p.node AS up FROM nodes n JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]),
kids AS (SELECT up AS node, count(*) AS n_children FROM links GROUP BY up),
below AS (SELECT DISTINCT a.node, b.node AS low FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT b.node, sum((n.n_convs - 1) * n.words) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves FROM below b JOIN nodes n ON n.node = b.low LEFT JOIN kids k ON k.node = b.low GROUP BY b.node)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN (SELECT node, parent_conv_id FROM links) USING (node)
"""
