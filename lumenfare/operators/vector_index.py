"""Vector search by inverted lists: every vector lies in the list of its nearest centroid, a query reads a few lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lumenfare.sources.shared import stored

#: Vectors that centroids are fitted on at most, vectors a centroid stands for in that sample, and centroids at most.
SAMPLE, OF_EACH, MOST_LISTS = 20_000, 64, 1024
#: Sampled vectors, about, whose nearest are looked up to set the number of probes.
TRIED = 256
#: Vectors of a list, and queries of a list, that one task holds against each other.
PART, QUERIES = 1 << 16, 1 << 12


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit(vectors: DataFrame, target: float = 0.97, k: int = 10, seed: int = 1) -> tuple[np.ndarray, int]:
    """(centroids of unit length, lists to probe), both fitted on a sample: the SAMPLE vectors whose ids hash lowest, or
    all of fewer. There is one centroid for about OF_EACH vectors of the sample. As many lists are probed as hold the
    share `target` of the k nearest in the sample of TRIED of its vectors; in all rows the nearest lie nearer and in
    fewer lists. Equal vectors count once; vectors without length are left out; no vectors give no centroids."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = F.col("embedding").cast("array<double>")
    known = vectors.where(F.col("embedding").isNotNull() & F.exists(x, lambda v: v != 0))
    sample = stored(known.select("vec_id", x.alias("x")).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).dropDuplicates(["x"]))
    rows = [r.x for r in sample.orderBy("vec_id").collect()]
    if not rows:
        return np.empty((0, 0)), 1
    rows = _unit(np.array(rows))
    lists = max(2, min(MOST_LISTS, len(rows) // OF_EACH))
    if len(rows) <= lists:
        return rows, max(1, len(rows))
    data = sample.select(array_to_vector("x").alias("features"))
    centroids = _unit(np.array(KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(data).clusterCenters()))
    near, tried = np.argmax(rows @ centroids.T, axis=1), rows[:: max(1, len(rows) // TRIED)]
    best = np.argsort(-(tried @ rows.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(np.argsort(-(tried @ centroids.T), axis=1, kind="stable"), axis=1)
    return centroids, int(np.quantile(np.take_along_axis(order, near[best], 1), target)) + 1


def _nearest_lists(df: DataFrame, key: str, centroids: np.ndarray, n: int) -> DataFrame:
    """(key, x, list) of every row with its n nearest centroids; x has unit length, or none where the vector has none."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in frames:
            if not len(pdf):
                continue
            x = _unit(np.array(pdf.x.tolist(), float).reshape(len(pdf), -1))
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :n] if len(c) else np.zeros((len(x), 1), int)
            yield pd.DataFrame({key: pdf[key].to_numpy().repeat(near.shape[1]), "x": [v for v in x for _ in range(near.shape[1])], "list": near.ravel()})

    return df.where(F.col("embedding").isNotNull()).select(F.col(key).cast("long"), F.col("embedding").cast("array<double>").alias("x")).mapInPandas(run, f"{key} long, x array<double>, list int")


def build(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The index of vectors (vec_id, embedding): (vec_id, x, list), a written table with every row in one list, repeated
    rows too. Rows without an embedding are in none."""
    return stored(_nearest_lists(vectors, "vec_id", centroids, 1))


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
    """(query_id, vec_id, score, rank): of each query (query_id, embedding) the k vectors of the highest cosine, to six
    places, in the `probes` lists nearest to it, but for the vector of the query's own id; ties go to the smaller id.

    A list's vectors are dealt into parts and its queries into blocks; each part meets each block once, whatever share
    of all rows a list has, and gives its k best a query. The scores within the lists are exact.
    """
    asked = _nearest_lists(queries, "query_id", centroids, probes)
    deal = lambda df, key, most, name: df.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    sizes = deal(index, "vec_id", PART, "parts").join(deal(asked, "query_id", QUERIES, "blocks"), "list")
    sizes = stored(sizes)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = asked.join(sizes, "list").select("list", each("parts").alias("part"), own("query_id", "blocks").alias("block"), F.lit(0).alias("kind"), F.col("query_id").alias("id"), "x")
    v = index.join(sizes, "list").select("list", own("vec_id", "parts").alias("part"), each("blocks").alias("block"), F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "x")
    cell = ["list", "part", "block"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, ids, rows, held = None, [], [], None

        def found() -> pd.DataFrame:
            score, vec = held[1:] if held else (np.empty((0, 0)), np.empty((0, 0), np.int64))
            ok = np.isfinite(score)
            return pd.DataFrame({"query_id": np.repeat(np.array(ids, np.int64), ok.sum(axis=1)) if held else [], "vec_id": vec[ok], "score": score[ok]})

        for pdf in frames:
            at = pdf[cell].to_numpy()
            for low, high in _runs(np.column_stack((at, pdf.kind.to_numpy()))):
                now, x, key = tuple(at[low]), pdf.x.iloc[low:high].tolist(), pdf.id.iloc[low:high].tolist()
                if now != here:
                    if here is not None:
                        yield found()
                    here, ids, rows, held = now, [], [], None
                if pdf.kind.iloc[low] == 0:
                    ids += key
                    rows += x
                    continue
                if not ids:  # a block that no query's hash has fallen to
                    continue
                if held is None:
                    held = np.array(rows), np.full((len(ids), 0), -np.inf), np.empty((len(ids), 0), np.int64)
                score = np.round(held[0] @ np.array(x).T, 6)
                score[np.array(ids)[:, None] == np.array(key)[None, :]] = -np.inf
                score, vec = np.hstack((held[1], score)), np.hstack((held[2], np.tile(np.array(key, np.int64), (len(ids), 1))))
                best = np.lexsort((vec, -score), axis=1)[:, :k]
                held = held[0], np.take_along_axis(score, best, 1), np.take_along_axis(vec, best, 1)
        if here is not None:
            yield found()

    best = q.unionByName(v).repartition(*cell).sortWithinPartitions(*cell, "kind", "id").mapInPandas(run, "query_id long, vec_id long, score double")
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _runs(rows: np.ndarray) -> list[tuple[int, int]]:
    """Where equal rows stand side by side: (first, behind the last)."""
    if not len(rows):
        return []
    edges = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1), [True]))).tolist()
    return list(zip(edges, edges[1:]))
