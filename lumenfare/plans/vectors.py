"""Registered query of vector search."""

from pyspark.sql import functions as F

from lumenfare.operators import vector_index as V
from lumenfare.plans.query import query
from lumenfare.sources.tables import read


@query()
def vector_search(spark, d):
    """The five nearest vectors of every vector whose id is divisible by 50, by an index of all vectors. cosine_topk has
    the exact answer, which the tests measure recall against."""
    v = read(spark, d, "embeddings")
    centroids, probes = V.fit(v)
    asked = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return V.search(V.build(v, centroids), asked, centroids, 5, probes).withColumn("rank", F.col("rank").cast("long"))
