"""Registered queries of the pairwise factor model."""

from functools import reduce

from pyspark.sql import functions as F

from lumenfare.operators import pairwise as P
from lumenfare.operators import training as T
from lumenfare.plans.query import query
from lumenfare.sources.shared import stored
from lumenfare.sources.tables import catalog, interactions


@query()
def bpr_losses(spark, d):
    """The loss on triplets of the positives trained on and of those held out, and the share of them in the right order,
    before training and after every epoch. No SQL can train; the tests hold training against plain loops."""
    known, others = P.held_out(T.positives(interactions(spark, d)))
    known = stored(known)
    own = T.exact_negatives(known, known.select("event_id"), 1)
    triplets, seen = stored(own.withColumn("part", F.lit("trained")).unionByName(others.withColumn("part", F.lit("held out")))), []
    P.train(known, epochs=3, blocks=3, each=lambda epoch, factors: seen.append(P.loss(factors, triplets, "part").withColumn("epoch", F.lit(epoch))))
    return reduce(lambda a, b: a.unionByName(b), seen).select("epoch", "part", "loss", "right", "n")


@query()
def bpr_topk(spark, d):
    """The ten best active events of users whose id is divisible by 50, among those they have not interacted with."""
    i = interactions(spark, d)
    asked = i.select("user_id").where("user_id % 50 = 0")
    return P.recommend(P.train(T.positives(i), epochs=3, blocks=3), asked, i, 10, catalog(spark, d).where("status = 'active'"))
