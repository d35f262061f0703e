"""Bringing events in: duplicates, get-or-create, upserts, retention, quality, as set operations on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by the order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[list[str]], order: list) -> DataFrame:
    """Rows of new that match no existing row on any of the key sets, themselves without duplicates on the last set."""
    out = new
    for key in keys:
        out = out.join(existing.select(*key).distinct(), key, "left_anti")
    return keep_first(out, keys[-1], order)


def get_or_create(names: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, id, created) for the distinct names: the existing id, or one made of the name."""
    n = names.select("name").where(F.col("name").isNotNull()).distinct()
    return n.join(existing.groupBy("name").agg(F.min("id").alias("old")), "name", "left").select("name", F.coalesce("old", F.sha2("name", 256)).alias("id"), F.col("old").isNull().alias("created"))


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key: an upsert over time."""
    return keep_first(df, keys, [F.desc(at), F.desc(tie)])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer merge on the keys: new values where there are any; action names what happened to a row."""
    o = existing.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_n"))
    action = F.when(F.col("_o").isNull(), "inserted").when(F.col("_n").isNull(), "kept").otherwise("updated")
    return o.join(n, keys, "full_outer").select(*keys, *[F.when(F.col("_n"), F.col(f"_new_{v}")).otherwise(F.col(f"_old_{v}")).alias(v) for v in values], action.alias("action"))


def retained(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """events without active ones that ended more than `days` ago."""
    return events.where(~((F.col("status") == "active") & (F.col("date_time") < now - F.make_dt_interval(F.lit(days)))))


def fuzzy_pairs(df: DataFrame, block: list[str], text: str, low: float = 0.7) -> DataFrame:
    """(a, b, ratio, exact) for pairs of ids within a block whose titles' edit ratio is at least low.

    Blocks (such as a day and a first word) must be small: within a block the work is quadratic. Titles too different
    in length for the ratio are not compared.
    """
    a, b = df.alias("a"), df.alias("b")
    la, lb = F.length(f"a.{text}"), F.length(f"b.{text}")
    near = (F.abs(la - lb) <= (1 - low) * F.greatest(la, lb)) & (F.col("a.id") < F.col("b.id"))
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in block] + [near])
    ratio = 1 - F.levenshtein(F.col(f"a.{text}"), F.col(f"b.{text}")) / F.greatest(la, lb)
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round(ratio, 6).alias("ratio")).where(F.col("ratio") >= low).withColumn("exact", F.col("ratio") > 0.9)
