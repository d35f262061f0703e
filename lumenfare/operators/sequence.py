"""Rules over groups in order: counts in blocks, jumps of doubled length, and row-by-row walks where neither will do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfare.sources.shared import stored


def walked(df: DataFrame, by: str, at: str, tie: str, name: str, kind: T.DataType, step: Callable[[Any, Any], tuple[Any, Any]]) -> DataFrame:
    """df with column `name`: step(state, value of `at`) gives each row's (state, result) in a group's order; the state
    is None at a group's first row.

    Rows are dealt by `by` and sorted where they lie, which spills to disk; batches then pass through with one group's
    state held, so memory is bounded however many rows a group has. Null keys are one group.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, group, state = False, None, None
        for pdf in frames:
            out = []
            for key, value in zip(pdf[by].tolist(), pdf[at]):
                key = None if pd.isna(key) else key
                if not begun or key != group:
                    begun, group, state = True, key, None
                state, result = step(state, value)
                out.append(result)
            yield pdf.assign(**{name: out})

    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    return df.repartition(F.col(by)).sortWithinPartitions(by, at, tie).mapInPandas(run, schema)


def counted(df: DataFrame, by: str, at: str, name: str, flag: Column | None = None, order: list | None = None, width: int = 4096) -> DataFrame:
    """df with column `name`: how many rows of its group have flag (all, without one) up to and with it, in order of the
    integer `at`, then `order`.

    Windows run over blocks of `width` values of `at`, and the counts of blocks, of which a group has one row each, are
    summed apart: one group's rows are dealt to many tasks.
    """
    one = F.lit(1) if flag is None else F.when(flag, 1).otherwise(0)
    df = df.withColumns({"_block": F.floor(F.col(at) / width), "_one": one})
    whole = df.groupBy(by, "_block").agg(F.sum("_one").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = F.sum("_one").over(W.partitionBy(by, "_block").orderBy(at, *(order or [])).rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("_near", near).join(whole.select(by, "_block", before.alias("_before")), [by, "_block"])
    return out.withColumn(name, F.col("_near") + F.col("_before")).drop("_block", "_one", "_near", "_before")


def chained(jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """The rows (group, node) that the starts (group, node) reach by jumps (group, node, to), starts included.

    Each round jumps twice as far: what is reached so far also takes the round's jumps, and every jump is joined with
    the one that begins where it ends. So a chain of n rows takes log n rounds of joins, and its rows lie in as many
    tasks as the joins have. Every node has one jump at most, and none returns to where a chain has been.
    """
    reached, jumps = stored(starts.select("group", "node")), stored(jumps.select("group", "node", "to"))
    while jumps.take(1):
        further = reached.join(jumps, ["group", "node"]).select("group", F.col("to").alias("node"))
        reached = stored(reached.unionByName(further))
        next_ = jumps.select("group", F.col("node").alias("to"), F.col("to").alias("end"))
        jumps = stored(jumps.join(next_, ["group", "to"]).select("group", "node", F.col("end").alias("to")))
    return reached
