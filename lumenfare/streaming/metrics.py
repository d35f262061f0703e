"""Usage metrics over event streams; each works on a batch DataFrame too."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfare.operators.sequence import walked


def stream(spark: SparkSession, folder: str, schema: T.StructType, files: int = 1, glob: str = "*") -> DataFrame:
    """A stream of a folder's files of events, their ts cast to a timestamp with zone, as watermarks need it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and distinct users by day and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users")).select(F.col("w.start").alias("day"), "event_type", "n", "users")


def sliding_counts(events: DataFrame, span: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def running_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def running_users(events: DataFrame) -> DataFrame:
    """Events by type and user; the rows of a type are its distinct users, exactly."""
    return events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


def flushed(counts: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """The state of a streaming aggregation once all its input is read: every batch's changed rows are written under
    `folder`, over what a failed try of that batch left, and each key's row of the last batch counts."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/{number:09d}")

    q = counts.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    changes = counts.sparkSession.read.parquet(f"{folder}/changes/*")
    rest = [c for c in counts.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def appended(rows: DataFrame, folder: str) -> DataFrame:
    """All that a stream of rows has appended once its input is read, written under `folder`."""
    q = rows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/rows").start()
    q.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def limit_rate(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """(id, user_id, ts, allowed): a request passes if fewer than `most` that passed lie less than `seconds` before it.

    Refused requests do not count. The log of one user holds `most` times at most, and nothing else of a user is held.
    """
    span = timedelta(seconds=seconds)

    def step(log, t):
        log = [x for x in log or [] if t - x < span]
        ok = len(log) < most
        return log + [t] if ok else log, ok

    return walked(events.select("id", "user_id", "ts"), "user_id", "ts", "id", "allowed", T.BooleanType(), step)


def limit_rate_stream(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """limit_rate over a stream in order of arrival, the log of passed requests kept as state between batches."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        log = list(state.get[0]) if state.exists else []
        for pdf in frames:
            pdf, ok = pdf.sort_values(["ts", "id"]), []
            for t in pdf.ts:
                now = t.value // 1000
                log = [x for x in log if now - x < seconds * 1_000_000]
                ok.append(len(log) < most)
                if ok[-1]:
                    log.append(now)
            yield pdf.assign(allowed=ok)[["id", "user_id", "ts", "allowed"]]
        state.update((log,))

    return events.select("id", "user_id", "ts").groupBy("user_id").applyInPandasWithState(step, "id long, user_id long, ts timestamp, allowed boolean", "log array<long>", "append", "NoTimeout")


def ema(df: DataFrame, by: str, value: str, order: list[str], alpha: float = 0.1) -> DataFrame:
    """(by, ema): the exponential mean of each group's values in order, begun by the first; null values are left out.

    The r-th value from the end weighs alpha * (1-alpha)^(r-1), and the first of n takes the remaining (1-alpha)^n, so
    a group is a sorted sum and never an array.
    """
    last = F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in order]))
    x = df.where(F.col(value).isNotNull()).select(by, F.col(value).alias("x_"), last.alias("r_"))
    total = F.sum(F.col("x_") * alpha * F.pow(F.lit(1 - alpha), F.col("r_") - 1))
    return x.groupBy(by).agg((total + F.max_by("x_", "r_") * F.pow(F.lit(1 - alpha), F.max("r_"))).alias("ema"))
