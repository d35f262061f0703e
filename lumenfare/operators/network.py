"""Training of a ranking network: ReLU layers and a sigmoid, by Adam on gradients that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.operators.training import EarlyStop
from lumenfare.sources.shared import stored

#: Bucket of the rows that are validated on.
HELD = -1


def begun(sizes: list[int], seed: int = 0) -> np.ndarray:
    """Weights and biases of layers from sizes[k] to sizes[k + 1] inputs, one after the other: uniform, within 1 over the
    root of a layer's inputs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, (a + 1) * b) / a**0.5 for a, b in zip(sizes, sizes[1:])])


def layers(sizes: list[int], w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights by output, biases) of each layer, as views of w."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((w[at : at + a * b].reshape(b, a), w[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def forward(sizes: list[int], w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """What each layer gives, the inputs first; the last is the probability of each row."""
    out, each = [x], layers(sizes, w)
    for k, (weights, bias) in enumerate(each):
        z = out[-1] @ weights.T + bias
        out.append(np.maximum(z, 0) if k < len(each) - 1 else 1 / (1 + np.exp(-np.clip(z, -500, 500))))
    return out


def losses(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def gradient(sizes: list[int], w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The sum over rows of the loss's gradient by back-propagation, as w is laid out, and the sum of losses."""
    out, g = forward(sizes, w, x), np.zeros_like(w)
    back, each, into = out[-1] - y[:, None], layers(sizes, w), layers(sizes, g)
    for k in range(len(each) - 1, -1, -1):
        into[k][0][:] = back.T @ out[k]
        into[k][1][:] = back.sum(axis=0)
        if k:
            back = (back @ each[k][0]) * (out[k] > 0)
    return g, float(losses(out[-1][:, 0], y).sum())


class Adam:
    """Adam with weight decay added to the gradient."""

    def __init__(self, n: int, rate: float, decay: float):
        self.rate, self.decay, self.m, self.v, self.t = rate, decay, np.zeros(n), np.zeros(n), 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        g, self.t = g + self.decay * w, self.t + 1
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        return w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def added_up(rows: DataFrame, nets: list[tuple[list[int], np.ndarray]]) -> list[np.ndarray]:
    """For each network (sizes, weights) the gradient and, behind it, loss and number of the training rows, and of the
    others. A task reads its rows once for all networks and adds them up; the arrays meet place by place, so that no task
    adds more than its share of places."""
    shared = rows.sparkSession.sparkContext.broadcast(nets)
    ends = np.cumsum([len(w) + 4 for _, w in nets])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros(len(w) + 4) for _, w in shared.value]
        for pdf in frames:
            if not len(pdf):
                continue
            x, y, held = np.array(pdf.x.tolist(), float), pdf.y.to_numpy(float), pdf.bucket.to_numpy() == HELD
            for (sizes, w), total in zip(shared.value, totals):
                if not held.all():
                    g, loss = gradient(sizes, w, x[~held], y[~held])
                    total[:-4] += g
                    total[-4:-2] += loss, (~held).sum()
                if held.any():
                    total[-2:] += losses(forward(sizes, w, x[held])[-1][:, 0], y[held]).sum(), held.sum()
        v = np.concatenate(totals)
        yield pd.DataFrame({"at": np.arange(len(v)), "v": v})

    try:
        out = np.zeros(ends[-1])
        for at, v in rows.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
            out[at] = v
        return np.split(out, ends[:-1])
    finally:
        shared.destroy()


def dealt(rows: DataFrame, features: list[str], label: str, part: str, batches: int) -> DataFrame:
    """(x, y, bucket) of the rows with a label, as a stored table: those whose `part` is train in buckets by a hash of
    their features and label, the others in the bucket HELD; null features are 0."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    bucket = F.when(F.col(part) == "train", F.pmod(F.xxhash64(x, label), F.lit(batches)).cast("int")).otherwise(HELD)
    return stored(rows.where(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("double").alias("y"), bucket.alias("bucket")), "bucket")


def train(rows: DataFrame, features: list[str], label: str, part: str, hidden: tuple[int, ...] = (64, 32), epochs: int = 100, batches: int = 8, rate: float = 1e-3, decay: float = 1e-5, patience: int = 15, least: float = 1e-3, seed: int = 0) -> tuple[np.ndarray, list[dict]]:
    """The weights of a network from features through `hidden` to one probability, and the history, one entry an epoch:
    epoch, train_loss, held_loss, rate.

    Rows whose `part` is train are dealt into `batches` parts by a hash of their features and label; a step is one
    aggregation over a part, and what comes to the driver has the weights' size. The rate is halved when the loss on the
    other rows has not fallen for more than five epochs, training ends when it has not fallen by `least` for `patience`,
    and the weights of the least loss stand; without other rows, the training loss decides. Null features are 0, rows
    without a label are left out, and no rows leave the weights as they begin.
    """
    sizes = [len(features), *hidden, 1]
    data = dealt(rows, features, label, part, batches)
    w = begun(sizes, seed)
    adam, stop, history, best, waited = Adam(len(w), rate, decay), EarlyStop(patience, least), [], None, 0
    for epoch in range(1, epochs + 1):
        begin, held, sums = w, None, np.zeros(2)
        for k in range(batches):
            (s,) = added_up(data.where(F.col("bucket").isin(k, HELD) if not k else F.col("bucket") == k), [(sizes, w)])
            held = s[-2] / s[-1] if s[-1] else held
            sums += s[-4:-2]
            if s[-3]:
                w = adam.step(w, s[:-4] / s[-3])
        if not sums[1]:
            break
        # The loss on other rows is that of the weights which the epoch began with.
        loss = held if held is not None else sums[0] / sums[1]
        history.append({"epoch": epoch, "train_loss": sums[0] / sums[1], "held_loss": held, "rate": adam.rate})
        if stop.step(loss, begin):
            break
        best, waited = (loss, 0) if best is None or loss < best * (1 - 1e-4) else (best, waited + 1)
        if waited > 5:
            adam.rate, waited = adam.rate / 2, 0
    return (w if stop.state is None else stop.state), history


def scored(rows: DataFrame, features: list[str], sizes: list[int], w: np.ndarray, name: str = "score") -> DataFrame:
    """rows with the network's probability; null features are 0."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def probability(x: pd.Series) -> pd.Series:
        return pd.Series(forward(sizes, shared.value, np.array(x.tolist(), float).reshape(len(x), sizes[0]))[-1][:, 0])

    return rows.withColumn(name, probability(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])))
