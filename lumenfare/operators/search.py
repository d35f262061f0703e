"""Search over settings of the ranking network by successive halving."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfare.operators import network as N


def drawn(n: int, seed: int = 0) -> list[dict]:
    """n settings: layers of 32 to 128 and 16 to 64 units, rates of 1e-4 to 1e-2 and decays of 1e-6 to 1e-3, these two
    evenly by their logarithms."""
    rng = np.random.default_rng(seed)
    power = lambda low, high: float(10 ** rng.uniform(low, high))
    return [{"hidden": (int(rng.integers(32, 129)), int(rng.integers(16, 65))), "rate": power(-4, -2), "decay": power(-6, -3)} for _ in range(n)]


def halved(rows: DataFrame, features: list[str], label: str, part: str, trials: list[dict], epochs: int = 2, batches: int = 4, keep: float = 0.5, seed: int = 0) -> tuple[list[dict], np.ndarray | None]:
    """All trials, each setting with trial (its number), epochs (trained for) and loss, best first; and the weights of
    the best.

    A rung trains the trials that are left for `epochs`, each step of all of them by one aggregation over a part of the
    rows whose `part` is train; then the share `keep` of them, at least one, that has the least loss on the other rows
    goes on for twice as long. Losses are as of the end of a trial's last rung; trials that went further stand before
    others, and the smaller number first among equal losses. Without other rows the training rows decide; without any,
    every loss is null and the first trial stands. What comes to the driver has the size of all trials' weights.
    """
    data = N.dealt(rows, features, label, part, batches)
    left = [dict(t, trial=k, epochs=0, loss=None) for k, t in enumerate(trials)]
    for t in left:
        t["sizes"] = [len(features), *t["hidden"], 1]
        t["w"] = N.begun(t["sizes"], seed)
        t["adam"] = N.Adam(len(t["w"]), t["rate"], t["decay"])
    out = []
    while left:
        nets = lambda: [(t["sizes"], t["w"]) for t in left]  # noqa: B023, E731
        for _ in range(epochs):
            for k in range(batches):
                for t, s in zip(left, N.added_up(data.where(F.col("bucket") == k), nets())):
                    if s[-3]:
                        t["w"] = t["adam"].step(t["w"], s[:-4] / s[-3])
        others = N.added_up(data.where(F.col("bucket") == N.HELD), nets())
        if not others[0][-1]:
            others = [s[[-4, -3]] for s in N.added_up(data.where(F.col("bucket") != N.HELD), nets())]
        for t, s in zip(left, others):
            t["epochs"] += epochs
            t["loss"] = float(s[-2] / s[-1]) if s[-1] else None
        left.sort(key=lambda t: (math.inf if t["loss"] is None else t["loss"], t["trial"]))
        n = max(1, math.floor(len(left) * keep)) if len(left) > 1 else 0
        out, left, epochs = left[n:] + out, left[:n], epochs * 2
    return [{k: t[k] for k in ("trial", "hidden", "rate", "decay", "epochs", "loss")} for t in out], (out[0]["w"] if out else None)
