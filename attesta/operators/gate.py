"""A small linear gate: balanced logistic regression by full-batch steps, each one grouped sum over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(rows: DataFrame, vector: str, label: str, *, rounds: int = 40, rate: float = 4.0, decay: float = 1e-4) -> list[float]:
    """The weights and, last, the intercept. Rows with a null, or with a vector of another length than the longest, are left out.

    Positives weigh negatives over positives. Every task sends one gradient, whatever the number of its rows.
    """
    x = rows.select(F.col(vector).alias("v"), F.col(label).cast("double").alias("y")).filter("v is not null and y is not null")
    head = x.agg(F.max(F.size("v")).alias("d"), F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")).first()
    d = head["d"] or 0
    heavy = head["neg"] / head["pos"] if head["pos"] else 1.0
    x = x.filter(F.size("v") == d).persist()
    w = np.zeros(d + 1)
    for _ in range(rounds):

        def gradient(batches: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            total = np.zeros(d + 2)
            for b in batches:
                if len(b):
                    a, y = np.stack(b["v"].to_numpy()).astype(float), b["y"].to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(a @ w[:-1] + w[-1], -30, 30)))
                    s = np.where(y == 1, heavy, 1.0)
                    e = s * (p - y)
                    total += np.concatenate([e @ a, [e.sum(), s.sum()]])
            yield pd.DataFrame({"i": np.arange(d + 2), "g": total})

        sums = {r["i"]: r["g"] for r in x.mapInPandas(gradient, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()}  # d + 2 rows
        n = sums.get(d + 1) or 1.0
        step = np.array([sums.get(i, 0.0) for i in range(d + 1)]) / n
        step[:-1] += decay * w[:-1]
        w = w - rate * step
    x.unpersist()
    return w.tolist()
