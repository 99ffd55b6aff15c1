"""Class sizes, class means and scatter matrices of a table of points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.operators.neighbours import _matrix


@dataclass
class Scatter:
    """Everything is classes x features or features x features, never rows."""

    labels: list[str]
    n: np.ndarray          # (K,)
    mean: np.ndarray       # (K, d)
    within: np.ndarray     # (K, d, d) sums of squares about the class mean

    @property
    def total_mean(self) -> np.ndarray:
        return (self.n[:, None] * self.mean).sum(0) / self.n.sum()

    @property
    def between(self) -> np.ndarray:
        gap = self.mean - self.total_mean
        return (self.n[:, None, None] * gap[:, :, None] * gap[:, None, :]).sum(0)

    @property
    def covariance(self) -> np.ndarray:
        return (self.within.sum(0) + self.between) / (self.n.sum() - 1)


def scatter(points: DataFrame) -> Scatter:
    """Two combined aggregations: sums per class, then products about the class means.

    Each task adds its rows up first and emits one small row per class and cell.
    """
    cells = points.select("label", F.posexplode("x").alias("i", "v"))
    sums = cells.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")).collect()
    labels = sorted({r["label"] for r in sums})
    at = {c: k for k, c in enumerate(labels)}
    d = 1 + max(r["i"] for r in sums)
    n, mean = np.zeros(len(labels)), np.zeros((len(labels), d))
    for r in sums:
        n[at[r["label"]]], mean[at[r["label"]], r["i"]] = r["n"], r["m"]
    shared = points.sparkSession.sparkContext.broadcast((at, mean))

    def run(batches):
        at, mean = shared.value
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            code = np.array([at[v] for v in batch.column("label").to_pylist()])
            for k in np.unique(code):
                z = x[code == k] - mean[k]
                total[k] = total.get(k, 0) + z.T @ z
        for k, s in total.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(s.size, k, dtype=np.int32)), pa.array(i.ravel().astype(np.int32)),
                 pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())], names=["k", "i", "j", "s"],
            )

    parts = points.select("label", "x").mapInArrow(run, "k int, i int, j int, s double")
    within = np.zeros((len(labels), d, d))
    for r in parts.groupBy("k", "i", "j").agg(F.sum("s").alias("s")).collect():
        within[r["k"], r["i"], r["j"]] = r["s"]
    return Scatter(labels, n, mean, within)
