"""Machines with a Gaussian kernel: a random Fourier map before a linear solver (Rahimi and Recht, 2007)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.functions.draws import SEED

WAVES = 512


def kernel_width(points: DataFrame) -> float:
    """1 / (features * variance over all cells of the table); 1 where there is no variance."""
    cells = points.select(F.explode("x").alias("v"), F.size("x").alias("d"))
    row = cells.agg(F.var_pop("v").alias("v"), F.max("d").alias("d")).head()
    return 1.0 / (row["d"] * row["v"]) if row["v"] else 1.0


def fourier_map(points: DataFrame, gamma: float | None = None, waves: int = WAVES, seed: int = SEED) -> Callable[[DataFrame], DataFrame]:
    """A function that replaces ``x`` by ``waves`` random cosines of it.

    Inner products of the new rows approach exp(-gamma * |a - b|^2), with an error of about 1 / sqrt(waves). The
    frequencies are drawn once from ``seed``, so training and test rows, and every task, see the same map.
    ``gamma`` defaults to ``kernel_width`` of ``points``. Each row is mapped on its own; nothing is shuffled.
    """
    gamma = kernel_width(points) if gamma is None else gamma
    dims = points.agg(F.max(F.size("x"))).head()[0] or 1
    rng = np.random.default_rng(seed)
    frequency = rng.normal(0.0, np.sqrt(2 * gamma), (dims, waves))
    phase = rng.uniform(0, 2 * np.pi, waves)

    def mapped(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    place = part.schema.get_field_index("x")
                    x = part.column(place).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    z = np.sqrt(2.0 / waves) * np.cos(x @ frequency + phase)
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * waves)
                    columns = list(part.columns)
                    columns[place] = pa.ListArray.from_arrays(ends, pa.array(z.ravel()))
                    yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

        schema = T.StructType([f if f.name != "x" else T.StructField("x", T.ArrayType(T.DoubleType())) for f in rows.schema.fields])
        return rows.mapInArrow(run, schema)

    return mapped
