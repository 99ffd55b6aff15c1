"""Stratified folds and hold-out splits as functions of the row id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED, uniform
from lopside.operators.ranks import hash_rank


def stratified_folds(df: DataFrame, target: str, row_id: str, folds: int = 10, repeats: int = 3, seed: int = SEED) -> DataFrame:
    """One row per (row, repeat) with its ``fold``: class rows dealt out in hashed order.

    The cost is one ranking per repeat; classes of any size are ranked in buckets.
    """
    rows = df.count()
    out = None
    for r in range(repeats):
        dealt = hash_rank(df, [target], row_id, seed, key=f"{r}", rows=rows)
        dealt = dealt.select(*df.columns, F.lit(r).alias("repeat"), ((F.col("rank") - 1) % folds).cast("int").alias("fold"))
        out = dealt if out is None else out.unionByName(dealt)
    return out


def holdout(df: DataFrame, row_id: str, share: float = 0.75, seed: int = SEED) -> DataFrame:
    """Add ``is_train``: true for about ``share`` of the rows."""
    return df.withColumn("is_train", uniform(seed, F.col(row_id)) < F.lit(share))
