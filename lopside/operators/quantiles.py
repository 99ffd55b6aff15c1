"""Exact order statistics and quantiles, for columns of any length."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.operators.ranks import running

DIRECT_ROWS = 1_000_000


def _known(column: str) -> Column:
    """The column as double, NaN as null: a missing value has no place in an order."""
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value), value)


def order_stats(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]], direct_rows: int = DIRECT_ROWS,
                error: float = 0.001) -> dict[str, list[float]]:
    """The values at the 0-based positions ``ranks(n)`` of each column's n sorted values.

    ``percentile_disc`` keeps every distinct value in one aggregation buffer, so
    it only serves short tables. Beyond, a sketch brackets each position, one
    pass counts the values below each bracket, and only the values inside the
    brackets are grouped and ranked.
    """
    if not columns:
        return {}
    wide = df.select(*[_known(c).alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = wide.agg(*[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]).head()
    wanted = {i: ranks(sizes[i]) if sizes[i] else [] for i in range(len(columns))}
    cells = [(i, j, r) for i, rs in wanted.items() for j, r in enumerate(rs)]
    if not cells:
        return {c: [] for c in columns}
    if max(sizes) <= direct_rows:
        picks = []
        for i, rs in wanted.items():
            if rs:  # one buffer per column serves all its positions
                probs = ", ".join(f"{(r + 0.5) / sizes[i]!r}D" for r in rs)
                picks.append(F.expr(f"percentile_disc(array({probs})) WITHIN GROUP (ORDER BY c{i})").alias(f"v{i}"))
        row = wide.agg(*picks).head()
        return {c: list(row[f"v{i}"]) if wanted[i] else [] for i, c in enumerate(columns)}
    ends = {}
    for i, rs in wanted.items():
        probs = [min(1.0, max(0.0, r / sizes[i] + d)) for r in rs for d in (-2 * error, 2 * error)]
        if probs:
            ends[i] = wide.approxQuantile(f"c{i}", probs, error)
    keys = [(n, i, j, r, ends[i][2 * j], ends[i][2 * j + 1]) for n, (i, j, r) in enumerate(cells)]
    below = wide.agg(*[F.count(F.when(F.col(f"c{i}") < lo, 1)).alias(f"b{n}") for n, i, _, _, lo, _ in keys]).head()
    inside = [
        F.when(F.col(f"c{i}").between(lo, hi), F.struct(F.lit(n).alias("key"), F.col(f"c{i}").alias("v"))) for n, i, _, _, lo, hi in keys
    ]
    near = wide.select(F.explode(F.array_compact(F.array(*inside))).alias("e")).select("e.key", "e.v")
    freq = near.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = running(freq, ["key"], "v", ["n"], rows=int(max(sizes) * 6 * error * len(keys)) + 1)
    targets = df.sparkSession.createDataFrame([(n, r - below[f"b{n}"]) for n, _, _, r, _, _ in keys], "key int, pos bigint")
    hit = upto.join(F.broadcast(targets), "key").filter((F.col("n_upto") > F.col("pos")) & (F.col("n_upto") - F.col("n") <= F.col("pos")))
    found = {r["key"]: r["v"] for r in hit.select("key", "v").collect()}  # one row per position asked for
    at = {(i, j): found[n] for n, i, j, _, _, _ in keys}
    return {c: [at[i, j] for j in range(len(wanted[i]))] for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: list[str], probs: list[float], **options) -> dict[str, list[float | None]]:
    """Quantiles with linear interpolation between neighbouring values; None for an empty column."""
    sizes: dict[str, int] = {}

    def both(n: int) -> list[int]:
        return [side(p * (n - 1)) for p in probs for side in (math.floor, math.ceil)]

    stats = order_stats(df, columns, both, **options)
    counts = df.agg(*[F.count(_known(c)).alias(f"n{i}") for i, c in enumerate(columns)]).head() if columns else []
    sizes = {c: counts[i] for i, c in enumerate(columns)}
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if not sizes[c]:
            out[c] = [None] * len(probs)
            continue
        out[c] = []
        for j, p in enumerate(probs):
            lo, hi = stats[c][2 * j], stats[c][2 * j + 1]
            at = p * (sizes[c] - 1)
            out[c].append(lo + (hi - lo) * (at - math.floor(at)))
    return out
