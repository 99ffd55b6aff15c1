"""What all resamplers share.

A resampler takes points (id, label, x) with non-negative unique ids and returns
points with three more columns: ``is_synthetic``, ``src_id`` and ``nbr_id``.
Synthetic rows have negative ids. Randomness is a hash of (seed, class, draw).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import uniform
from lopside.session import parallelism

BROADCAST_BYTES = 4 << 20  # a broadcast passes through the driver, in a cross-validation once a fold
SPREAD_COPIES = 100_000

RESAMPLERS: dict[str, Callable[..., DataFrame]] = {}


def resampler(name: str):
    def add(fn):
        RESAMPLERS[name] = fn
        return fn

    return add


def class_sizes(points: DataFrame) -> dict[str, int]:
    """Rows per class; classes are few, their sizes come from a combined count."""
    return {r["label"]: r["n"] for r in points.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def minority(sizes: dict[str, int]) -> str:
    return min(sizes, key=lambda c: (sizes[c], c))


def majority(sizes: dict[str, int]) -> str:
    return min(sizes, key=lambda c: (-sizes[c], c))


def others(sizes: dict[str, int]) -> list[str]:
    """Every class but the minority, what under-samplers act on."""
    low = minority(sizes)
    return sorted(c for c in sizes if c != low)


def deficits(sizes: dict[str, int]) -> dict[str, int]:
    """Rows each class lacks to reach the largest one, where any."""
    top = max(sizes.values())
    return {c: top - n for c, n in sorted(sizes.items()) if n < top}


def originals(points: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return points.select(
        "id", "label", "x", F.lit(False).alias("is_synthetic"), none.alias("src_id"), none.alias("nbr_id")
    )


def by_label(values: dict[str, object]) -> Column:
    """A per-class constant as an expression on ``label``."""
    out = F
    for label, value in values.items():
        out = out.when(F.col("label") == F.lit(label), F.lit(value))
    return out


def draws(spark, wanted: dict[str, int]) -> DataFrame:
    """(no, label, j): ``wanted[label]`` numbered draws per class, spread evenly."""
    total = sum(wanted.values())
    start, begin, label = 0, F, F
    for c, n in wanted.items():
        inside = (F.col("no") >= start) & (F.col("no") < start + n)
        begin, label = begin.when(inside, F.lit(start)), label.when(inside, F.lit(c))
        start += n
    numbers = spark.range(total).withColumnRenamed("id", "no")
    return numbers.select("no", label.alias("label"), (F.col("no") - begin).alias("j"))


def fits_broadcast(rows: int, dims: int, vectors: int = 1) -> bool:
    return rows * (64 + 8 * dims * vectors) <= BROADCAST_BYTES


def interpolate(x: Column, toward: Column, step: Column) -> Column:
    return F.zip_with(x, toward, lambda a, b: a + step * (b - a))


def multiply(df: DataFrame, times: str, index: str, total: int) -> DataFrame:
    """Repeat each row ``times`` times, numbered from 0.

    One row may be wanted millions of times: copies are cut into ranges that
    travel to different tasks before they are written out.
    """
    step = F.lit(SPREAD_COPIES).cast("bigint")
    many = F.col(times).cast("bigint")
    parts = df.filter(many > 0).withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1, step)))
    if total > SPREAD_COPIES:
        # a fixed number of partitions: the ranges are few bytes, so adaptive execution would merge them
        tasks = min(parallelism(df.sparkSession), total // SPREAD_COPIES + 1)
        parts = parts.repartition(tasks, F.xxhash64("id", "_from"))
    last = F.least(F.col("_from") + step, many) - 1
    return parts.withColumn(index, F.explode(F.sequence(F.col("_from"), last))).drop("_from")


def pick(seed: int, n: Column, *keys: Column) -> Column:
    """A number in 1..n."""
    return F.floor(uniform(seed, *keys) * n).cast("bigint") + 1
