"""Paired significance tests over fold scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lopside.functions.scalars import ALPHA, verdict
from lopside.operators.ranks import BUCKET_ROWS, running
from lopside.session import pin


def erfc(x: Column) -> Column:
    """Complementary error function of a non-negative number.

    Below 6 the all-positive series of erf, above it the asymptotic expansion.
    """
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc, n):
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, step, lambda acc: acc["total"])
    small = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series
    y = 1 / (2 * x * x)
    large = F.exp(-x * x) / (x * math.sqrt(math.pi)) * (1 - y + 3 * y * y - 15 * y * y * y)
    return F.when(x < 6, small).otherwise(large)


def chi2_tail(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution for integer degrees of freedom."""
    half = x / 2
    odd = df % 2 == 1
    # terms half^(i + s) / gamma(i + s + 1), s = 0 for even and 1/2 for odd degrees
    first = F.when(odd, F.sqrt(half) / (math.sqrt(math.pi) / 2)).otherwise(F.lit(1.0))
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    count = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    start = F.struct(first.alias("term"), F.lit(0.0).alias("total"))

    def step(acc, i):
        nxt = acc["term"] * half / (i + shift)
        return F.struct(nxt.alias("term"), (acc["total"] + acc["term"]).alias("total"))

    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    total = F.exp(-half) * F.aggregate(steps, start, step, lambda acc: acc["total"])
    return F.when(x <= 0, F.lit(1.0)).otherwise(total + F.when(odd, erfc(F.sqrt(half))).otherwise(F.lit(0.0)))


def wilcoxon(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b", alpha: float = ALPHA,
             rows: int | None = None) -> DataFrame:
    """Two-sided signed-rank test of each group: statistic, z, pvalue, result.

    Zero differences drop out, ties share their mean rank, the p-value is the
    normal approximation with tie correction and without continuity correction.
    A group whose pairs are all equal has null statistic and p-value.
    """
    diff = pairs.select(*by, (F.col(a) - F.col(b)).alias("d"))
    sizes = diff.select(*by).distinct()
    d = F.col("d")
    freq = diff.filter(d != 0).groupBy(*by, F.abs(d).alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(d > 0, 1)).alias("up")
    )
    if rows is None or rows > BUCKET_ROWS:
        freq = pin(freq)
        rows = freq.count()
    ranked = running(freq, by, "size", ["n"], rows)
    ranked = ranked.withColumn("rank", F.col("n_upto") - (F.col("n") - 1) / 2)
    n = F.col("n").cast("double")  # cubes outgrow a bigint
    sums = ranked.groupBy(*by).agg(
        F.sum(n).alias("n"),
        F.sum(F.col("rank") * F.col("up")).alias("plus"),
        F.sum(F.col("rank") * (n - F.col("up"))).alias("minus"),
        F.sum(n * n * n - n).alias("ties"),
    )
    n = F.col("n")
    w = F.least("plus", "minus")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    tested = sums.select(*by, w.alias("statistic"), ((w - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))
    tested = sizes.join(tested, by, "left")
    tested = tested.withColumn("pvalue", erfc(F.abs("z") / math.sqrt(2)))
    return tested.withColumn("result", verdict(F.col("pvalue"), alpha))


def paired(scores: DataFrame, first: str, second: str, value: str = "final score") -> DataFrame:
    """(dataset, fold, a, b): two systems' scores joined on dataset and fold."""

    def of(app: str, name: str) -> DataFrame:
        return scores.filter(F.col("output app") == app).select("dataset", "fold", F.col(value).alias(name))

    return of(first, "a").join(of(second, "b"), ["dataset", "fold"])


def compare_apps(scores: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Internal (learning against recommendation) and external (recommendation
    against the outside baseline) tests of every dataset in one job."""
    both = None
    for kind, first, second in (("internal", "LM", "RM"), ("external", "RM", "TPOT")):
        part = paired(scores, first, second).withColumn("test type", F.lit(kind))
        both = part if both is None else both.unionByName(part)
    return wilcoxon(both, ["dataset", "test type"], alpha=alpha)


def friedman(scores: DataFrame, by: list[str], block: str, treatment: str, value: str) -> DataFrame:
    """Friedman test: one row per group with blocks, treatments, statistic, pvalue.

    Every block must hold every treatment once; a block's few treatments are
    ranked in one window.
    """
    inside = Window.partitionBy(*by, block).orderBy(value)
    level = Window.partitionBy(*by, block, value)
    ranked = scores.withColumn("same", F.count(F.lit(1)).over(level)).withColumn(
        "rank", F.rank().over(inside) + (F.col("same") - 1) / 2
    )
    per = ranked.groupBy(*by, treatment).agg(
        F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("same") * F.col("same") - 1).alias("ties"),
    )
    k = F.count(F.lit(1))
    sums = per.groupBy(*by) if by else per.groupBy()
    sums = sums.agg(
        k.alias("treatments"), F.max("n").alias("blocks"), F.sum(F.col("r") * F.col("r")).alias("r2"),
        F.sum("ties").alias("ties"),
    )
    n, k = F.col("blocks"), F.col("treatments")
    raw = 12 / (n * k * (k + 1)) * F.col("r2") - 3 * n * (k + 1)
    share = 1 - F.col("ties") / (n * k * (k * k - 1))
    out = sums.select(*by, "blocks", "treatments", F.when(share > 0, raw / share).alias("statistic"))
    return out.withColumn("pvalue", chi2_tail(F.col("statistic"), F.col("treatments") - 1))
