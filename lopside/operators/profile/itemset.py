"""Frequencies of attribute values, alone and in pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.operators.prep import distinct_counts, numeric_columns
from lopside.operators.profile.summary import summarise_rows
from lopside.operators.ranks import running
from lopside.session import parallelism, pin


def _cut(df: DataFrame, column: str, n: int, bins: int) -> DataFrame:
    """(value, bin) for the distinct values of a numeric column: how many of the bins - 1 inner quantiles lie below it.

    Quantile j stands at place j (n - 1) / bins of the n sorted rows, between two rows a mix of both. It lies below a
    value if that place is before the value's first row. So the number of rows before a value tells its bin: no
    quantile is looked up, and the plan does not grow with the table.
    """
    value = F.col(f"`{column}`").cast("double")
    freq = pin(df.filter(value.isNotNull() & ~F.isnan(value)).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")))
    upto = running(freq, [], "value", ["n"], freq.count())
    # quantile j is below the value if j (n - 1) / bins is less than the number of rows before the value
    below = F.expr(f"((n_upto - n) * {bins} + {max(n - 1, 1)} - 1) div {max(n - 1, 1)}") - 1
    return upto.select("value", F.least(F.greatest(below, F.lit(0)), F.lit(bins - 1)).cast("string").alias("bin"))


def discretise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns of many values cut into cube-root-of-n bins of equal frequency; all as text."""
    n = df.count()
    bins = max(2, math.ceil(round(n ** (1 / 3), 9)))
    levels = {r["feature"]: r["n"] for r in distinct_counts(df, columns).collect()}
    many = [c for c in columns if c in numeric_columns(df) and levels.get(c, 0) > bins]
    out = df.select(*[F.col(f"`{c}`").cast("double" if c in many else "string").alias(c) for c in columns])
    for c in many:
        here = out.filter(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`"))).count()
        out = out.join(_cut(df, c, here, bins).withColumnRenamed("value", "_value"), F.col(f"`{c}`") == F.col("_value"), "left")
        out = out.withColumn(c, F.col("bin")).drop("_value", "bin")
    return out.select(*[F.col(f"`{c}`") for c in columns])


def items(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, v, n): rows holding value v in attribute number a."""
    cells = F.array(*[F.struct(F.lit(i).alias("a"), F.col(f"`{c}`").alias("v")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("e")).select("e.*").groupBy("a", "v").agg(F.count(F.lit(1)).alias("n"))


def one_itemset(df: DataFrame, columns: list[str]) -> DataFrame:
    total = df.count()
    return items(df, columns).select("a", "v", (F.col("n") / total).alias("one_itemset"))


def two_itemset(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, va, b, vb, two_itemset): share of rows holding exactly one of two items
    of different attributes. Joint counts come from one combined aggregation;
    items are joined through the short list of attribute pairs."""
    total, spark = df.count(), df.sparkSession
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    single = pin(items(df, columns))
    cells = F.array(*[
        F.struct(F.lit(i).alias("a"), F.col(f"`{columns[i]}`").alias("va"), F.lit(j).alias("b"), F.col(f"`{columns[j]}`").alias("vb"))
        for i, j in pairs
    ])
    joint = df.select(F.explode(cells).alias("e")).select("e.*").groupBy("a", "va", "b", "vb").agg(F.count(F.lit(1)).alias("both"))
    left = single.select("a", F.col("v").alias("va"), F.col("n").alias("na"))
    right = single.select(F.col("a").alias("b"), F.col("v").alias("vb"), F.col("n").alias("nb"))
    # an attribute may hold most items: the items of the first are dealt over salts, those of the second copied to each
    salts = parallelism(spark)
    left = left.withColumn("salt", F.pmod(F.xxhash64("va"), F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = left.join(F.broadcast(spark.createDataFrame(pairs, "a int, b int")), "a").join(right.hint("merge"), ["b", "salt"])
    share = (F.col("na") + F.col("nb") - 2 * F.coalesce("both", F.lit(0))) / total
    return every.join(joint, ["a", "va", "b", "vb"], "left").select("a", "va", "b", "vb", share.alias("two_itemset"))


def itemset(df: DataFrame, columns: list[str]) -> dict[str, object]:
    cut = pin(discretise(df, columns))
    return {**summarise_rows(one_itemset(cut, columns), ["one_itemset"]), **summarise_rows(two_itemset(cut, columns), ["two_itemset"])}
