"""Preparing a labelled table: nulls, encodings, names, class balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.functions.draws import draw
from lopside.functions.scalars import round3, safe_name
from lopside.operators.quantiles import quantiles
from lopside.operators.ranks import PLAN_ROWS, running
from lopside.session import pin

MAX_LEVELS = 10_000


def drop_null_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def _is_missing(df: DataFrame, name: str) -> Column:
    kind, value = df.schema[name].dataType, F.col(f"`{name}`")
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    return (value.isNull() | F.isnan(value)) if floating else value.isNull()


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for the columns that miss values, from one scan."""
    if not df.columns:
        return df.sparkSession.createDataFrame([], "column string, missing bigint")
    one = df.agg(*[F.count(F.when(_is_missing(df, c), 1)).alias(c) for c in df.columns])
    long = one.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "missing")
    return long.filter(F.col("missing") > 0)


def total_missing(df: DataFrame) -> DataFrame:
    return missing_counts(df).agg(F.coalesce(F.sum("missing"), F.lit(0)).cast("bigint").alias("total_missing"))


def column_counts(df: DataFrame) -> DataFrame:
    """(column, n): non-null values per column."""
    one = df.agg(*[F.count(F.when(~_is_missing(df, c), 1)).alias(c) for c in df.columns])
    return one.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "n")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold nulls only."""
    row = df.agg(*[F.count(F.when(~_is_missing(df, c), 1)).alias(c) for c in df.columns]).head()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if row[c] > 0])


def drop_incomplete_columns(df: DataFrame) -> DataFrame:
    """Without the columns holding any null, NaN or infinite value."""
    infinite = float("inf")

    def bad(name: str) -> Column:
        kind = df.schema[name].dataType
        missing = _is_missing(df, name)
        return missing | (F.abs(F.col(f"`{name}`")) == infinite) if isinstance(kind, (T.DoubleType, T.FloatType)) else missing

    row = df.agg(*[F.count(F.when(bad(c), 1)).alias(c) for c in df.columns]).head()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if row[c] == 0])


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def levels(df: DataFrame, columns: list[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """The sorted distinct values of each column, refused beyond ``limit`` values.

    Each level becomes a column of the plan, so the bound protects the plan; a
    column above it has to be encoded otherwise (index, hash) by the caller.
    """
    if not columns:
        return {}
    sets = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in columns]).head()
    for c in columns:
        if sets[c] > 1.2 * limit:
            raise ValueError(f"{c} has about {sets[c]} levels, more than {limit}")
    row = df.agg(*[F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in columns]).head()
    return {c: list(row[c]) for c in columns}


def one_hot(df: DataFrame, columns: list[str] | None = None, limit: int = MAX_LEVELS) -> DataFrame:
    """0/1 columns ``<column>_<level>`` for all but the first sorted level.

    Untouched columns stay in front, in their order.
    """
    columns = categorical_columns(df) if columns is None else columns
    found = levels(df, columns, limit)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    dummies = [
        F.coalesce((F.col(f"`{c}`") == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in columns for v in found[c][1:]
    ]
    return df.select(*kept, *dummies)


def encode_binary(df: DataFrame, target: str) -> DataFrame:
    """A text target of two levels as 0/1, the alphabetically later one being 1."""
    if target not in categorical_columns(df):
        return df
    found = levels(df, [target])[target]
    positive = found[1] if len(found) > 1 else None
    return df.withColumn(target, (F.col(target) == F.lit(positive)).cast("int") if positive is not None else F.lit(0))


def first_seen_codes(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(column, code): codes 0.. in order of first appearance by row id."""
    first = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(row_id).alias("first"))
    first = pin(first.withColumn("one", F.lit(1)))
    return running(first, [], "first", ["one"], first.count()).select(column, (F.col("one_upto") - 1).alias("code"))


def factorize(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Replace a column by its first-appearance code, -1 for null.

    Few codes are broadcast. Many are joined as a written table, so that the rows of a very common value can be split.
    """
    codes = pin(first_seen_codes(df, column, row_id))
    out = df.join(F.broadcast(codes) if codes.count() <= PLAN_ROWS else codes, column, "left").withColumn(column, F.coalesce("code", F.lit(-1)))
    return out.select(df.columns)


def unique_names(names: DataFrame) -> DataFrame:
    """(place, name) with names of letters, digits and underscores, duplicates numbered _2, _3, ... by place.

    Names with one base are numbered in a window. A number can give the name another base has of itself; of
    such rows the first keeps it and the others count on, until all names differ.
    """
    base = names.select("place", safe_name(F.col("name")).alias("base"))
    among = Window.partitionBy("base").orderBy("place")
    numbered = base.withColumn("no", F.row_number().over(among))
    shown = F.when(F.col("no") == 1, F.col("base")).otherwise(F.concat_ws("_", "base", "no"))
    while True:
        numbered = numbered.withColumn("name", shown)
        later = F.row_number().over(Window.partitionBy("name").orderBy("place")) > 1
        rows = numbered.withColumn("later", later).collect()  # a row per column of a table
        if not any(r["later"] for r in rows):
            return numbered.select("place", "name")
        moved = [(r["place"], r["base"], r["no"] + int(r["later"])) for r in rows]
        numbered = names.sparkSession.createDataFrame(moved, "place int, base string, no int")


def sanitize_names(spark: SparkSession, names: list[str]) -> list[str]:
    table = spark.createDataFrame(list(enumerate(map(str, names))), "place int, name string")
    return [r["name"] for r in unique_names(table).orderBy("place").collect()]


def sanitize(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.sparkSession, df.columns))


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """One row: n_classes and 'multiclass' above two classes, else 'binary'."""
    classes = df.filter(F.col(target).isNotNull()).agg(F.countDistinct(target).alias("n_classes"))
    return classes.withColumn("problem_type", F.when(F.col("n_classes") > 2, "multiclass").otherwise("binary"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Largest over smallest class, 3 decimals; 0 with fewer than two classes."""
    n = class_counts(df, target).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.count(F.lit(1)).alias("k"))
    ratio = F.when(F.col("k") > 1, round3(F.col("hi") / F.col("lo"))).otherwise(F.lit(0.0))
    return n.select(ratio.alias("imbalance_ratio"))


def balanced_weights(df: DataFrame, target: str, out: str = "weight") -> DataFrame:
    """Add n / (classes * class size), so that every class weighs the same."""
    counts = {r["label"]: r["n"] for r in class_counts(df, target).collect()}
    total, k = sum(counts.values()), len(counts)
    label = F.col(target).cast("string")
    weight = reduce(lambda acc, kv: acc.when(label == kv[0], total / (k * kv[1])), counts.items(), F)
    return df.withColumn(out, weight)


def impute_values(df: DataFrame) -> dict[str, object]:
    """Median of every numeric column and most frequent value of every other one."""
    numeric = numeric_columns(df)
    fill: dict[str, object] = {c: q[0] for c, q in quantiles(df, numeric, [0.5]).items()}
    for c in df.columns:
        if c in numeric:
            continue
        # ties go to the smallest value, so order by count down, value up
        value = F.col(f"`{c}`")
        counts = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
        top = counts.orderBy(F.desc("n"), "v").limit(1)
        row = top.head()
        fill[c] = row[0] if row else None
    return fill


def impute(df: DataFrame) -> DataFrame:
    """Drop empty columns, then fill nulls with the median or most frequent value."""
    df = drop_empty_columns(df)
    fill = impute_values(df)
    numeric = numeric_columns(df)
    out = []
    for c in df.columns:
        if fill[c] is None:
            out.append(F.col(f"`{c}`"))
        elif c in numeric:
            value = F.col(f"`{c}`").cast("double")
            out.append(F.when(_is_missing(df, c), F.lit(float(fill[c]))).otherwise(value).alias(c))
        else:
            out.append(F.coalesce(F.col(f"`{c}`"), F.lit(fill[c])).alias(c))
    return df.select(*out)


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of smallest draw: the same sample whatever the partitioning."""
    return df.orderBy(draw(seed, F.col(row_id)), row_id).limit(n)


# ---- correlations and the short profile ------------------------------------------

def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, value): absolute Pearson correlation of every column pair, one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, value double")
    one = df.agg(*[F.abs(F.corr(a, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("value")) for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*cells)))


def target_correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(feature, value): absolute correlation of each feature with the target."""
    one = df.agg(*[F.abs(F.corr(c, target)).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "value")


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n) exact distinct counts. One grouped pass over (feature, value)
    pairs: two-step aggregation keeps a hot value from reaching one task."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns
    ])).alias("e")).select("e.*").filter(F.col("v").isNotNull())
    return long.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def spread(df: DataFrame, value: str, prefix: str) -> DataFrame:
    return df.agg(
        F.min(value).cast("double").alias(f"{prefix}_min"),
        F.avg(value).alias(f"{prefix}_mean"),
        F.max(value).cast("double").alias(f"{prefix}_max"),
    )


def short_profile(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: sizes, imbalance ratio, spread of target correlations and of levels."""
    numeric = [c for c in features if c in numeric_columns(df)]
    text = [c for c in features if c in categorical_columns(df)]
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(features)).alias("n_columns"),
        F.lit(len(numeric)).alias("n_numeric"),
        F.lit(len(text)).alias("n_categorical"),
    )
    parts = [imbalance_ratio(df, target)]
    if numeric:
        parts.append(spread(target_correlations(df, numeric, target), "value", "corr"))
    if text:
        parts.append(spread(distinct_counts(df, text), "n", "levels"))
    for part in parts:  # each side is a single aggregated row
        out = out.join(F.broadcast(part), F.lit(True))
    return out
