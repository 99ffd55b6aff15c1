"""Labelled tables from files, and tables written back."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lopside.dataset import Dataset
from lopside.functions.draws import SPAN
from lopside.operators.prep import drop_null_rows, impute
from lopside.operators.ranks import bucket_count, bucket_totals, hash_bucket
from lopside.operators.resample.common import multiply
from lopside.session import pin

# The texts a CSV field may use for "missing".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
]


def read_csv(spark: SparkSession, path: str, sep: str = ",", drop_nulls: bool = True, row_id: str | None = None) -> DataFrame:
    """A CSV with header as typed columns, rows with a missing field dropped.

    With ``row_id`` a column of that name numbers the rows that stay 0.. in file order.

    Fields are read as text, trimmed and freed of missing markers; then each
    column becomes the narrowest of bigint, double, boolean and string that holds
    all its values, found in one pass.
    """
    raw = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    fields = [F.when(~F.trim(F.col(f"`{c}`")).isin(MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns]
    text = raw.select(*fields)
    checks = []
    for i, c in enumerate(text.columns):
        col = F.col(f"`{c}`")
        checks += [
            F.bool_and(col.isNull() | (col.rlike(r"^[+-]?[0-9]+$") & col.try_cast("bigint").isNotNull())).alias(f"i{i}"),
            F.bool_and(col.isNull() | col.try_cast("double").isNotNull()).alias(f"d{i}"),
            F.bool_and(col.isNull() | F.lower(col).isin("true", "false")).alias(f"b{i}"),
            F.count(col).alias(f"n{i}"),
        ]
    seen = text.agg(*checks).head()
    typed = []
    for i, c in enumerate(text.columns):
        kind = "string"
        if seen[f"n{i}"]:
            kind = "bigint" if seen[f"i{i}"] else "double" if seen[f"d{i}"] else "boolean" if seen[f"b{i}"] else "string"
        typed.append(F.col(f"`{c}`").cast(kind).alias(c))
    if row_id is not None:
        return _in_file_order(raw.select(*fields, *_place()).select(*typed, "_path", "_block"), row_id, drop_nulls)
    out = text.select(*typed)
    return drop_null_rows(out) if drop_nulls else out


def _place() -> list[Column]:
    """Where a row was read: its file, and the first byte of the split of that file."""
    return [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]


def _in_file_order(df: DataFrame, name: str, drop_nulls: bool) -> DataFrame:
    """Number rows 0.. by file name and place in the file, whatever the splits.

    A task reads a split from its start, so a counter that rises within the task orders the split's rows;
    the counts of all earlier splits, a row per split, give every split its offset.
    """
    rows = (drop_null_rows(df) if drop_nulls else df).withColumn("_at", F.monotonically_increasing_id())
    rows = pin(rows)
    splits = rows.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_first"))
    earlier = Window.orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_path", "_block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    placed = rows.join(splits, ["_path", "_block"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint"))
    return placed.drop("_path", "_block", "_at", "_shift")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number rows 0.. in an order given by their content alone.

    Copies of a row are interchangeable: they are counted first and numbered
    after, so neither partitioning nor a retried task changes any id and a row
    repeated a billion times costs one counter until it is written out again.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("id", F.xxhash64(*columns)).withColumn("_h", F.xxhash64(F.lit(1), *columns))
    rows = pin(rows)
    total = rows.agg(F.sum("_n")).head()[0] or 0
    buckets = bucket_count(total)
    rows = rows.withColumn("bucket", hash_bucket(F.col("id").bitwiseAND(F.lit(SPAN - 1)), buckets))
    upto = Window.partitionBy("bucket").orderBy("id", "_h").rowsBetween(Window.unboundedPreceding, 0)
    offsets = bucket_totals(rows, [], buckets, {"n": F.sum("_n")}).select("bucket", "n_before")
    rows = rows.withColumn("_from", F.sum("_n").over(upto) - F.col("_n")).join(F.broadcast(offsets), "bucket")
    rows = rows.withColumn("_first", F.col("_from") + F.col("n_before")).drop("_from")
    rows = multiply(rows, "_n", "_copy", total)
    return rows.select(*columns, (F.col("_first") + F.col("_copy")).cast("bigint").alias(name))


def load(spark: SparkSession, path: str, target: str | None = None) -> Dataset:
    """A CSV file as a dataset named after the file; the last column is the target, row ids follow the file."""
    df = read_csv(spark, path, row_id="row_id")
    columns = [c for c in df.columns if c != "row_id"]
    target = target or columns[-1]
    features = [c for c in columns if c != target]
    return Dataset(df, features, target, "row_id", posixpath.basename(path.rstrip("/")))


def read_registered(spark: SparkSession, path: str, name: str, number: int, target: str, features: list[str] | None = None) -> Dataset:
    """A staged Parquet table: features, the declared target last as ``class``, complete rows."""
    df = spark.read.parquet(path)
    features = features or [c for c in df.columns if c != target]
    df = drop_null_rows(df.select(*[F.col(f"`{c}`") for c in features], F.col(f"`{target}`").alias("class")))
    return Dataset(with_row_id(df), features, "class", "row_id", f"{name} (id:{number})")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of dataset summaries."""
    return read_csv(spark, path, sep="\t", drop_nulls=False)


def list_csv(spark: SparkSession, folder: str) -> list[str]:
    """Sorted CSV names in a folder on any Hadoop file system: files, and folders of parts as Spark writes them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        raise FileNotFoundError(f"no such folder: {folder}")
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(n for n in names if n.lower().endswith(".csv"))


def resolve(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a dataset by name, with or without ``.csv``."""
    if not name:
        raise ValueError("a dataset name is needed")
    path = f"{folder.rstrip('/')}/{name if name.endswith('.csv') else name + '.csv'}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"no such dataset: {path}")
    return path


def batch_plan(files: DataFrame, done: DataFrame) -> DataFrame:
    """(dataset, status): ``skipped`` where already processed, else ``todo``."""
    names = done.select("dataset").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("hit"), "skipped").otherwise("todo")
    return files.select("dataset").distinct().join(names, "dataset", "left").select("dataset", status.alias("status"))


def batch_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def export_clean(df: DataFrame, path: str) -> str:
    """Impute and write next to ``path`` as ``<name>_clean<ext>``."""
    stem, ext = posixpath.splitext(path)
    out = f"{stem}_clean{ext}"
    impute(df).write.csv(out, header=True)
    return out


def export_by_dataset(df: DataFrame, path: str) -> None:
    """One folder of CSV files per value of ``dataset``.

    Rows keep their partitions, so a large dataset is written by many tasks.
    """
    df.write.partitionBy("dataset").csv(path, header=True)

