"""The knowledge base: fixed layouts, merge rules and versioned storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.functions.scalars import mean_of, round3

# Column names of the knowledge-base tables.
KEYS = ["dataset", "pre processing", "algorithm", "time"]
BINARY_METRICS = ["balanced accuracy", "f1 score", "roc auc", "geometric mean", "cohen kappa"]
MULTICLASS_METRICS = [
    "multiclass precision macro", "multiclass recall macro", "multiclass f1 weighted", "multiclass matthews corrcoef",
]
UNKNOWN = "?"


def _with_std(metrics: list[str]) -> list[str]:
    return [c for m in metrics for c in (m, f"{m} std")]


METRIC_COLUMNS = _with_std(BINARY_METRICS) + _with_std(MULTICLASS_METRICS)
RESULT_COLUMNS = KEYS + METRIC_COLUMNS + ["total elapsed time"]
FULL_COLUMNS = KEYS + METRIC_COLUMNS + ["final score"]
BINARY_COLUMNS = KEYS + _with_std(BINARY_METRICS) + ["total elapsed time"]
FOLD_COLUMNS = ["dataset", "pre processing", "algorithm", "output app", "fold", "time", "final score", "final score std"]
BASELINE_COLUMNS = ["dataset", "algorithm", "time"] + _with_std(BINARY_METRICS) + ["final score", "final score std"]

# Score names of a run and the columns that store them.
STORED_AS = {
    "balanced_accuracy": "balanced accuracy", "f1": "f1 score", "roc_auc": "roc auc", "g_mean": "geometric mean",
    "cohen_kappa": "cohen kappa", "precision_macro": "multiclass precision macro",
    "recall_macro": "multiclass recall macro", "f1_weighted": "multiclass f1 weighted",
    "matthews_corrcoef": "multiclass matthews corrcoef",
}


def column_type(name: str) -> T.DataType:
    text = {"dataset", "pre processing", "algorithm", "total elapsed time", "output app", "test type", "result"}
    if name in text:
        return T.StringType()
    return T.IntegerType() if name == "fold" else T.DoubleType()


def stored_score(problem_type: str, prefix: str = "") -> Column:
    """Composite of a stored row, 3 decimals; null when it has none of the metrics."""
    metrics = MULTICLASS_METRICS if problem_type == "multiclass" else BINARY_METRICS
    return round3(mean_of(*[F.col(f"{prefix}`{m}`") for m in metrics]))


def payload(df: DataFrame, problem_type: str) -> DataFrame:
    """Null the metrics that do not belong to the problem type."""
    drop = BINARY_METRICS if problem_type == "multiclass" else MULTICLASS_METRICS
    return df.withColumns({c: F.lit(None).cast("double") for c in _with_std(drop) if c in df.columns})


def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project to ``columns``, adding those missing as null."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") if c in have else F.lit(None).cast(column_type(c)).alias(c) for c in columns])


def score_rows(df: DataFrame) -> DataFrame:
    """Final score and its deviation of each row's five metrics."""
    from lopside.functions.scalars import std_of

    cols = [F.col(f"`{m}`") for m in BINARY_METRICS]
    return df.withColumns({"final score": round3(mean_of(*cols)), "final score std": round3(std_of(*cols))})


# ---- merge rules -------------------------------------------------------------------------

def upsert_results(stored: DataFrame, new: DataFrame, problem_type: str) -> DataFrame:
    """Keep, per dataset, the stored row unless the new composite is strictly higher.

    Adds ``action``: insert, update or keep.
    """
    columns = stored.columns
    score_s, score_n = stored_score(problem_type), stored_score(problem_type)
    s = stored.select("dataset", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s"), score_s.alias("was"))
    n = new.select("dataset", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("n"), score_n.alias("now"))
    both = s.join(n, "dataset", "full_outer")
    action = (
        F.when(F.col("s").isNull(), "insert")
        .when(F.col("n").isNotNull() & (F.col("now") > F.col("was")), "update")
        .otherwise("keep")
    )
    both = both.withColumn("action", action)
    row = F.when(F.col("action") == "keep", F.col("s")).otherwise(F.col("n"))
    return both.select(row.alias("row"), "action").select("row.*", "action")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Append the new rows whose key is not stored yet; stored rows stay as they are."""
    fresh = new.join(stored.select(*[F.col(f"`{k}`") for k in keys]).distinct(), keys, "left_anti")
    return stored.unionByName(fresh.select(stored.columns))


def insert_full_results(stored: DataFrame, new: DataFrame, problem_type: str) -> DataFrame:
    """All combinations of datasets not seen before, with their final score; the table comes sorted, see ``by_score``."""
    new = with_columns(new.withColumn("final score", stored_score(problem_type)), stored.columns)
    return by_score(insert_absent(stored, new, ["dataset"]))


def by_score(full: DataFrame) -> DataFrame:
    """Full results, the best final score first; ties by dataset and combination, rows without a score last."""
    return full.orderBy(F.desc_nulls_last("final score"), *[F.asc_nulls_last(c) for c in ("dataset", "pre processing", "algorithm")])


def upsert_characteristics(stored: DataFrame, new: DataFrame, best: DataFrame | None) -> DataFrame:
    """Replace a dataset's meta-features and settle its combination.

    ``best`` holds dataset, pre processing, algorithm and ``updated``: the new
    combination counts if updated or unseen, else the stored one stays. Without
    ``best`` an unseen dataset gets "?" and a seen one is left untouched.
    """
    combo = ["pre processing", "algorithm"]
    old = stored.select("dataset", *[F.col(c).alias(f"old {c}") for c in combo], F.lit(True).alias("seen"))
    joined = new.drop(*combo).join(old, "dataset", "left")
    if best is None:
        fresh = joined.filter(F.col("seen").isNull()).withColumns({c: F.lit(UNKNOWN) for c in combo})
    else:
        fresh = joined.join(best.select("dataset", *combo, "updated"), "dataset", "left")
        win = F.col("updated") | F.col("seen").isNull()
        fresh = fresh.withColumns({
            c: F.when(F.col(c).isNotNull() & win, F.col(c)).otherwise(F.coalesce(F.col(f"old {c}"), F.lit(UNKNOWN))) for c in combo
        })
    fresh = fresh.drop("seen", "updated", *[f"old {c}" for c in combo])
    kept = stored.join(fresh.select("dataset"), "dataset", "left_anti")
    return fresh.unionByName(kept, allowMissingColumns=True)


def prune(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Without the rows whose ``column`` is on the list."""
    gone = df.sparkSession.createDataFrame([(n,) for n in names], f"`{column}` string")
    return df.join(F.broadcast(gone), column, "left_anti")  # the list is given by hand


def weak_rows(df: DataFrame, floor: float = 0.5) -> DataFrame:
    """Rows with any of the five metrics below ``floor``."""
    return df.filter(F.least(*[F.col(f"`{m}`") for m in BINARY_METRICS]) < floor)


# ---- storage -----------------------------------------------------------------------------

class KnowledgeBase:
    """Tables under ``root``, each write a new complete version.

    Layout: ``root/<table>/version=<n>/problem_type=<type>/*.parquet``. A version
    counts once its ``_SUCCESS`` marker exists, so a failed write is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, base: str) -> list[int]:
        where, fs = self._fs(f"{self.root}/{base}")
        if not fs.exists(where):
            return []
        found = []
        for status in fs.listStatus(where):
            name = status.getPath().getName()
            done, _ = self._fs(f"{self.root}/{base}/{name}/_SUCCESS")
            if name.startswith("version=") and fs.exists(done):
                found.append(int(name.split("=")[1]))
        return sorted(found)

    def load(self, base: str, problem_type: str, columns: list[str] | None = None) -> DataFrame:
        """One problem type of the newest version; only its partition is read."""
        versions = self.versions(base)
        if versions:
            df = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{base}/version={versions[-1]}")
            df = df.filter(F.col("problem_type") == problem_type).drop("problem_type")
            return df if columns is None else with_columns(df, columns)
        schema = T.StructType([T.StructField(c, column_type(c)) for c in columns or ["dataset"]])
        return self.spark.createDataFrame([], schema)

    def full_results(self, problem_type: str, base: str = "kb_full_results") -> DataFrame:
        """The stored full results of a problem type, sorted by ``by_score``."""
        return by_score(self.load(base, problem_type))

    def save(self, base: str, df: DataFrame, problem_type: str) -> int:
        """Write a new version holding ``df`` and the other problem types unchanged."""
        versions = self.versions(base)
        new = df.withColumn("problem_type", F.lit(problem_type))
        if versions:
            old = self.spark.read.option("mergeSchema", "true").parquet(f"{self.root}/{base}/version={versions[-1]}")
            old = old.filter(F.col("problem_type") != problem_type)
            new = new.unionByName(old, allowMissingColumns=True)
        number = versions[-1] + 1 if versions else 1
        new.write.partitionBy("problem_type").parquet(f"{self.root}/{base}/version={number}")
        return number
