"""Comparing resamplers and classifiers over the stored results of many datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lopside.operators.ranks import PLAN_ROWS, hash_rank
from lopside.session import pin

# The names dropped while the portfolio was reduced.
WEAK_RESAMPLERS = [
    "SMOTEENN", "CondensedNearestNeighbour", "InstanceHardnessThreshold", "ClusterCentroids", "NearMiss", "OneSidedSelection",
    "(no pre processing)", "KMeansSMOTE", "EditedNearestNeighbours", "AllKNN", "RepeatedEditedNearestNeighbours",
    "NeighbourhoodCleaningRule", "RandomUnderSampler", "BorderlineSMOTE", "TomekLinks", "ADASYN",
]
WEAK_CLASSIFIERS = [
    "LogisticRegression", "GaussianNB", "SVC", "AdaBoostClassifier", "KNeighborsClassifier", "BaggingClassifier",
    "ExtraTreesClassifier", "RandomForestClassifier",
]


def positions(full: DataFrame, row_id: str) -> DataFrame:
    """Add ``position``: 0-based place in the table sorted by final score, best first.

    Scores have three decimals, so the table of scores is short and gives every
    score its first position; rows of one score are ranked in hashed buckets. Rows
    without a score come last.
    """
    rows = full.count()
    freq = full.groupBy("final score").agg(F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.desc_nulls_last("final score")).rowsBetween(Window.unboundedPreceding, -1)
    first = freq.select(F.col("final score").alias("_score"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("first"))  # one row per score
    first = pin(first)
    if first.count() <= PLAN_ROWS:
        first = F.broadcast(first)
    ranked = hash_rank(full, ["final score"], row_id, rows=rows)
    placed = ranked.join(first, F.col("final score").eqNullSafe(F.col("_score")))
    return placed.withColumn("position", F.col("first") + F.col("rank") - 1).drop("first", "rank", "_score")


def rank_sums(full: DataFrame, column: str, row_id: str) -> DataFrame:
    """(column, score): sum of positions; lower is better."""
    slim = pin(full.select(column, row_id, "final score"))  # scores are worked out once, not in every job
    return positions(slim, row_id).groupBy(column).agg(F.sum("position").alias("score"))


def score_quantiles(sums: DataFrame) -> DataFrame:
    """Quartiles of the rank sums (one row per name, so a short column)."""
    q = F.percentile(F.col("score").cast("double"), [0.25, 0.5, 0.75])
    return sums.agg(q.alias("q")).select(F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def reduce_portfolio(full: DataFrame, column: str, row_id: str, share: float = 0.75) -> DataFrame:
    """Only the rows of names whose rank sum does not exceed the given quantile."""
    sums = rank_sums(full, column, row_id)
    cut = sums.agg(F.percentile(F.col("score").cast("double"), share)).head()[0]
    return full.join(sums.filter(F.col("score") <= cut).select(column), column, "left_semi")


def dataset_counts(full: DataFrame) -> DataFrame:
    return full.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


def best_runs(runs: DataFrame, problem_type: str, row_order: str) -> DataFrame:
    """The run of highest composite per dataset; the earliest wins ties.

    Binary runs compare the unrounded mean, multiclass ones the rounded mean. A
    run without a composite never wins over one that has it.
    """
    from lopside.sources.kb import BINARY_METRICS, stored_score
    from lopside.functions.scalars import mean_of

    raw = mean_of(*[F.col(f"`{m}`") for m in BINARY_METRICS])
    score = stored_score("multiclass") if problem_type == "multiclass" else raw
    key = F.struct(F.coalesce(score, F.lit(float("-inf"))).alias("s"), (-F.col(row_order)).alias("o"))
    return runs.groupBy("dataset").agg(F.max_by(F.struct("*"), key).alias("best")).select("best.*")
