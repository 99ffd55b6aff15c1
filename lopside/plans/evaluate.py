"""Cross-validating (resampler, classifier) combinations."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.dataset import Dataset
from lopside.functions import metrics
from lopside.functions.draws import SEED
from lopside.operators.classify import CLASSIFIERS, Effort
from lopside.operators.folds import stratified_folds
from lopside.operators.prep import categorical_columns, levels, sanitize_names
from lopside.operators.resample import resample
from lopside.operators.resample.common import class_sizes
from lopside.session import pin, shared_folder
from lopside.sources.kb import STORED_AS

# The portfolios in force for two classes and for more.
BINARY_RESAMPLERS = ["RandomOverSampler", "SMOTE", "SVMSMOTE", "SMOTETomek"]
BINARY_CLASSIFIERS = ["LGBMClassifier", "XGBClassifier", "GradientBoostingClassifier"]
MULTICLASS_RESAMPLERS = [
    "RandomOverSampler", "SMOTE", "SMOTETomek", "ADASYN", "EditedNearestNeighbours", "RandomUnderSampler", "TomekLinks",
]
MULTICLASS_CLASSIFIERS = [
    "RandomForestClassifier", "AdaBoostClassifier", "BaggingClassifier", "GradientBoostingClassifier", "EasyEnsembleClassifier",
    "RUSBoostClassifier", "BalancedBaggingClassifier", "BalancedRandomForestClassifier",
]
NO_RESAMPLING = "(no pre processing)"
RUN = ["pre processing", "algorithm"]


@dataclass
class Outcome:
    predictions: DataFrame | None  # one row per (run, repeat, fold, test row)
    runs: DataFrame                # pre processing, algorithm, status, error, time
    problem_type: str
    positive: str | None


def portfolio(problem_type: str) -> tuple[list[str], list[str]]:
    if problem_type == "multiclass":
        return MULTICLASS_RESAMPLERS, MULTICLASS_CLASSIFIERS
    return BINARY_RESAMPLERS, BINARY_CLASSIFIERS


def encoded(ds: Dataset) -> Dataset:
    """Text and boolean features as 0/1 columns without their first level, names made safe.

    Numeric columns stay in front. The target stays as it is; classes are numbered
    when a model is fitted.
    """
    text = [c for c in ds.features if c in categorical_columns(ds.df)]
    found = levels(ds.df, text)
    plain = [c for c in ds.features if c not in text]
    exprs = [F.col(f"`{c}`") for c in plain]
    exprs += [F.coalesce((F.col(f"`{c}`") == F.lit(v)).cast("int"), F.lit(0)) for c in text for v in found[c][1:]]
    names = sanitize_names(ds.df.sparkSession, plain + [f"{c}_{v}" for c in text for v in found[c][1:]])
    df = ds.df.select(F.col(ds.row_id), *[e.alias(n) for e, n in zip(exprs, names)], F.col(f"`{ds.target}`").alias("target"))
    return Dataset(df, names, "target", ds.row_id, ds.name)


def evaluate(points: DataFrame, resamplers: list[str], classifiers: list[str], folds: int = 10, repeats: int = 3,
             seed: int = SEED, effort: Effort = Effort(), parallelism: int = 8) -> Outcome:
    """Out-of-fold predictions of every combination.

    Only training parts are resampled, once per (resampler, fold) for all
    classifiers. Folds run side by side from a small thread pool, their Spark jobs
    sharing the cluster. A combination that fails on any fold is reported in
    ``runs`` and leaves the rest alone; its other folds, whose predictions would not be used, are not started.
    """
    points = pin(points)
    classes = sorted(class_sizes(points))
    problem = "multiclass" if len(classes) > 2 else "binary"
    positive = classes[-1] if problem == "binary" else None
    dealt = pin(stratified_folds(points, "label", "id", folds, repeats, seed))
    spark, folder = points.sparkSession, f"{shared_folder(points.sparkSession)}/lopside/{uuid.uuid4().hex}"
    took: list[tuple[str, str, float]] = []  # one entry per fit, summed once the pool is done
    failed: dict[tuple[str, str], str] = {}

    def one(task):
        balancing, repeat, fold = task
        if all((balancing, c) in failed for c in classifiers):
            return
        mine = dealt.filter(F.col("repeat") == repeat)
        test = mine.filter(F.col("fold") == fold).select("id", "label", "x")
        start = time.time()
        try:
            train = pin(resample(mine.filter(F.col("fold") != fold).select("id", "label", "x"), balancing, seed).select("id", "label", "x"))
        except Exception as e:  # noqa: BLE001 - any failure is a result here
            for c in classifiers:
                failed[balancing, c] = f"{type(e).__name__}: {e}"
            return
        prepared = time.time() - start
        for c in classifiers:
            if (balancing, c) in failed:
                continue
            start = time.time()
            try:
                out = CLASSIFIERS[c](train, classes, seed, effort)(test)
                out = out.select(F.lit(balancing).alias(RUN[0]), F.lit(c).alias(RUN[1]), F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "id", "y", "yhat", "scores")
                out.write.parquet(f"{folder}/{uuid.uuid4().hex}")
                written.append(out.schema)
                took.append((balancing, c, prepared + time.time() - start))
            except Exception as e:  # noqa: BLE001
                failed[balancing, c] = f"{type(e).__name__}: {e}"

    tasks = [(b, r, f) for b in resamplers for r in range(repeats) for f in range(folds)]
    written: list = []
    with ThreadPool(max(1, parallelism)) as pool:
        pool.map(one, tasks, chunksize=1)
    spent: dict[tuple[str, str], float] = {(b, c): 0.0 for b in resamplers for c in classifiers}
    for b, c, seconds in took:
        spent[b, c] += seconds
    predictions = spark.read.schema(written[0]).parquet(f"{folder}/*") if written else None
    rows = [(b, c, "failed" if (b, c) in failed else "success", failed.get((b, c)), round(t, 3)) for (b, c), t in spent.items()]
    runs = spark.createDataFrame(rows, "`pre processing` string, algorithm string, status string, error string, time double")
    if predictions is not None:
        good = F.broadcast(runs.filter(F.col("status") == "success").select(*RUN))  # one row per combination
        predictions = predictions.join(good, RUN, "left_semi")
    return Outcome(predictions, runs, problem, positive)


def fold_scores(outcome: Outcome) -> DataFrame:
    """Every score of every (run, repeat, fold), from one aggregation over all runs."""
    preds = outcome.predictions
    if outcome.positive is not None:
        preds = preds.withColumn("score", F.col("scores")[outcome.positive])
    return metrics.fold_scores(preds, [*RUN, "repeat", "fold"], outcome.problem_type, outcome.positive)


def result_rows(outcome: Outcome, dataset: str) -> DataFrame:
    """One row per combination in the knowledge base's columns (metrics rounded to 3 decimals)."""
    names = metrics.metric_names(outcome.problem_type)
    means = metrics.summarise(fold_scores(outcome), RUN, names)
    renamed = [F.col(m).alias(STORED_AS[m]) for m in names] + [F.col(f"{m}_std").alias(f"{STORED_AS[m]} std") for m in names]
    return means.select(*RUN, *renamed).join(outcome.runs.select(*RUN, "time"), RUN).withColumn("dataset", F.lit(dataset))


def final_by_fold(outcome: Outcome, dataset: str, app: str) -> DataFrame:
    """Fold rows 1.. with the composite of each fold and its spread over the five metrics."""
    from lopside.functions.scalars import mean_of, round3, std_of

    cols = [F.col(m) for m in metrics.COMPOSITE[outcome.problem_type]]
    folds = fold_scores(outcome)
    per = folds.agg(F.max("fold") + 1).head()[0]
    return folds.join(outcome.runs.select(*RUN, "time"), RUN).select(
        F.lit(dataset).alias("dataset"), *RUN, F.lit(app).alias("output app"),
        (F.col("repeat") * per + F.col("fold") + 1).cast("int").alias("fold"), "time",
        round3(mean_of(*cols)).alias("final score"), round3(std_of(*cols)).alias("final score std"),
    )
