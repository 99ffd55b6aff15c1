"""The learning and recommendation modules, end to end."""

from __future__ import annotations

import time
import traceback

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lopside.dataset import Dataset
from lopside.functions.scalars import format_hms
from lopside.operators.classify import Effort
from lopside.plans.characterise import GROUPS, characterise
from lopside.plans.evaluate import NO_RESAMPLING, encoded, evaluate, portfolio, result_rows
from lopside.plans.ranking import best_runs
from lopside.plans.recommend import recommend, report_text
from lopside.operators.prep import problem_type
from lopside.session import pin
from lopside.sources import kb as store
from lopside.sources.kb import KnowledgeBase
from lopside.sources.tables import list_csv, load


def assess(ds: Dataset, resamplers: list[str] | None = None, classifiers: list[str] | None = None, folds: int = 10,
           repeats: int = 3, effort: Effort = Effort(), parallelism: int = 4) -> tuple[DataFrame, DataFrame, str]:
    """(result rows, run status, problem type) of a portfolio; nothing is stored."""
    kind = problem_type(ds.df, ds.target).head()["problem_type"]
    default_r, default_c = portfolio(kind)
    out = evaluate(encoded(ds).points(), resamplers or default_r, classifiers or default_c, folds, repeats, effort=effort, parallelism=parallelism)
    if out.predictions is None:
        raise RuntimeError("every combination failed: " + str(out.runs.head()["error"]))
    return pin(result_rows(out, ds.name)), out.runs, kind


def assess_plain(ds: Dataset, **options) -> DataFrame:
    """The classifiers without resampling and without storing anything."""
    return assess(ds, resamplers=[NO_RESAMPLING], **options)[0]


def _ordered(rows: DataFrame, resamplers: list[str], classifiers: list[str]) -> DataFrame:
    """Add ``no``: the place of a combination in the portfolio."""
    places = {(b, c): i for i, (b, c) in enumerate((b, c) for b in resamplers for c in classifiers)}
    table = rows.sparkSession.createDataFrame([(b, c, i) for (b, c), i in places.items()], "`pre processing` string, algorithm string, no int")
    return rows.join(F.broadcast(table), ["pre processing", "algorithm"])


def learn(ds: Dataset, base: KnowledgeBase, resamplers: list[str] | None = None, classifiers: list[str] | None = None,
          groups: list[str] = GROUPS, **options) -> DataFrame:
    """Evaluate, keep the best and store results, all combinations and meta-features.

    A dataset stored for the first time counts as updated, so its meta-features
    carry the combination that was found.
    """
    spark, start = ds.df.sparkSession, time.time()
    features = pin(characterise(ds, groups))
    rows, runs, kind = assess(ds, resamplers, classifiers, **options)
    default_r, default_c = portfolio(kind)
    ordered = _ordered(rows, resamplers or default_r, classifiers or default_c)
    best = best_runs(ordered, kind, "no").drop("no")
    best = best.withColumn("total elapsed time", format_hms(F.lit(time.time() - start)))
    best = pin(store.with_columns(store.payload(store.with_columns(best, store.RESULT_COLUMNS), kind), store.RESULT_COLUMNS))
    stored = base.load("kb_results", kind, store.RESULT_COLUMNS)
    merged = pin(store.upsert_results(stored, best, kind))
    base.save("kb_results", merged.drop("action"), kind)
    full = base.load("kb_full_results", kind, store.FULL_COLUMNS)
    new = store.payload(store.with_columns(rows, store.FULL_COLUMNS), kind)
    base.save("kb_full_results", store.insert_full_results(full, new, kind), kind)
    changed = merged.select("dataset", F.col("action").isin("insert", "update").alias("updated"))
    combo = best.select("dataset", "pre processing", "algorithm").join(changed, "dataset")
    known = _characteristics(base, kind)
    base.save("kb_characteristics", store.upsert_characteristics(known, features, combo), kind)
    return merged.filter(F.col("dataset") == ds.name)


def _characteristics(base: KnowledgeBase, kind: str) -> DataFrame:
    if base.versions("kb_characteristics"):
        return base.load("kb_characteristics", kind)
    return base.spark.createDataFrame([], "dataset string, `pre processing` string, algorithm string")


def suggest(ds: Dataset, base: KnowledgeBase, groups: list[str] = GROUPS, strict: bool = False) -> str:
    """The report of the three best combinations for a dataset, by meta-features."""
    kind = problem_type(ds.df, ds.target).head()["problem_type"]
    features = pin(characterise(ds, groups))
    base.save("kb_characteristics", store.upsert_characteristics(_characteristics(base, kind), features, None), kind)
    return report_text(recommend(base.load("kb_characteristics", kind), ds.name, strict=strict))


def learn_folder(spark: SparkSession, folder: str, base: KnowledgeBase, **options) -> DataFrame:
    """Learn every CSV of a folder not yet in the knowledge base: dataset, status, error.

    One dataset after the other, each a series of distributed jobs; a failing one
    is recorded and the next goes on.
    """
    rows = []
    for name in list_csv(spark, folder):
        done = any(
            not base.load("kb_results", kind, store.RESULT_COLUMNS).filter(F.col("dataset") == name).isEmpty()
            for kind in ("binary", "multiclass")
        )
        if done:
            rows.append((name, "skipped", None))
            continue
        try:
            learn(load(spark, f"{folder.rstrip('/')}/{name}"), base, **options)
            rows.append((name, "success", None))
        except Exception:  # noqa: BLE001 - reported, not raised
            rows.append((name, "failed", traceback.format_exc(limit=-1)))
    return spark.createDataFrame(rows, "dataset string, status string, error string")
