"""Spark ML classifiers under the names of the portfolio, and nearest-neighbour voting.

The two external boosting libraries of the portfolio are represented by
gradient-boosted-tree presets; the kernel machine by random Fourier features.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED
from lopside.operators.classify.common import Effort, Predictor, classifier, fitted, output, score_map
from lopside.operators.classify.grower import Plan, grow, leaf_scores
from lopside.operators.kernel import fourier_map
from lopside.operators.neighbours import nearest
from lopside.operators.resample.common import by_label
from lopside.session import pin


def _per_class(estimator, classes: list[str], weighted: bool = False):
    """The estimator itself for two classes, one model per class beyond."""
    if len(classes) <= 2:
        return estimator
    rest = OneVsRest(classifier=estimator, labelCol="y", parallelism=2)
    return rest.setWeightCol("weight") if weighted else rest


def _boosted(train, classes, weighted, **options) -> Predictor:
    gbt = GBTClassifier(labelCol="y", **options)
    if weighted:
        gbt = gbt.setWeightCol("weight")
    return fitted(_per_class(gbt, classes, weighted), train, classes, weighted)


@classifier("LGBMClassifier")
def wide_boosting(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return _boosted(train, classes, True, maxDepth=6, maxIter=effort.trees, stepSize=0.1, maxBins=64, seed=seed)


@classifier("XGBClassifier")
def regular_boosting(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return _boosted(train, classes, False, maxDepth=6, maxIter=effort.trees, stepSize=0.3, minInfoGain=0.001, subsamplingRate=0.9, seed=seed)


@classifier("GradientBoostingClassifier")
def shallow_boosting(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return _boosted(train, classes, False, maxDepth=3, maxIter=effort.trees, stepSize=0.1, seed=seed)


@classifier("RandomForestClassifier")
def forest(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    rf = RandomForestClassifier(labelCol="y", weightCol="weight", numTrees=effort.trees, maxDepth=effort.depth, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True)
    return fitted(rf, train, classes, True)


@classifier("RandomForestBaseline")
def forest_baseline(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    rf = RandomForestClassifier(labelCol="y", numTrees=effort.trees, maxDepth=effort.depth, featureSubsetStrategy="0.15", seed=seed, cacheNodeIds=True)
    return fitted(rf, train, classes)


def grown(train: DataFrame, classes: list[str], plan: Plan) -> Predictor:
    """A forest of unlimited depth, grown level by level."""
    y = by_label({c: i for i, c in enumerate(classes)})
    forest = grow(train.select("id", y.alias("y"), "x"), len(classes), plan)

    def predict(test: DataFrame) -> DataFrame:
        out = leaf_scores(test, forest)
        first = F.array_position("votes", F.array_max("votes")) - 1
        return output(out.withColumn("prediction", first), classes, F.col("votes"))

    return predict


def root_of(train: DataFrame) -> int:
    """How many features a node tries: the square root of their number."""
    return max(1, math.isqrt(train.agg(F.max(F.size("x"))).head()[0] or 1))


@classifier("ExtraTreesClassifier")
def extra_trees(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    """All rows in every tree, one random cut for each of sqrt(d) features of a node, classes of equal weight."""
    return grown(train, classes, Plan(effort.trees, root_of(train), seed=seed))


@classifier("BaggingClassifier")
def bagging(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    rf = RandomForestClassifier(labelCol="y", numTrees=effort.members, maxDepth=effort.depth, featureSubsetStrategy="all", seed=seed, cacheNodeIds=True)
    return fitted(rf, train, classes)


@classifier("LogisticRegression")
def logistic(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return fitted(LogisticRegression(labelCol="y", maxIter=effort.iterations, regParam=0.001), train, classes)


@classifier("GaussianNB")
def bayes(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return fitted(NaiveBayes(labelCol="y", modelType="gaussian"), train, classes)


@classifier("LinearSVC")
def linear_machine(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return fitted(_per_class(LinearSVC(labelCol="y", maxIter=effort.iterations, regParam=0.01), classes), train, classes)


@classifier("SVC")
def machine(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    """A Gaussian kernel as random features, a hinge loss with cost 1 a row; one machine per class beyond two."""
    train = pin(train.select("id", "label", "x"))
    mapped = fourier_map(train, waves=effort.waves, seed=seed)
    svc = LinearSVC(labelCol="y", maxIter=effort.iterations, regParam=1.0 / max(1, train.count()), standardization=False)
    predict = fitted(_per_class(svc, classes), pin(mapped(train)), classes)
    return lambda test: predict(mapped(test.select("id", "label", "x")))


def vote(near: DataFrame) -> DataFrame:
    """(id, y, yhat, share): majority label among the neighbours, the smaller label on a tie."""
    counts = near.groupBy("id", "label", "nlabel").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("id", "label").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "nlabel"))["nlabel"].alias("yhat"),
        F.map_from_entries(F.collect_list(F.struct("nlabel", "n"))).alias("n"),
    ).withColumnRenamed("label", "y")


@classifier("KNeighborsClassifier")
def neighbours(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort(), k: int = 5) -> Predictor:
    held = train.select("id", "label", "x")

    def predict(test: DataFrame) -> DataFrame:
        votes = vote(nearest(test.select("id", "label", "x"), held, k))
        total = F.aggregate(F.map_values("n"), F.lit(0).cast("bigint"), lambda s, v: s + v)
        share = F.array(*[F.coalesce(F.col("n")[c], F.lit(0)) / total for c in classes])
        return votes.select("id", "y", "yhat", score_map(share, classes).alias("scores"))

    return predict
