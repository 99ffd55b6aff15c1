"""Landmarks: accuracies of simple classifiers over stratified folds."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.ml.feature import VectorSlicer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED
from lopside.operators.folds import stratified_folds
from lopside.operators.neighbours import nearest
from lopside.operators.profile.scatter import scatter
from lopside.operators.profile.summary import summarise
from lopside.operators.profile.trees import coded
from lopside.session import pin

FOLDS = 10


def _dealt(points: DataFrame, folds: int, seed: int) -> DataFrame:
    return pin(stratified_folds(points.select("id", "label", "x"), "label", "id", folds, 1, seed).drop("repeat"))


def one_nn_rows(dealt: DataFrame) -> DataFrame:
    """(id, fold, hit): nearest row of another fold. All folds in one job: the fold
    takes the place of the class and neighbours must differ in it."""
    pts = dealt.select("id", F.col("fold").cast("string").alias("label"), "x")
    near = nearest(pts, pts, 1, "other").select("id", "nid")
    names = dealt.select(F.col("id").alias("nid"), F.col("label").alias("nlabel"))
    met = near.join(dealt.select("id", "fold", "label"), "id").join(names, "nid")
    return met.select("id", "fold", (F.col("label") == F.col("nlabel")).cast("int").alias("hit"))


def _accuracies(rows: DataFrame) -> list[float]:
    return [r["a"] for r in rows.groupBy("fold").agg(F.avg("hit").alias("a")).collect()]


def one_nn(points: DataFrame, folds: int = FOLDS, seed: int = SEED) -> list[float]:
    return _accuracies(one_nn_rows(_dealt(points, folds, seed)))


def _by_fold(dealt: DataFrame, folds: int, fit) -> list[float]:
    ready, _ = coded(dealt)
    ready = pin(ready.join(dealt.select("id", "fold"), "id"))
    out = []
    for f in range(folds):
        model = fit(ready.filter(F.col("fold") != f))
        hit = model.transform(ready.filter(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")))
        out.append(hit.head()[0])
    return out


def _stump(columns: list[int], seed: int):
    def fit(train: DataFrame):
        from pyspark.ml import Pipeline

        slicer = VectorSlicer(inputCol="features", outputCol="some", indices=columns)
        return Pipeline(stages=[slicer, DecisionTreeClassifier(labelCol="y", featuresCol="some", maxDepth=1, seed=seed)]).fit(train)

    return fit


def linear_discriminant(dealt: DataFrame, folds: int) -> list[float]:
    """LDA from class means and the pooled scatter of each training part."""
    out = []
    for f in range(folds):
        s = scatter(dealt.filter(F.col("fold") != f))
        inverse = np.linalg.pinv(s.within.sum(0) / max(s.n.sum() - len(s.labels), 1))
        way = s.mean @ inverse
        offset = np.log(s.n / s.n.sum()) - 0.5 * (way * s.mean).sum(1)
        x = F.col("x")
        scores = []
        for k, label in enumerate(s.labels):
            w = F.array(*[F.lit(float(v)) for v in way[k]])
            dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
            scores.append(F.struct((dot + float(offset[k])).alias("score"), F.lit(label).alias("label")))
        best = F.array_max(F.array(*scores))["label"]
        test = dealt.filter(F.col("fold") == f)
        out.append(test.agg(F.avg((best == F.col("label")).cast("int"))).head()[0])
    return out


def landmarks(points: DataFrame, folds: int = FOLDS, seed: int = SEED) -> dict[str, object]:
    """Stumps on the best, worst and a random feature, LDA, Gaussian Bayes, 1-NN on all and on the best features."""
    dealt = _dealt(points, folds, seed)
    ready, _ = coded(dealt)
    weight = DecisionTreeClassifier(labelCol="y", maxDepth=5, seed=seed).fit(ready).featureImportances.toArray()
    order = [int(i) for i in np.argsort(-weight, kind="stable")]
    rng = np.random.default_rng(seed)
    best = sorted(order[: max(1, len(order) // 2)])
    slim = dealt.withColumn("x", F.array(*[F.col("x")[i] for i in best]))
    return {
        "best_node": summarise(_by_fold(dealt, folds, _stump([order[0]], seed))),
        "worst_node": summarise(_by_fold(dealt, folds, _stump([order[-1]], seed))),
        "random_node": summarise(_by_fold(dealt, folds, _stump([int(rng.integers(len(order)))], seed))),
        "linear_discr": summarise(linear_discriminant(dealt, folds)),
        "naive_bayes": summarise(_by_fold(dealt, folds, lambda t: NaiveBayes(labelCol="y", modelType="gaussian").fit(t))),
        "one_nn": summarise(_accuracies(one_nn_rows(dealt))), "elite_nn": summarise(_accuracies(one_nn_rows(slim))),
    }
