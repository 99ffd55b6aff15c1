"""What all classifiers share.

A classifier is fitted on points (id, label, x) and returns a function from
points to predictions: id, y, yhat and ``scores``, a map of class probabilities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.operators.prep import balanced_weights
from lopside.operators.resample.common import by_label

Predictor = Callable[[DataFrame], DataFrame]
CLASSIFIERS: dict[str, Callable[..., Predictor]] = {}


@dataclass(frozen=True)
class Effort:
    """Sizes of the fitted models; the defaults are those of a full run."""

    trees: int = 100       # trees of a forest, steps of a boosted model
    rounds: int = 50       # rounds of AdaBoost and RUSBoost
    members: int = 10      # members of a bagged or balanced ensemble
    depth: int = 30        # depth limit of Spark's own trees, the largest it allows; grown trees have none
    cuts: int = 16         # random cut points per feature and node of a grown forest
    waves: int = 512       # random features that stand for a Gaussian kernel
    iterations: int = 100  # steps of linear solvers


def classifier(name: str):
    def add(fn):
        CLASSIFIERS[name] = fn
        return fn

    return add


def ready(points: DataFrame, classes: list[str], weighted: bool = False) -> DataFrame:
    """id, label, y (class number), features, and a balanced weight where asked."""
    df = balanced_weights(points, "label") if weighted else points
    y = by_label({c: float(i) for i, c in enumerate(classes)}).alias("y")
    return df.select("id", "label", y, array_to_vector("x").alias("features"), *(["weight"] if weighted else []))


def score_map(values: Column, classes: list[str]) -> Column:
    """Class -> score from an array that may be shorter than the class list."""
    found = [F.coalesce(F.get(values, F.lit(i)), F.lit(0.0)) for i in range(len(classes))]
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), F.array(*found))


def named(number: Column, classes: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in classes]), number.cast("int") + 1)


def output(df: DataFrame, classes: list[str], values: Column) -> DataFrame:
    """Predictions from a frame holding id, label, ``prediction`` and an array of class scores."""
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    share = F.when(total > 0, F.transform(values, lambda v: v / total)).otherwise(values)
    return df.select("id", F.col("label").alias("y"), named(F.col("prediction"), classes).alias("yhat"), score_map(share, classes).alias("scores"))


def probabilities() -> Column:
    return vector_to_array("probability")


def squashed() -> Column:
    """Scores in (0, 1) from margins."""
    return F.transform(vector_to_array("rawPrediction"), lambda v: 1 / (1 + F.exp(-v)))


def fitted(estimator, points: DataFrame, classes: list[str], weighted: bool = False) -> Predictor:
    """Fit a Spark ML classifier; margins stand in where it gives no probabilities."""
    model = estimator.fit(ready(points, classes, weighted))

    def predict(test: DataFrame) -> DataFrame:
        out = model.transform(ready(test, classes))
        return output(out, classes, probabilities() if "probability" in out.columns else squashed())

    return predict
