"""Boosted stumps and ensembles whose members see balanced samples."""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED
from lopside.operators.classify.common import Effort, Predictor, classifier, output, ready
from lopside.operators.classify.grower import Plan
from lopside.operators.classify.single import grown, root_of
from lopside.operators.resample.common import class_sizes
from lopside.operators.resample.under import random_under
from lopside.session import pin

PIN_EVERY = 5  # rounds between two cuts of the weights' lineage


class Stump(NamedTuple):
    """A tree of depth 1: the class where feature <= cut, and the class elsewhere."""

    feature: int
    cut: float
    low: float
    high: float

    @classmethod
    def of(cls, model) -> Stump:
        root = model._call_java("rootNode")
        if root.subtreeDepth() == 0:
            return cls(0, math.inf, root.prediction(), root.prediction())
        split = root.split()
        return cls(split.featureIndex(), split.threshold(), root.leftChild().prediction(), root.rightChild().prediction())

    def chosen(self, x: Column) -> Column:
        return F.when(x[self.feature] <= F.lit(self.cut), F.lit(self.low)).otherwise(F.lit(self.high))


def _votes(x: Column, stumps: list[Stump], strengths: list[float], k: int) -> Column:
    """Per class the summed strength of the stumps choosing it: one expression over an array of all stumps."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("fclhs", (*m, s))]) for m, s in zip(stumps, strengths)])

    def share(i: int) -> Column:
        def step(total: Column, m: Column) -> Column:
            choice = F.when(F.get(x, m["f"]) <= m["c"], m["l"]).otherwise(m["h"])
            return total + F.when(choice == float(i), m["s"]).otherwise(0.0)

        return F.aggregate(table, F.lit(0.0), step)

    return F.array(*[share(i) for i in range(k)])


def _boost(train: DataFrame, classes: list[str], seed: int, rounds: int, balanced: bool) -> tuple[list, list[float]]:
    """SAMME: weighted stumps, each round stressing the rows its stump got wrong.

    With ``balanced`` every stump is fitted on an under-sampled draw of the rows.
    """
    k = len(classes)
    now = pin(ready(train, classes).withColumns({"w": F.lit(1.0), "x": vector_to_array("features")}))
    models, strengths = [], []
    for r in range(rounds):
        part = now
        if balanced:
            picked = random_under(now.select("id", "label", F.array(F.lit(0.0)).alias("x")), seed, key=f"b{r}")
            part = pin(now.join(picked.select("id"), "id", "left_semi"))
        model = Stump.of(DecisionTreeClassifier(labelCol="y", weightCol="w", maxDepth=1, seed=seed + r).fit(part))
        seen = now.withColumn("miss", model.chosen(F.col("x")) != F.col("y"))
        sums = seen.agg(F.sum("w").alias("w"), F.sum(F.when(F.col("miss"), F.col("w")).otherwise(0.0)).alias("e")).head()
        error = sums["e"] / sums["w"]
        if error >= 1 - 1 / k:
            if not models:  # a stump no better than chance still has to answer
                return [model], [1.0]
            if not balanced:
                break
            continue
        strength = math.log((1 - error) / max(error, 1e-10)) + math.log(k - 1)
        models.append(model)
        strengths.append(strength)
        if error <= 0:
            break
        scale = F.when(F.col("miss"), F.col("w") * math.exp(strength)).otherwise(F.col("w")) / sums["w"]
        now = seen.select("id", "label", "y", "features", "x", scale.alias("w"))
        if (r + 1) % PIN_EVERY == 0:
            now = pin(now)
    return models, strengths


def _voting(models: list, strengths: list[float], classes: list[str]) -> Predictor:
    def predict(test: DataFrame) -> DataFrame:
        out = ready(test, classes).withColumn("votes", _votes(vector_to_array("features"), models, strengths, len(classes)))
        first = F.array_position("votes", F.array_max("votes")) - 1
        return output(out.withColumn("prediction", first), classes, F.col("votes"))

    return predict


@classifier("AdaBoostClassifier")
def adaboost(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return _voting(*_boost(train, classes, seed, effort.rounds, False), classes)


@classifier("RUSBoostClassifier")
def rusboost(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    return _voting(*_boost(train, classes, seed, effort.rounds, True), classes)


def _samples(train: DataFrame, seed: int, members: int):
    train = pin(train.select("id", "label", "x"))
    for b in range(members):
        yield b, pin(random_under(train, seed, key=f"m{b}"))


@classifier("EasyEnsembleClassifier")
def easy_ensemble(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    """AdaBoost on balanced samples, fitted side by side; each member's votes count as shares."""
    samples = list(_samples(train, seed, effort.members))
    with ThreadPool(8) as pool:
        fitted = pool.map(lambda s: _boost(s[1], classes, seed + s[0], effort.rounds, False), samples, chunksize=1)
    models, strengths = [], []
    for m, s in fitted:
        models += m
        strengths += [v / sum(s) for v in s]
    return _voting(models, strengths, classes)


def _averaged(models: list, classes: list[str]) -> Predictor:
    """Mean of the members' class probabilities."""
    k = len(classes)

    def predict(test: DataFrame) -> DataFrame:
        out = ready(test, classes).withColumn("votes", F.array(*[F.lit(0.0)] * k))
        for model in models:
            out = model.transform(out).withColumn("p", vector_to_array("probability"))
            cells = [F.col("votes")[i] + F.coalesce(F.get("p", F.lit(i)), F.lit(0.0)) for i in range(k)]
            out = out.withColumn("next", F.array(*cells)).drop("votes", "p", "prediction", "rawPrediction", "probability")
            out = out.withColumnRenamed("next", "votes")
        first = F.array_position("votes", F.array_max("votes")) - 1
        return output(out.withColumn("prediction", first), classes, F.col("votes"))

    return predict


@classifier("BalancedBaggingClassifier")
def balanced_bagging(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    models = [
        DecisionTreeClassifier(labelCol="y", maxDepth=effort.depth, seed=seed + b).fit(ready(sample, classes))
        for b, sample in _samples(train, seed, effort.members)
    ]
    return _averaged(models, classes)


@classifier("BalancedRandomForestClassifier")
def balanced_forest(train: DataFrame, classes: list[str], seed: int = SEED, effort: Effort = Effort()) -> Predictor:
    """Every tree on a balanced bootstrap of its own.

    A row counts in a tree as often as a Poisson draw says whose mean is the smallest class size over that of its
    class, so each class has about as many draws as the smallest; what is left of chance is evened out by class
    weights. A node tries sqrt(d) features with ``effort.cuts`` random cuts each.
    """
    sizes = class_sizes(train)
    few = min(sizes.values(), default=1)
    share = tuple(few / sizes[c] if sizes.get(c) else 0.0 for c in classes)
    return grown(train, classes, Plan(effort.trees, root_of(train), cuts=effort.cuts, share=share, seed=seed))
