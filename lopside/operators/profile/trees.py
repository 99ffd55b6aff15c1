"""Meta-features of one decision tree fitted to the table.

Spark grows binned trees of depth 30 at most, so values differ from those of an
exact CART tree; their relations (leaves = nodes + 1, shares adding to 1) hold.
"""

from __future__ import annotations

import math
import uuid

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED
from lopside.operators.profile.summary import summarise, summarise_rows
from lopside.operators.resample.common import by_label, class_sizes
from lopside.session import pin, shared_folder

MAX_DEPTH = 30


def coded(points: DataFrame) -> tuple[DataFrame, list[str]]:
    """id, label, y (class number), features (vector)."""
    names = sorted(class_sizes(points))
    y = by_label({c: float(i) for i, c in enumerate(names)})
    return points.select("id", "label", y.alias("y"), array_to_vector("x").alias("features")), names


def node_table(model) -> DataFrame:
    """(id, depth, leaf, feature, rows, class) of every node of a fitted tree, read from the model as Spark saves it.

    Depths come from parent links followed by doubling, so the rounds grow with the logarithm of the depth.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/lopside/{uuid.uuid4().hex}"
    model.save(path)
    saved = spark.read.parquet(f"{path}/data")
    leaf = F.col("leftChild") < 0
    rows = F.aggregate("impurityStats", F.lit(0.0), lambda s, v: s + v)
    nodes = saved.select("id", leaf.alias("leaf"), F.when(~leaf, F.col("split.featureIndex")).alias("feature"), rows.alias("rows"), F.col("prediction").alias("class"))
    below = saved.filter(~leaf).select(F.col("id").alias("up"), F.explode(F.array("leftChild", "rightChild")).alias("id"))
    path_up = pin(saved.select("id").join(below, "id", "left").select("id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")))
    while not path_up.filter("up IS NOT NULL").isEmpty():
        ahead = path_up.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        path_up = pin(path_up.join(ahead, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return nodes.join(path_up.select("id", "depth"), "id")


def _counts(df: DataFrame, *by: str) -> list:
    """One row per group: at most a tree's depth, features or classes."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()


def tree(points: DataFrame, seed: int = SEED, depth: int = MAX_DEPTH) -> dict[str, object]:
    ready, names = coded(points)
    ready = pin(ready)
    model = DecisionTreeClassifier(labelCol="y", maxDepth=depth, seed=seed).fit(ready)
    nodes = pin(node_table(model))
    n, m = ready.count(), model.numFeatures
    inner, leaves = nodes.filter("not leaf"), nodes.filter("leaf")
    at_depth, by_class = _counts(inner, "depth"), _counts(leaves, "class")
    by_path = _counts(leaves, "depth")
    splits, ends = sum(r["n"] for r in at_depth), sum(r["n"] for r in by_path)
    weights = [r["n"] / 2 ** r["depth"] for r in by_path]
    shape = F.col("depth") / F.pow(F.lit(2.0), F.col("depth"))
    per_leaf = leaves.select(F.col("depth").alias("leaves_branch"), (F.col("rows") / n).alias("leaves_corrob"), shape.alias("tree_shape"),
                             F.when(shape > 0, ends / shape).alias("leaves_homo"))
    held = {r["class"]: r["n"] for r in by_class}
    return {
        "leaves": ends, "nodes": splits, "nodes_per_attr": splits / m, "nodes_per_inst": splits / n,
        "nodes_per_level": summarise([r["n"] for r in at_depth]), "nodes_repeated": summarise([r["n"] for r in _counts(inner, "feature")]),
        **summarise_rows(per_leaf, ["leaves_branch", "leaves_corrob", "leaves_homo", "tree_shape"]),
        "leaves_per_class": summarise([held.get(float(c), 0) / ends for c in range(len(names))]),
        **{"tree_depth": summarise_rows(nodes, ["depth"])["depth"]}, "tree_imbalance": summarise([-w * math.log2(w) for w in weights]),
        "var_importance": summarise(model.featureImportances.toArray()),
    }
