"""All meta-features of a dataset as one wide row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.dataset import Dataset
from lopside.operators.prep import numeric_columns
from lopside.operators.profile import complexity, concept, cover, density, itemset, landmarks, statistical, trees
from lopside.operators.profile.scatter import scatter
from lopside.operators.profile.summary import as_frame, summarise
from lopside.plans.evaluate import encoded
from lopside.session import pin

GROUPS = ["general", "statistical", "itemset", "concept", "complexity", "landmarking", "model-based"]


def meta_features(ds: Dataset, groups: list[str] = GROUPS) -> dict[str, object]:
    """Feature values by name; text features enter distances and models as 0/1 columns."""
    coded = encoded(ds)
    points = pin(coded.points())
    found: dict[str, object] = {}
    spread = scatter(points) if {"statistical", "complexity"} & set(groups) else None
    if "general" in groups:
        found.update(statistical.general(ds))
    if "statistical" in groups:
        numeric = [c for c in ds.features if c in numeric_columns(ds.df)]
        table, columns = (ds.df, numeric) if numeric else (coded.df, coded.features)
        found.update(statistical.per_column(table, columns))
        found.update(statistical.multivariate(spread))
    if "itemset" in groups:
        found.update(itemset.itemset(ds.df, ds.features))
    if "concept" in groups:
        found.update(concept.concept(points))
    if "complexity" in groups:
        ends = complexity._ends(points)
        found.update(complexity.from_scatter(spread))
        found["f2"] = summarise(complexity.f2_values(ends))
        found["f3"] = summarise(complexity.f3_values(points, ends))
        found["f4"] = summarise(complexity.f4_values(points))
        found.update(complexity.neighbourhood(points))
        found["n1"] = complexity.border_share(points)
        found["density"] = density.density(points)
        found["t1"] = cover.cover_share(points)
        found["n4"] = complexity.interpolated_error(points)
        found.update(complexity.linearity(points))
    if "landmarking" in groups:
        found.update(landmarks.landmarks(points))
    if "model-based" in groups:
        found.update(trees.tree(points))
    return found


def wide_row(spark, dataset: str, features: dict[str, object]) -> DataFrame:
    """(dataset, one column per number)."""
    long = as_frame(spark, features)
    names = sorted(r["feature"] for r in long.select("feature").collect())
    wide = long.withColumn("dataset", F.lit(dataset)).groupBy("dataset").pivot("feature", names).agg(F.first("value"))
    return wide


def characterise(ds: Dataset, groups: list[str] = GROUPS) -> DataFrame:
    return wide_row(ds.df.sparkSession, ds.name, meta_features(ds, groups))
