"""Systems side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way(learning: DataFrame, recommended: DataFrame, baseline: DataFrame, value: str) -> DataFrame:
    """Scores of three systems joined on dataset, with their gains over the baseline."""
    sides = zip(("learning", "recommended", "baseline"), (learning, recommended, baseline))
    first, *rest = [df.select("dataset", F.col(f"`{value}`").alias(name)) for name, df in sides]
    for side in rest:
        first = first.join(side, "dataset")
    return first.withColumns({
        "learning_gain": F.col("learning") - F.col("baseline"), "recommended_gain": F.col("recommended") - F.col("baseline"),
    })


def ordered_as(df: DataFrame, key: str, order: list) -> DataFrame:
    """Rows in a hand-given order of ``key`` with their ``place``; keys not listed drop out."""
    kind = df.schema[key].dataType.simpleString()
    places = df.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(order)], f"`{key}` {kind}, place int")
    return df.join(F.broadcast(places), key).orderBy("place")  # the list is given by hand
