"""Recommending combinations from datasets with similar meta-features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lopside.functions.scalars import euclidean, min_max_row, report_line
from lopside.operators.neighbours import nearest
from lopside.operators.prep import drop_incomplete_columns
from lopside.session import pin
from lopside.sources.kb import UNKNOWN

INFO = ["dataset", "pre processing", "algorithm"]


def name_id(name: Column) -> Column:
    """A bigint for a dataset name; used to settle equal distances."""
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")


def profile(kb: DataFrame, strict: bool = False, scaling: str = "row") -> DataFrame:
    """(dataset, pre processing, algorithm, x): complete meta-features as a scaled vector.

    Features with a null, NaN or infinite value anywhere are left out. ``row``
    scales a record by its own extremes; ``column`` scales each feature over the
    knowledge base. Rows still marked "?" stay only as queries, or take part
    fully with ``strict``.
    """
    features = [c for c in kb.columns if c not in INFO]
    whole = drop_incomplete_columns(kb.select(*[F.col(f"`{c}`") for c in features])).columns
    values = [F.col(f"`{c}`").cast("double") for c in whole]
    if scaling == "column":
        ends = kb.agg(*[F.struct(F.min(v), F.max(v)).alias(f"e{i}") for i, v in enumerate(values)]).head()
        values = [
            (v - ends[i][0]) / (ends[i][1] - ends[i][0]) if ends[i][1] > ends[i][0] else F.lit(0.0) for i, v in enumerate(values)
        ]
        x = F.array(*values)
    else:
        x = min_max_row(F.array(*values))
    out = kb.select(*INFO, x.alias("x"))
    return out.withColumn("offered", F.lit(True) if strict else (F.col("pre processing") != UNKNOWN) & (F.col("algorithm") != UNKNOWN))


def distances_to(kb: DataFrame, dataset: str, strict: bool = False, scaling: str = "row") -> DataFrame:
    """Distance of every other dataset to one dataset."""
    rows = profile(kb, strict, scaling)
    one = rows.filter(F.col("dataset") == dataset).select(F.col("x").alias("qx"))
    others = rows.filter((F.col("dataset") != dataset) & F.col("offered"))
    met = others.join(F.broadcast(one.limit(1)), F.lit(True))  # a single row
    return met.select(*INFO, euclidean(F.col("x"), F.col("qx")).alias("distance"))


def recommend(kb: DataFrame, dataset: str, top: int = 3, strict: bool = False, scaling: str = "row") -> DataFrame:
    """The ``top`` distinct combinations of the nearest datasets: rank, pair, dataset, distance."""
    far = distances_to(kb, dataset, strict, scaling)
    # one row per combination survives the combine step, however long the table
    first = far.groupBy("pre processing", "algorithm").agg(
        F.min(F.struct("distance", name_id(F.col("dataset")).alias("key"), "dataset")).alias("m")
    )
    best = first.select("pre processing", "algorithm", "m.*").orderBy("distance", "key").limit(top)
    rank = F.row_number().over(Window.orderBy("distance", "key"))
    return best.withColumn("rank", rank).drop("key")


def recommend_all(kb: DataFrame, top: int = 3, strict: bool = False) -> DataFrame:
    """``recommend`` for every dataset of the knowledge base at once.

    A neighbour search over all datasets that keeps, of each combination, the nearest dataset.
    """
    rows = pin(profile(kb, strict).withColumn("id", name_id(F.col("dataset"))))
    combo = F.to_json(F.struct("pre processing", "algorithm"))
    pts = rows.select("id", combo.alias("label"), "x", "offered")
    best = nearest(pts, pts.filter("offered"), top, "distinct")
    best = best.select("id", "nid", F.col("dist").alias("distance"), "rank")
    asked = rows.select("id", "dataset")
    near = rows.select(F.col("id").alias("nid"), F.col("dataset").alias("neighbour"), "pre processing", "algorithm")
    return best.join(asked, "id").join(near, "nid").drop("id", "nid")


def report(best: DataFrame) -> DataFrame:
    """Text lines of a recommendation, header first; fewer than three rows are fine."""
    spark = best.sparkSession
    head = spark.createDataFrame([(0, "Rank", "Pre Processing", "Algorithm")], "rank int, r string, p string, a string")
    body = best.select("rank", F.col("rank").cast("string").alias("r"), F.col("pre processing").alias("p"), F.col("algorithm").alias("a"))
    lines = head.unionByName(body)
    return lines.orderBy("rank").select("rank", report_line(F.col("r"), F.col("p"), F.col("a")).alias("line"))


# Fixed value: the report's title.
TITLE = "Top performing combinations of Pre Processing Technique with a Classifier Algorithm"


def report_text(best: DataFrame) -> str:
    """The report as one text (at most ``top`` + 1 lines)."""
    return TITLE + "\n\n" + "\n".join(r["line"] for r in report(best).collect()) + "\n"
