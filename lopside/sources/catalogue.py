"""Searching a catalogue of dataset statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.session import parallelism, pin

# Catalogue columns that must be known, and those a search returns.
REQUIRED = [
    "NumberOfClasses", "NumberOfInstances", "NumberOfFeatures", "MajorityClassSize", "MinorityClassSize",
    "NumberOfMissingValues",
]
SHOWN = [
    "did", "name", "NumberOfClasses", "NumberOfInstances", "NumberOfFeatures", "MajorityClassSize", "MinorityClassSize",
    "ImbalanceRatio", "NumberOfMissingValues",
]
BOUNDS = {
    "classes": "NumberOfClasses", "instances": "NumberOfInstances", "features": "NumberOfFeatures", "imbalance": "ImbalanceRatio",
}
# Cells of the grid that counts matches: ranges per statistic, by quantiles.
GRID = {"classes": 8, "instances": 16, "features": 8, "imbalance": 16}
# The default search.
DEFAULTS = {
    "min_classes": 3, "max_classes": 50, "min_instances": 500, "max_instances": 10000, "min_features": 10, "max_features": 40,
    "min_imbalance": 3.0, "max_imbalance": 100.0, "allow_missing_values": False, "max_results": 100,
}
SUMMARY_DEFAULTS = {
    "min_classes": 3, "max_classes": 100, "min_instances": 500, "max_instances": 20000, "min_features": 5, "max_features": 80,
    "min_imbalance": 0.1, "max_imbalance": 1.0, "max_results": 100,
}


def known(catalogue: DataFrame) -> DataFrame:
    """Rows with the six statistics."""
    return catalogue.na.drop(subset=REQUIRED)


def with_ratio(catalogue: DataFrame) -> DataFrame:
    """Rows with a non-empty minority class, and their imbalance ratio."""
    ratio = F.col("MajorityClassSize") / F.col("MinorityClassSize")
    return catalogue.filter(F.col("MinorityClassSize") > 0).withColumn("ImbalanceRatio", ratio)


def search(catalogue: DataFrame, **options) -> DataFrame:
    """The most imbalanced datasets within the ranges; ties by ``did``."""
    o = {**DEFAULTS, **options}
    rows = with_ratio(known(catalogue))
    for name, column in BOUNDS.items():
        rows = rows.filter(F.col(column).between(o[f"min_{name}"], o[f"max_{name}"]))
    if not o["allow_missing_values"]:
        rows = rows.filter(F.col("NumberOfMissingValues") == 0)
    return rows.orderBy(F.desc("ImbalanceRatio"), "did").limit(o["max_results"]).select(SHOWN)


def search_summaries(summaries: DataFrame, **options) -> DataFrame:
    """The summary-statistics variant; its ``imbalance`` is a score from 0 to 1."""
    o = {**SUMMARY_DEFAULTS, **options}
    rows = summaries.filter(F.col("task") == "classification")
    for name, column in (("classes", "n_classes"), ("instances", "n_instances"), ("features", "n_features"), ("imbalance", "imbalance")):
        rows = rows.filter(F.col(column).between(o[f"min_{name}"], o[f"max_{name}"]))
    rows = rows.orderBy(F.desc("imbalance"), "dataset").limit(o["max_results"])
    return rows.select("dataset", "n_classes", "n_instances", "n_features", "imbalance")


def binary_candidates(catalogue: DataFrame) -> DataFrame:
    """Active two-class tables of moderate size that miss values."""
    return catalogue.filter(
        "status = 'active' AND NumberOfClasses = 2 AND NumberOfInstances > 200 AND NumberOfInstances < 10000 "
        "AND NumberOfFeatures < 500 AND NumberOfMissingValues > 0"
    )


def imbalance_band(ratios: DataFrame, low: float | None = 2.0, high: float | None = 2.5) -> DataFrame:
    """Rows with low < imbalance ratio <= high, in order."""
    ratio = F.col("imbalance ratio")
    if low is not None:
        ratios = ratios.filter(ratio > low)
    if high is not None:
        ratios = ratios.filter(ratio <= high)
    return ratios.orderBy("imbalance ratio", "id")


def _cell(cuts: dict[str, list[float]]) -> Column:
    """The number of the grid cell of a row: mixed-radix digits, one per statistic."""
    cell = F.lit(0)
    for name, ends in cuts.items():
        digit = reduce(lambda total, end: total + F.when(F.col(BOUNDS[name]) > end, 1).otherwise(0), ends, F.lit(0))
        cell = cell * (len(ends) + 1) + digit
    return cell.cast("int")


def _asked_cells(asked: DataFrame, cells: list) -> DataFrame:
    """Per configuration the rows of the cells wholly inside its ranges (``inside``) and the cells its ranges cut (``cut``).

    Cells are left uncounted once ``inside`` reaches ``enough``.
    """
    low, high = (np.array([[c[f"{end}_{n}"] for c in cells] for n in BOUNDS], dtype=float) for end in ("lo", "hi"))
    number = np.array([c["cell"] for c in cells], dtype=np.int32)
    rows = {full: np.array([c[name] for c in cells], dtype=np.int64) for name, full in (("n", True), ("n_whole", False))}
    shared = asked.sparkSession.sparkContext.broadcast((low, high, number, rows))

    def run(batches):
        low, high, number, rows = shared.value
        for batch in batches:
            least, most = (np.array([batch.column(f"{end}_{n}").to_numpy(zero_copy_only=False) for n in BOUNDS], dtype=float) for end in ("min", "max"))
            allowed, enough = batch.column("allowed").to_numpy(zero_copy_only=False), batch.column("enough").to_numpy()
            inside, cut = np.zeros(batch.num_rows, dtype=np.int64), []
            for i in range(batch.num_rows):
                a, b, n = least[:, i, None], most[:, i, None], rows[bool(allowed[i])]
                whole = ((low >= a) & (high <= b)).all(axis=0)
                apart = ((high < a) | (low > b)).any(axis=0) | (n == 0)
                inside[i] = n[whole].sum()
                cut.append(number[~whole & ~apart] if inside[i] < enough[i] else number[:0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside), pa.array(cut, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "inside", "cut"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInArrow(run, f"{types}, inside bigint, cut array<int>")


def count_matches(configs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Fill ``Datasets_Found`` where null with the number of datasets each
    configuration finds, capped at its ``max_results``.

    Datasets are counted by the cells of a grid of quantiles, a table of at most 16,384 rows. A configuration adds up
    the cells inside its ranges; unless they reach its ``max_results`` already, the datasets of the cells that its
    ranges cut are checked one by one.
    """
    spark = configs.sparkSession
    rows = with_ratio(known(catalogue)).groupBy(*BOUNDS.values(), (F.col("NumberOfMissingValues") == 0).alias("whole")).agg(F.count(F.lit(1)).alias("n"))
    rows = pin(rows)
    found = rows.approxQuantile([*BOUNDS.values()], [i / 16 for i in range(1, 16)], 0.005)  # where the cuts lie does not change a count
    cuts = {name: sorted({e for e in ends[:: 16 // GRID[name]] if e == e}) for name, ends in zip(BOUNDS, found)}
    rows = rows.withColumn("cell", _cell(cuts))
    ends = [e for name, c in BOUNDS.items() for e in (F.min(c).alias(f"lo_{name}"), F.max(c).alias(f"hi_{name}"))]
    cells = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("n_whole"), *ends).collect()  # one row per cell
    sides = [f"{end}_{name}" for name in BOUNDS for end in ("min", "max")]
    # configurations of one id are counted together, so each counts up to the largest cap among them
    none = F.lit(2**62)
    todo = configs.filter(F.col("Datasets_Found").isNull()).na.drop(subset=["config_id", *sides])
    caps = configs.groupBy("config_id").agg(F.max(F.coalesce(F.col("max_results").cast("bigint"), none)).alias("enough"))
    todo = todo.join(caps, "config_id").select(
        "config_id", "enough", F.coalesce("allow_missing_values", F.lit(False)).alias("allowed"), *[F.col(c).cast("double").alias(c) for c in sides],
        *[F.col(c).alias(f"{c}_exact") for c in sides])
    todo = todo.repartition(parallelism(spark))
    asked = pin(_asked_cells(todo, cells))
    cut = asked.withColumn("cell", F.explode("cut"))
    hit = cut.join(rows, "cell").filter(F.col("allowed") | F.col("whole"))
    for name, column in BOUNDS.items():
        hit = hit.filter(F.col(column).between(F.col(f"min_{name}_exact"), F.col(f"max_{name}_exact")))
    parts = asked.select("config_id", F.col("inside").alias("n")).unionByName(hit.select("config_id", "n"))
    total = parts.groupBy("config_id").agg(F.sum("n").alias("found"))
    out = configs.join(total, "config_id", "left")
    capped = F.least(F.coalesce("found", F.lit(0)), F.col("max_results")).cast("bigint")
    return out.withColumn("Datasets_Found", F.coalesce("Datasets_Found", capped)).drop("found")


def log_search(log: DataFrame, config: dict, found: int) -> DataFrame:
    """The search log with one more row."""
    row = {**config, "Datasets_Found": found}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields if f.name in row)
    line = log.sparkSession.createDataFrame([tuple(row[f.name] for f in log.schema.fields if f.name in row)], schema)
    return log.unionByName(line, allowMissingColumns=True)
