"""SMOTE followed by a cleaning rule on all classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED
from lopside.operators.resample.common import class_sizes, resampler
from lopside.operators.resample.over import smote
from lopside.operators.resample.under import edited, tomek_links
from lopside.session import pin


@resampler("SMOTEENN")
def smote_enn(points: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    grown = pin(smote(points, seed))
    kept = edited(grown.select("id", "label", "x"), sorted(class_sizes(grown)), k)
    return grown.join(kept.select("id"), "id", "left_semi").select(grown.columns)


@resampler("SMOTETomek")
def smote_tomek(points: DataFrame, seed: int = SEED) -> DataFrame:
    grown = pin(smote(points, seed))
    gone = tomek_links(grown.select("id", "label", "x")).select("id")
    return grown.join(gone, "id", "left_anti").select(grown.columns)
