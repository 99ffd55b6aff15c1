"""Every query of the suite, gathered from its modules."""

from lopside.suite import catalogue_queries, learn_queries, prep_queries, profile_queries, resample_queries, score_queries  # noqa: F401
from lopside.suite.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark, sf):
    return QUERIES["balanced_class_counts"](spark, sf)
