"""Classifiers by name: ``CLASSIFIERS[name](train, classes, seed, effort)`` gives a predictor."""

from lopside.operators.classify import ensembles, single  # noqa: F401
from lopside.operators.classify.common import CLASSIFIERS, Effort

__all__ = ["CLASSIFIERS", "Effort"]
