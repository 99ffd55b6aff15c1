"""Resamplers by name: ``RESAMPLERS[name](points, seed)``."""

from lopside.operators.resample import hybrid, over, under  # noqa: F401
from lopside.operators.resample.common import RESAMPLERS

__all__ = ["RESAMPLERS", "resample"]


def resample(points, name: str, seed: int = 42):
    """Apply a resampler; an unknown name means none, as does "(no pre processing)"."""
    return RESAMPLERS.get(name, RESAMPLERS["(no pre processing)"])(points, seed)
