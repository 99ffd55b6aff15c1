"""Summaries of a list of values: mean, sd, skewness, kurtosis."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARIES = ["mean", "sd", "kurtosis", "skewness"]
FLAT = 1e-24  # a spread this small against the mean is rounding noise


def from_moments(n: float, mean: float, m2: float, m3: float, m4: float) -> dict[str, float | None]:
    """Summaries from the count, the mean and the central moments (divided by n).

    sd has n - 1 degrees of freedom; skewness and kurtosis carry the factors
    ((n - 1) / n) ** 1.5 and ((n - 1) / n) ** 2. All but the mean are undefined for
    one value, the shape also for equal values.
    """
    if not n:
        return dict.fromkeys(SUMMARIES)
    sd = math.sqrt(m2 * n / (n - 1)) if n > 1 else None
    shaped = n > 1 and m2 > FLAT * max(1.0, mean * mean)
    f = (n - 1) / n
    return {
        "mean": mean,
        "sd": sd,
        "kurtosis": m4 / m2**2 * f**2 - 3 if shaped else None,
        "skewness": m3 / m2**1.5 * f**1.5 if shaped else None,
    }


def summarise(values) -> dict[str, float | None]:
    """Summaries of a short list (per column, per class, per pair), nulls left out."""
    v = [float(x) for x in values if x is not None and math.isfinite(x)]
    if not v:
        return dict.fromkeys(SUMMARIES)
    n, mean = len(v), math.fsum(v) / len(v)
    m2, m3, m4 = (math.fsum((x - mean) ** p for x in v) / n for p in (2, 3, 4))
    return from_moments(n, mean, m2, m3, m4)


def summarise_rows(df: DataFrame, columns: list[str], weight: str | None = None) -> dict[str, dict[str, float | None]]:
    """Summaries of per-row values, in two passes: means, then central moments."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    first = df.agg(*[e for c in columns for e in (
        F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"n_{c}"), F.sum(F.col(c) * w).alias(f"s_{c}"))]).head()
    mean = {c: first[f"s_{c}"] / first[f"n_{c}"] if first[f"n_{c}"] else 0.0 for c in columns}
    powers = df.agg(*[
        F.sum(F.pow(F.col(c) - mean[c], F.lit(p)) * w).alias(f"m{p}_{c}") for c in columns for p in (2, 3, 4)
    ]).head()
    out = {}
    for c in columns:
        n = first[f"n_{c}"]
        if not n:
            out[c] = dict.fromkeys(SUMMARIES)
            continue
        out[c] = from_moments(n, mean[c], *[powers[f"m{p}_{c}"] / n for p in (2, 3, 4)])
    return out


def flatten(features: dict[str, object]) -> dict[str, float | None]:
    """``name`` for scalars and ``name.summary`` for summarised features."""
    out: dict[str, float | None] = {}
    for name, value in features.items():
        if isinstance(value, dict):
            out.update({f"{name}.{s}": value[s] for s in SUMMARIES})
        else:
            out[name] = None if value is None else float(value)
    return out


def as_frame(spark, features: dict[str, object]) -> DataFrame:
    """(feature, value), one row per number (a few hundred at most)."""
    return spark.createDataFrame(list(flatten(features).items()), "feature string, value double")
