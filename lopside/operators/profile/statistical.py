"""General and statistical meta-features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.dataset import Dataset
from lopside.operators.prep import categorical_columns, distinct_counts, numeric_columns
from lopside.operators.profile.scatter import Scatter
from lopside.operators.profile.summary import summarise
from lopside.operators.quantiles import order_stats

MAD_SCALE = 1.4826  # makes the median deviation estimate a normal sd
TRIM = 0.2
FENCE = 1.5
CORRELATED = 0.5
NORMAL_P = 0.05


def general(ds: Dataset) -> dict[str, object]:
    """Counts of rows, columns and classes and their ratios."""
    n_by_class = [r["n"] for r in ds.df.groupBy(ds.target).agg(F.count(F.lit(1)).alias("n")).collect()]
    n, m = sum(n_by_class), len(ds.features)
    cat = [c for c in ds.features if c in categorical_columns(ds.df)]
    num = [c for c in ds.features if c in numeric_columns(ds.df)]
    levels = {r["feature"]: r["n"] for r in distinct_counts(ds.df, ds.features).collect()}
    return {
        "nr_inst": n, "nr_attr": m, "nr_class": len(n_by_class), "nr_bin": sum(1 for v in levels.values() if v == 2),
        "nr_cat": len(cat), "nr_num": len(num), "attr_to_inst": m / n, "inst_to_attr": n / m,
        "cat_to_num": len(cat) / len(num) if num else None, "num_to_cat": len(num) / len(cat) if cat else None,
        "freq_class": summarise([k / n for k in n_by_class]),
    }


def column_statistics(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float | None]]:
    """Every per-column statistic, by column: two scans and two order-statistic jobs."""
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    names = x.columns
    one = x.agg(*[e.alias(f"{k}_{c}") for c in names for k, e in {
        "n": F.count(c), "mean": F.avg(c), "min": F.min(c), "max": F.max(c), "var": F.var_samp(c),
        "skew": F.skewness(c), "kurt": F.kurtosis(c), "zero": F.count(F.when(F.col(c) == 0, 1)), "neg": F.count(F.when(F.col(c) < 0, 1)),
        "logs": F.avg(F.when(F.col(c) > 0, F.log(c))), "inverse": F.sum(F.when(F.col(c) != 0, 1 / F.col(c))),
    }.items()]).head()

    def ranks(n: int) -> list[int]:
        cut = int(TRIM * n)
        quart = [side(p * (n - 1)) for p in (0.25, 0.5, 0.75) for side in (math.floor, math.ceil)]
        return [*quart, cut, n - cut - 1]

    stats = order_stats(x, names, ranks)
    quart = {}
    for c in names:
        n, s = one[f"n_{c}"], stats[c]
        quart[c] = [s[2 * i] + (s[2 * i + 1] - s[2 * i]) * ((p * (n - 1)) % 1) for i, p in enumerate((0.25, 0.5, 0.75))]
    dev = x.select(*[F.abs(F.col(c) - quart[c][1]).alias(c) for c in names])
    mads = order_stats(dev, names, lambda n: [(n - 1) // 2, n // 2])
    exprs = []
    for c in names:
        lo, hi = stats[c][6], stats[c][7]
        spread = FENCE * (quart[c][2] - quart[c][0])
        inside = (F.col(c) > lo) & (F.col(c) < hi)
        exprs += [
            F.sum(F.when(inside, F.col(c))).alias(f"mid_{c}"), F.count(F.when(F.col(c) <= lo, 1)).alias(f"lo_{c}"),
            F.count(F.when(F.col(c) < hi, 1)).alias(f"hi_{c}"),
            F.count(F.when((F.col(c) < quart[c][0] - spread) | (F.col(c) > quart[c][2] + spread), 1)).alias(f"out_{c}"),
        ]
    two = x.agg(*exprs).head()
    levels = {r["feature"]: r["n"] for r in distinct_counts(x, names).collect()}
    out = {}
    for c, name in zip(names, columns):
        n, var = one[f"n_{c}"], one[f"var_{c}"]
        lo, hi, cut = stats[c][6], stats[c][7], int(TRIM * one[f"n_{c}"])
        kept = n - 2 * cut
        trimmed = lo if lo == hi else (
            (two[f"mid_{c}"] or 0.0) + lo * (two[f"lo_{c}"] - cut) + hi * (n - cut - two[f"hi_{c}"])) / kept
        f = (n - 1) / n
        varied = var is not None and var > 0
        negative, zero = one[f"neg_{c}"] > 0, one[f"zero_{c}"] > 0
        out[name] = {
            "mean": one[f"mean_{c}"], "median": quart[c][1], "min": one[f"min_{c}"], "max": one[f"max_{c}"],
            "range": one[f"max_{c}"] - one[f"min_{c}"], "var": var, "sd": math.sqrt(var) if var is not None else None,
            "iq_range": quart[c][2] - quart[c][0], "mad": MAD_SCALE * (mads[c][0] + mads[c][1]) / 2, "t_mean": trimmed,
            "kurtosis": (one[f"kurt_{c}"] + 3) * f**2 - 3 if varied else None, "skewness": one[f"skew_{c}"] * f**1.5 if varied else None,
            "g_mean": None if negative else 0.0 if zero else math.exp(one[f"logs_{c}"]),
            "h_mean": None if negative else 0.0 if zero else n / one[f"inverse_{c}"],
            "sparsity": (n / levels[c] - 1) / (n - 1) if n > 1 else None, "outliers": two[f"out_{c}"],
            "normal": _normal(n, one[f"skew_{c}"], one[f"kurt_{c}"]) if varied else False,
        }
    return out


def _normal(n: int, skew: float, excess: float) -> bool:
    """D'Agostino and Pearson's omnibus test from the population shape."""
    if n < 20:
        return False
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    a = y / math.sqrt(2 / (w2 - 1))
    z1 = math.asinh(a) / math.sqrt(0.5 * math.log(w2))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    g = (excess + 3 - mean) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    k = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    ratio = (1 - 2 / k) / (1 + g * math.sqrt(2 / (k - 4)))
    z2 = (1 - 2 / (9 * k) - math.copysign(abs(ratio) ** (1 / 3), ratio)) / math.sqrt(2 / (9 * k))
    return math.exp(-(z1 * z1 + z2 * z2) / 2) > NORMAL_P


def per_column(df: DataFrame, columns: list[str]) -> dict[str, object]:
    stats = column_statistics(df, columns)
    names = ["mean", "median", "min", "max", "range", "var", "sd", "iq_range", "mad", "t_mean", "kurtosis", "skewness",
             "g_mean", "h_mean", "sparsity"]
    out: dict[str, object] = {k: summarise([s[k] for s in stats.values()]) for k in names}
    out["nr_outliers"] = sum(1 for s in stats.values() if s["outliers"])
    out["nr_norm"] = sum(1 for s in stats.values() if s["normal"])
    return out


def multivariate(s: Scatter) -> dict[str, object]:
    """Features of the covariance structure; matrices are features x features."""
    cov, k, d, n = s.covariance, len(s.labels), s.mean.shape[1], s.n.sum()
    sd = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        cor = cov / np.outer(sd, sd)
    upper = np.triu_indices(d, 1)
    cors = np.abs(cor[upper])
    cors = cors[np.isfinite(cors)]
    order = sorted(range(k), key=lambda i: (-s.n[i], s.labels[i]))
    low = min(range(k), key=lambda i: (s.n[i], s.labels[i]))
    within, between = s.within.sum(0), s.between
    lam = np.sort(np.linalg.eigvals(np.linalg.pinv(within) @ between).real)[::-1]
    discs = min(k - 1, d)
    lam = np.maximum(lam[:discs], 0.0)
    rho = np.sqrt(lam / (1 + lam))
    return {
        "cor": summarise(cors), "cov": summarise(np.abs(cov[upper])), "eigenvalues": summarise(np.linalg.eigvalsh(cov)),
        "nr_cor_attr": float((cors >= CORRELATED).mean()) if len(cors) else 0.0,
        "gravity": float(np.linalg.norm(s.mean[order[0]] - s.mean[low])),
        "can_cor": summarise(rho), "w_lambda": float(np.prod(1 / (1 + lam))), "p_trace": float((rho**2).sum()),
        "lh_trace": float(lam.sum()), "roy_root": float(lam.max(initial=0.0)), "nr_disc": discs, "sd_ratio": _box(s),
    }


def _box(s: Scatter) -> float | None:
    """Homogeneity of the class covariances from Box's M; None when one is singular."""
    k, d = len(s.labels), s.mean.shape[1]
    dof = s.n - 1
    if k < 2 or (dof < 1).any():
        return None
    pooled = s.within.sum(0) / dof.sum()
    signs, logs = zip(*[np.linalg.slogdet(s.within[i] / dof[i]) for i in range(k)])
    sign, log = np.linalg.slogdet(pooled)
    if sign <= 0 or min(signs) <= 0:
        return None
    gamma = 1 - (2 * d * d + 3 * d - 1) / (6 * (d + 1) * (k - 1)) * ((1 / dof).sum() - 1 / dof.sum())
    m = gamma * (dof.sum() * log - (dof * np.array(logs)).sum())
    return float(np.exp(m / (d * dof.sum())))
