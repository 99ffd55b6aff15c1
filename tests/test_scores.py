"""Metrics, tests, encodings and knowledge-base rules on hand cases."""

import math

import pytest
from pyspark.sql import functions as F

from lopside.functions import metrics, stats
from lopside.functions.scalars import clean_suffix, format_hms, parse_hms
from lopside.operators import prep
from lopside.sources import kb


def preds(spark, rows):
    return spark.createDataFrame([(0, y, p, s) for y, p, s in rows], "run int, y string, yhat string, score double")


def test_two_by_two(spark):
    df = preds(spark, [("1", "1", 0.9)] * 3 + [("1", "0", 0.4)] + [("0", "0", 0.1)] * 5 + [("0", "1", 0.6)])
    r = metrics.label_scores(df, ["run"], "1").head()
    assert r["f1"] == pytest.approx(0.75) and r["accuracy"] == pytest.approx(0.8)
    assert r["balanced_accuracy"] == pytest.approx((3 / 4 + 5 / 6) / 2) == pytest.approx(r["recall_macro"])
    assert r["g_mean"] == pytest.approx(math.sqrt(3 / 4 * 5 / 6))
    assert r["matthews_corrcoef"] == pytest.approx((3 * 5 - 1 * 1) / 24)
    assert r["cohen_kappa"] == pytest.approx((0.8 - 0.52) / 0.48)
    assert metrics.roc_auc(df, ["run"], "1").head()["roc_auc"] == pytest.approx((3 * 6 + 5) / 24)


def test_perfect_and_absent_classes(spark):
    good = preds(spark, [(c, c, 0.0) for c in "aabbc"])
    r = metrics.label_scores(good, ["run"]).head()
    assert r["cohen_kappa"] == r["matthews_corrcoef"] == r["f1"] == pytest.approx(1.0)
    odd = preds(spark, [("a", "a", 0.0), ("b", "c", 0.0)])
    r = metrics.label_scores(odd, ["run"]).head()
    assert r["precision_macro"] == pytest.approx(1 / 3) and r["g_mean"] == 0.0 and r["balanced_accuracy"] == pytest.approx(0.5)
    assert metrics.roc_auc(preds(spark, [("1", "1", 0.2)]), ["run"], "1").head()["roc_auc"] is None


def pairs(spark, diffs, name="d"):
    return spark.createDataFrame([(name, i, d, 0.0) for i, d in enumerate(diffs)], "dataset string, fold int, a double, b double")


def test_wilcoxon(spark):
    df = pairs(spark, [0.01, 0.02, 0.03, 0.04] + [0.0] * 26, "four").unionByName(pairs(spark, [0.0] * 30, "equal"))
    got = {r["dataset"]: r for r in stats.wilcoxon(df, ["dataset"]).collect()}
    assert got["four"]["statistic"] == 0 and got["four"]["pvalue"] == pytest.approx(0.06788915486182899, rel=1e-9)
    assert got["equal"]["statistic"] is None and got["equal"]["result"] == "Same distribution"
    assert got["four"]["result"] == "Same distribution (fail to reject H0)"


def test_tails(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 4.0, 5.9, 7.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(stats.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=1e-4, abs=1e-15)
    df = spark.createDataFrame([(3.84, 1), (5.99, 2), (7.81, 3), (9.49, 4)], "x double, k int")
    assert [r[0] for r in df.select(stats.chi2_tail(F.col("x"), F.col("k"))).collect()] == pytest.approx([0.05] * 4, abs=5e-4)


def test_elapsed_and_names(spark):
    df = spark.createDataFrame([(0.4, "a/b.csv"), (3725.0, "b"), (90061.0, "x.y/c.dat"), (200000.0, "d.e.csv")], "s double, p string")
    rows = df.select(format_hms(F.col("s")), parse_hms(format_hms(F.col("s"))), clean_suffix(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["0:00:00", "1:02:05", "1 day, 1:01:01", "2 days, 7:33:20"]
    assert [r[1] for r in rows] == [0.0, 3725.0, 90061.0, 200000.0]
    assert [r[2] for r in rows] == ["a/b_clean.csv", "b_clean", "x.y/c_clean.dat", "d.e_clean.csv"]


def test_safe_names(spark):
    assert prep.sanitize_names(spark, ["a b", "a-b", "--", "1x", "a_b_2", "ok"]) == ["a_b", "a_b_2", "feature", "f_1x", "a_b_2_2", "ok"]


def test_imputation_ties_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, "b", None), (3.0, "a", None), (None, None, None)], "v double, t string, e string")
    got = [tuple(r) for r in prep.impute(df).orderBy("v").collect()]
    assert got == [(1.0, "b"), (2.0, "a"), (3.0, "a")]


def row(name, score):
    return (name, "SMOTE", "SVC", 1.0, *[score, 0.0] * 5)


def test_upsert_rules(spark):
    schema = ", ".join(f"`{c}` {'string' if i < 3 else 'double'}" for i, c in enumerate(kb.KEYS + kb._with_std(kb.BINARY_METRICS)))
    stored = spark.createDataFrame([row("a", 0.5), row("b", 0.5)], schema)
    new = spark.createDataFrame([row("a", 0.5004), row("b", 0.501), row("c", 0.1)], schema)
    once = kb.upsert_results(stored, new, "binary")
    assert {r["dataset"]: r["action"] for r in once.collect()} == {"a": "keep", "b": "update", "c": "insert"}
    again = kb.upsert_results(once.drop("action"), new, "binary")
    assert {r["action"] for r in again.collect()} == {"keep"}
    assert again.drop("action").exceptAll(once.drop("action")).isEmpty()
