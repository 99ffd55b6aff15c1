"""Files in, knowledge base and recommendation out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lopside.operators.classify import CLASSIFIERS, Effort
from lopside.plans import evaluate as ev
from lopside.plans.learn import learn_folder, suggest
from lopside.plans.recommend import TITLE
from lopside.sources import tables
from lopside.sources.kb import RESULT_COLUMNS, KnowledgeBase

LIGHT = Effort(trees=3, rounds=3, members=2, depth=4, iterations=10)
QUICK = dict(resamplers=["RandomOverSampler", "RandomUnderSampler"], classifiers=["GaussianNB"], folds=2, repeats=1, effort=LIGHT,
             groups=["general"])


def write(folder, name, n, shift):
    rng = np.random.default_rng(n)
    lines = ["size, color of it, 2nd, class"]
    for i in range(n):
        bad = i % 4 == 0
        lines.append(f"{rng.normal(shift if bad else 0):.4f}, {'red' if rng.random() < 0.5 else 'blue'}, {rng.integers(0, 9)}, {'bad' if bad else 'good'}")
    lines.append("NA, red, 3, good")
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    for name, n, shift in (("one.csv", 60, 3.0), ("two.csv", 80, 2.0)):
        write(where, name, n, shift)
    return where


def test_reading(spark, folder):
    ds = tables.load(spark, tables.resolve(spark, folder, "one"))
    assert ds.name == "one.csv" and ds.target == "class" and ds.features == ["size", "color of it", "2nd"]
    assert dict(ds.df.dtypes)["size"] == "double" and dict(ds.df.dtypes)["2nd"] == "bigint"
    assert ds.df.count() == 60
    assert ev.encoded(ds).features == ["size", "f_2nd", "color_of_it_red"]
    assert tables.list_csv(spark, folder) == ["one.csv", "two.csv"]
    with pytest.raises(FileNotFoundError):
        tables.resolve(spark, folder, "nine")


def test_learning_then_recommending(spark, folder, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path / "kb"))
    first = {r["dataset"]: r["status"] for r in learn_folder(spark, folder, base, **QUICK).collect()}
    assert first == {"one.csv": "success", "two.csv": "success"}
    stored = base.load("kb_results", "binary", RESULT_COLUMNS)
    assert stored.count() == 2 and base.load("kb_full_results", "binary").count() == 4
    combos = base.load("kb_characteristics", "binary").select("pre processing").collect()
    assert len(combos) == 2 and all(r[0] != "?" for r in combos)
    assert base.load("kb_results", "multiclass", RESULT_COLUMNS).isEmpty()
    again = {r["status"] for r in learn_folder(spark, folder, base, **QUICK).collect()}
    assert again == {"skipped"}
    write(folder, "fresh.csv", 50, 1.5)
    text = suggest(tables.load(spark, f"{folder}/fresh.csv"), base, groups=QUICK["groups"])
    assert text.startswith(TITLE) and "GaussianNB" in text
    assert base.load("kb_characteristics", "binary").filter("dataset = 'fresh.csv'").head()["algorithm"] == "?"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "abc"[i % 3], [float(v) for v in rng.normal(3.0 * (i % 3), 0.7, 2)]) for i in range(150)]
    return spark.createDataFrame(rows, "id bigint, label string, x array<double>").cache()


@pytest.mark.parametrize("name", sorted(CLASSIFIERS))
def test_classifiers_tell_clear_classes_apart(blobs, name):
    two = blobs.filter(F.col("label") != "b")
    out = CLASSIFIERS[name](two, ["a", "c"], 42, LIGHT)(two)
    r = out.agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("a"), F.count("*").alias("n")).head()
    assert r["a"] > 0.95 and r["n"] == 100
    assert out.filter(F.abs(F.col("scores")["a"] + F.col("scores")["c"] - 1) > 1e-6).isEmpty()


@pytest.mark.parametrize("name", ["AdaBoostClassifier", "SVC", "BalancedBaggingClassifier", "KNeighborsClassifier"])
def test_three_classes(blobs, name):
    out = CLASSIFIERS[name](blobs, ["a", "b", "c"], 42, Effort(trees=5, rounds=12, members=3, depth=4, iterations=20))(blobs)
    assert out.agg(F.avg((F.col("y") == F.col("yhat")).cast("int"))).head()[0] > 0.6


def test_out_of_fold(blobs):
    out = ev.evaluate(blobs, ["SMOTE", "KMeansSMOTE"], ["GaussianNB"], folds=3, repeats=2, effort=LIGHT)
    status = {r["pre processing"]: r["status"] for r in out.runs.collect()}
    assert status["SMOTE"] == "success"
    mine = out.predictions.filter(F.col("pre processing") == "SMOTE")
    assert mine.count() == 300 and mine.filter("id < 0").isEmpty()
    assert mine.groupBy("repeat", "id").count().filter("count > 1").isEmpty()
    scores = ev.fold_scores(out).filter(F.col("pre processing") == "SMOTE")
    assert scores.count() == 6 and scores.agg(F.min("recall_macro")).head()[0] > 0.9


def test_row_ids_follow_the_file_whatever_the_splits(spark, tmp_path):
    from lopside.sources.tables import load

    rows = [(k * 7 % 1000, ["x", "y", "NA"][k % 3], "p" if k % 2 else "q") for k in range(1000)]
    path = tmp_path / "rows.csv"
    path.write_text("a,b,c\n" + "\n".join(",".join(map(str, r)) for r in rows) + "\n")
    want = [(i, *r) for i, r in enumerate(r for r in rows if r[1] != "NA")]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100m", "700", "1500"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            ds = load(spark, str(path))
            assert [tuple(r) for r in ds.df.select("row_id", "a", "b", "c").orderBy("row_id").collect()] == want
            assert ds.features == ["a", "b"] and ds.target == "c"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_values_and_large_counts(spark):
    from pyspark.sql import functions as F

    from lopside.functions import metrics
    from lopside.operators import prep
    from lopside.operators.quantiles import quantiles

    nan = float("nan")
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 4.0, 5.0, nan, nan, nan, nan, None)], "v double")
    assert quantiles(df, ["v"], [0.5])["v"] == quantiles(df, ["v"], [0.5], direct_rows=2)["v"] == [3.0]
    assert sorted(r.v for r in prep.impute(df).collect()) == [1.0, 2.0] + [3.0] * 6 + [4.0, 5.0]
    big = spark.createDataFrame([("a", 5 * 10**9, 5 * 10**9, 4 * 10**9), ("b", 3 * 10**9, 3 * 10**9, 2 * 10**9)], "label string, support long, predicted long, hits long")
    rates = big.withColumn("precision", F.col("hits") / F.col("predicted")).withColumn("recall", F.col("hits") / F.col("support")).withColumn("f1", F.col("recall"))
    original, metrics.class_scores = metrics.class_scores, lambda c, by: rates
    try:
        row = metrics.label_scores(spark.createDataFrame([("a", "a")], "y string, yhat string"), []).head()
    finally:
        metrics.class_scores = original
    assert abs(row.accuracy - 0.75) < 1e-12 and abs(row.cohen_kappa - (0.75 - 34 / 64) / (1 - 34 / 64)) < 1e-9


def test_a_centre_for_every_row_wanted(spark):
    from lopside.operators.resample.common import RESAMPLERS

    rows = [(k, "low", [float(k), 0.0]) for k in range(5)] + [(10 + k, "high", [1.0, float(k // 40)]) for k in range(80)]
    points = spark.createDataFrame(rows, "id long, label string, x array<double>")
    got = RESAMPLERS["ClusterCentroids"](points).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"low": 5, "high": 5}


def test_folds_of_a_failed_combination_are_not_started(spark, monkeypatch):
    rows = [(i, "ab"[i % 3 == 0], [float(i % 7), float(i % 5)]) for i in range(60)]
    points = spark.createDataFrame(rows, "id bigint, label string, x array<double>")
    tried, resample = [], ev.resample

    def failing(train, name, seed):
        tried.append(name)
        if name == "SMOTE":
            raise ValueError("no")
        return resample(train, name, seed)

    monkeypatch.setattr(ev, "resample", failing)
    out = ev.evaluate(points, ["SMOTE", ev.NO_RESAMPLING], ["GaussianNB"], folds=4, repeats=1, parallelism=1)
    assert {r["pre processing"]: r["status"] for r in out.runs.collect()} == {"SMOTE": "failed", ev.NO_RESAMPLING: "success"}
    assert tried.count("SMOTE") == 1 and tried.count(ev.NO_RESAMPLING) == 4
