"""Properties every resampler has to keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lopside.operators import clusters
from lopside.operators.resample import RESAMPLERS
from lopside.operators.resample.common import class_sizes, multiply
from lopside.operators.resample import under
from lopside.operators.resample.under import tomek_links

UNDER = ["RandomUnderSampler", "EditedNearestNeighbours", "RepeatedEditedNearestNeighbours", "AllKNN", "NeighbourhoodCleaningRule",
         "TomekLinks", "CondensedNearestNeighbour", "OneSidedSelection", "NearMiss", "InstanceHardnessThreshold"]
OVER = ["RandomOverSampler", "SMOTE", "SVMSMOTE"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        c = "a" if i < 180 else "b" if i < 220 else "c"
        centre = {"a": 0.0, "b": 1.5, "c": -1.5}[c]
        rows.append((i, c, [float(v) for v in rng.normal(centre, 1.0, 3)]))
    return spark.createDataFrame(rows, "id bigint, label string, x array<double>").cache()


@pytest.mark.parametrize("name", UNDER)
def test_under_samplers_keep_a_subset(points, name):
    out = RESAMPLERS[name](points)
    assert out.select("id", "label", "x").exceptAll(points).isEmpty()
    assert class_sizes(out)["c"] == 20
    if name in ("RandomUnderSampler", "NearMiss", "InstanceHardnessThreshold"):
        assert class_sizes(out) == {"a": 20, "b": 20, "c": 20}


@pytest.mark.parametrize("name", OVER)
def test_over_samplers_reach_the_largest_class(points, name):
    out = RESAMPLERS[name](points)
    assert class_sizes(out) == {"a": 180, "b": 180, "c": 180}
    assert out.select("id").distinct().count() == 540
    assert points.exceptAll(out.filter(~F.col("is_synthetic")).select("id", "label", "x")).isEmpty()


def test_new_rows_lie_between_seed_and_neighbour(points):
    old = {r["id"]: (r["label"], np.array(r["x"])) for r in points.collect()}
    for name in ("SMOTE", "ADASYN", "BorderlineSMOTE"):
        for r in RESAMPLERS[name](points).filter("is_synthetic").collect():
            (la, a), (lb, b) = old[r["src_id"]], old[r["nbr_id"]]
            assert la == lb == r["label"]
            step = np.dot(np.array(r["x"]) - a, b - a) / max(np.dot(b - a, b - a), 1e-300)
            assert -1e-9 <= step <= 1 + 1e-9 and np.allclose(a + step * (b - a), r["x"])


def test_same_seed_same_rows_whatever_the_partitioning(points):
    one = RESAMPLERS["SMOTE"](points.coalesce(1)).select("id", "label", "x")
    many = RESAMPLERS["SMOTE"](points.repartition(8)).select("id", "label", "x")
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
    other = RESAMPLERS["SMOTE"](points, 7).select("id", "label", "x")
    assert not other.exceptAll(one).isEmpty()


def test_editing_is_stable_at_its_fixpoint(points):
    # with two well-sized classes the rule stops because nothing changes any more
    two = points.filter(F.col("label") != "b")
    done = RESAMPLERS["RepeatedEditedNearestNeighbours"](two).select("id", "label", "x")
    again = RESAMPLERS["EditedNearestNeighbours"](done)
    assert again.count() == done.count()


def test_tomek_leaves_no_link_it_removes(points):
    grown = RESAMPLERS["SMOTE"](points).select("id", "label", "x")
    links = {r["id"] for r in tomek_links(grown).collect()}
    left = {r["id"] for r in RESAMPLERS["SMOTETomek"](points).select("id").collect()}
    assert not links & left


def test_single_row_class_is_refused(spark):
    df = spark.createDataFrame([(i, "a", [float(i)]) for i in range(5)] + [(9, "b", [0.5])], "id bigint, label string, x array<double>")
    with pytest.raises(ValueError):
        RESAMPLERS["SMOTE"](df)
    assert class_sizes(RESAMPLERS["RandomOverSampler"](df)) == {"a": 5, "b": 5}


def test_copies_of_one_row_are_spread(spark):
    df = spark.createDataFrame([(1, 250_001), (2, 0), (3, 1)], "id bigint, n bigint")
    out = multiply(df, "n", "j", 250_002)
    assert out.rdd.getNumPartitions() > 1
    assert out.groupBy("id").agg(F.count("*").alias("n"), F.max("j").alias("m")).orderBy("id").collect() == [(1, 250_001, 250_000), (3, 1, 0)]


def test_hardness_forests_grow_in_several_tasks(points, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    parts, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df: parts.append(df.rdd.getNumPartitions()) or fit(self, df))
    monkeypatch.setattr(under, "ONE_TASK", 100)
    RESAMPLERS["InstanceHardnessThreshold"](points, trees=3, depth=4)
    assert len(parts) == 5 and min(parts) > 1


def test_clusters_are_lloyds_and_start_without_candidates(spark, monkeypatch):
    """Every row ends at its nearest mean, as good as the best of plain Lloyd runs; the driver is sent centres, not several times as many."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, (60, 4)) for c in rng.random((12, 4)) * 20])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>").repartition(4)
    sent, placed = [], clusters._placed
    monkeypatch.setattr(clusters, "_placed", lambda s, c, m: sent.append(len(c)) or placed(s, c, m))
    monkeypatch.setattr(clusters, "CENTRE_TILE", 16)
    got = np.array([r["prediction"] for r in sorted(clusters.kmeans(df, 60).collect(), key=lambda r: r["id"])])
    assert max(sent) == 60 and len(sent) > clusters.START_ROUNDS
    means = np.array([x[got == c].mean(0) if (got == c).any() else np.full(4, np.inf) for c in range(60)])
    far = ((x[:, None] - means[None]) ** 2).sum(2)
    assert far[np.arange(len(x)), got] == pytest.approx(far.min(1), abs=1e-9)
    cost = far.min(1).sum()

    def lloyd(seed):
        c = x[np.random.default_rng(seed).choice(len(x), 60, replace=False)]
        for _ in range(50):
            at = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(60)])
        return ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum()

    assert cost <= 1.05 * min(lloyd(s) for s in range(5))
    assert len(set(r["prediction"] for r in clusters.kmeans(df.filter("id < 3").unionAll(df.filter("id < 3")), 5).collect())) == 3


def test_centroids_call_no_local_reduction(points, monkeypatch):
    from pyspark.ml.clustering import KMeans

    def never(*a):
        raise AssertionError("k-means|| of Spark reduces four times as many candidates as centres on the driver")

    monkeypatch.setattr(KMeans, "fit", never)
    sizes = class_sizes(RESAMPLERS["ClusterCentroids"](points))
    assert set(sizes.values()) == {min(class_sizes(points).values())}


def test_repeated_editing_asks_again_only_where_a_neighbour_went(points, monkeypatch):
    want, sizes = points, class_sizes(points)
    while True:
        want = under.pin(under.edited(want, ["a", "b"]))
        after = class_sizes(want)
        if after == sizes or under._overshot(after, "c", ["a", "b"]):
            break
        sizes = after
    asked, search = [], under.nearest
    monkeypatch.setattr(under, "nearest", lambda q, d, k: asked.append(q.count()) or search(q, d, k))
    got = RESAMPLERS["RepeatedEditedNearestNeighbours"](points)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())
    assert len(asked) > 1 and asked[1] < asked[0] / 2


def test_smote_beyond_a_few_megabytes_is_not_broadcast(spark):
    """11,000 seeds of five neighbours, 8 MB: rows meet by sorting, the driver sees none of them."""
    n = F.col("id")
    df = spark.range(25_000).select("id", F.when(n < 11_000, "few").otherwise("many").alias("label"), F.array(*[((n * p) % 9973).cast("double") for p in (7, 31, 57, 101, 211, 509)]).alias("x"))
    out = RESAMPLERS["SMOTE"](df)
    made = out._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("strategy=merge") >= 4  # neighbours, their rows, ranks, draws
    assert {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} == {"few": 14_000, "many": 14_000}
