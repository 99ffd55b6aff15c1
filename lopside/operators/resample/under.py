"""Under-samplers and cleaning rules; the minority class is never reduced."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lopside.functions.draws import SEED
from lopside.functions.scalars import euclidean
from lopside.operators.clusters import kmeans
from lopside.operators.folds import stratified_folds
from lopside.operators.neighbours import nearest
from lopside.operators.ranks import hash_take, smallest
from lopside.operators.resample.common import by_label, class_sizes, minority, originals, others, resampler
from lopside.session import parallelism, pin

#: Rows from which a forest is grown over several tasks: few bytes a row, a window's output would be one or two files.
ONE_TASK = 2000


@resampler("(no pre processing)")
def identity(points: DataFrame, seed: int = SEED) -> DataFrame:
    return originals(points)


def _quota(spark, take: dict[str, int]) -> DataFrame:
    """(label, take), one row per class."""
    return spark.createDataFrame(list(take.items()), "label string, take bigint")


@resampler("RandomUnderSampler")
def random_under(points: DataFrame, seed: int = SEED, key: str = "") -> DataFrame:
    """As many rows of every class as the smallest has."""
    sizes = class_sizes(points)
    quota = _quota(points.sparkSession, {c: min(sizes.values()) for c in sizes})
    return originals(hash_take(points, ["label"], "id", F.broadcast(quota), seed, key, rows=sum(sizes.values())))


# ---- nearest-neighbour editing ----------------------------------------------------

def edited(points: DataFrame, classes: list[str], k: int = 3) -> DataFrame:
    """Drop rows of ``classes`` unless all k nearest rows share their class."""
    near = nearest(points.filter(F.col("label").isin(classes)), points, k)
    odd = near.filter(F.col("nlabel") != F.col("label")).select("id").distinct()
    return points.join(odd, "id", "left_anti").select("id", "label", "x")


@resampler("EditedNearestNeighbours")
def enn(points: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    return originals(edited(points, others(class_sizes(points)), k))


def _overshot(now: dict[str, int], low: str, classes: list[str]) -> bool:
    """A class vanished or fell below the minority."""
    return any(now.get(c, 0) < now.get(low, 0) for c in classes)


@resampler("RepeatedEditedNearestNeighbours")
def repeated_enn(points: DataFrame, seed: int = SEED, k: int = 3, rounds: int = 100) -> DataFrame:
    """Edit until nothing changes, a class falls below the minority, or ``rounds`` is reached.

    A row stays while its k nearest rows share its class, and dropping other rows does not change them. So after the
    first round only rows that lost one of their neighbours are searched for again.
    """
    sizes = class_sizes(points)
    classes, low = others(sizes), minority(sizes)
    now = pin(points.select("id", "label", "x"))
    asked = now.filter(F.col("label").isin(classes))
    held = None  # (id, nid): the neighbours of the rows that stayed
    for _ in range(rounds):
        near = pin(nearest(asked, now, k).select("id", "nid", (F.col("nlabel") != F.col("label")).alias("odd")))
        odd = pin(near.filter("odd").select("id").distinct())
        now = pin(now.join(odd, "id", "left_anti").select("id", "label", "x"))
        after = class_sizes(now)
        if after == sizes or _overshot(after, low, classes):
            break
        sizes = after
        found = near.select("id", "nid")
        held = found if held is None else held.join(asked.select("id"), "id", "left_anti").unionByName(found)
        held = pin(held.join(odd, "id", "left_anti").select("id", "nid"))
        lost = held.join(odd.select(F.col("id").alias("nid")), "nid", "left_semi").select("id").distinct()
        asked = pin(now.filter(F.col("label").isin(classes)).join(lost, "id", "left_semi").select("id", "label", "x"))
    return originals(now)


@resampler("AllKNN")
def all_knn(points: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    """Edit with 1, 2, ... k neighbours in turn, stopping as the repeated rule does."""
    sizes = class_sizes(points)
    classes, low = others(sizes), minority(sizes)
    now = points
    for n in range(1, k + 1):
        now = pin(edited(now, classes, n))
        if _overshot(class_sizes(now), low, classes):
            break
    return originals(now)


@resampler("NeighbourhoodCleaningRule")
def neighbourhood_cleaning(points: DataFrame, seed: int = SEED, k: int = 3, threshold: float = 0.5) -> DataFrame:
    """Editing, and the foreign neighbours of minority rows that editing would drop."""
    sizes = class_sizes(points)
    low = minority(sizes)
    near = pin(nearest(points, points, k))
    odd = near.filter(F.col("nlabel") != F.col("label"))
    edited_away = odd.filter(F.col("label") != low).select("id")
    large = [c for c in others(sizes) if sizes[c] > threshold * sizes[low]]
    crowding = odd.filter((F.col("label") == low) & F.col("nlabel").isin(large)).select(F.col("nid").alias("id"))
    gone = edited_away.unionByName(crowding).distinct()
    return originals(points.join(gone, "id", "left_anti"))


# ---- Tomek links -------------------------------------------------------------------

def tomek_links(points: DataFrame) -> DataFrame:
    """(id, label, nid, nlabel): rows that are each other's nearest and differ in class."""
    near = nearest(points, points, 1).filter(F.col("label") != F.col("nlabel"))
    near = pin(near.select("id", "label", "nid", "nlabel"))
    back = near.select(F.col("nid").alias("id"), F.col("id").alias("nid"))
    return near.join(back, ["id", "nid"], "left_semi")


def without_tomek(points: DataFrame, classes: list[str]) -> DataFrame:
    gone = tomek_links(points).filter(F.col("label").isin(classes)).select("id")
    return points.join(gone, "id", "left_anti")


@resampler("TomekLinks")
def tomek(points: DataFrame, seed: int = SEED) -> DataFrame:
    return originals(without_tomek(points, others(class_sizes(points))))


# ---- condensation -------------------------------------------------------------------

def first_store(points: DataFrame, low: str, c: str, seed: int = SEED) -> DataFrame:
    """The minority and the row of class ``c`` with the smallest draw."""
    one = _quota(points.sparkSession, {c: 1})
    first = hash_take(points.filter(F.col("label") == c), ["label"], "id", F.broadcast(one), seed)
    return points.filter(F.col("label") == low).unionByName(first)


def misjudged(rest: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose nearest stored row is of another class."""
    near = nearest(rest, store, 1).filter(F.col("nlabel") != F.col("label")).select("id")
    return rest.join(near, "id", "left_semi").select("id", "label", "x")


@resampler("CondensedNearestNeighbour")
def condensed(points: DataFrame, seed: int = SEED) -> DataFrame:
    """Grow a store until its nearest-neighbour rule is right on every row left.

    Each round adds all misjudged rows at once, so the result does not depend on
    the order of the rows.
    """
    points = pin(points)
    sizes = class_sizes(points)
    low = minority(sizes)
    kept = points.filter(F.col("label") == low)
    for c in others(sizes):
        store = pin(first_store(points, low, c, seed))
        rest = pin(points.filter(F.col("label") == c).join(store, "id", "left_anti").select("id", "label", "x"))
        while True:
            wrong = pin(misjudged(rest, store))
            if wrong.isEmpty():
                break
            store = pin(store.unionByName(wrong))
            rest = pin(rest.join(wrong, "id", "left_anti").select("id", "label", "x"))
        kept = kept.unionByName(store.filter(F.col("label") == c))
    return originals(kept)


@resampler("OneSidedSelection")
def one_sided(points: DataFrame, seed: int = SEED) -> DataFrame:
    """One round of condensation per class, then Tomek links removed."""
    points = pin(points)
    sizes = class_sizes(points)
    low = minority(sizes)
    kept = points.filter(F.col("label") == low)
    for c in others(sizes):
        store = pin(first_store(points, low, c, seed))
        rest = points.filter(F.col("label") == c).join(store, "id", "left_anti").select("id", "label", "x")
        kept = kept.unionByName(store.filter(F.col("label") == c)).unionByName(misjudged(rest, store))
    return originals(without_tomek(pin(kept), others(sizes)))


# ---- quotas by distance, hardness and centroids ---------------------------------------

@resampler("NearMiss")
def near_miss(points: DataFrame, seed: int = SEED, k: int = 3) -> DataFrame:
    """The rows of smallest mean distance to their k nearest minority rows."""
    sizes = class_sizes(points)
    low = minority(sizes)
    few = points.filter(F.col("label") == low)
    rest = points.filter(F.col("label") != low)
    far = nearest(rest, few, k).groupBy("id", "label").agg(F.round(F.avg("dist"), 9).alias("dist"))
    quota = _quota(points.sparkSession, {c: sizes[low] for c in others(sizes)})
    kept = smallest(pin(far), ["label"], "dist", "id", quota, sum(sizes.values()))
    return originals(few.unionByName(rest.join(kept.select("id"), "id", "left_semi").select("id", "label", "x")))


@resampler("InstanceHardnessThreshold")
def instance_hardness(points: DataFrame, seed: int = SEED, folds: int = 5, trees: int = 100, depth: int = 30) -> DataFrame:
    """The easiest rows of each class: highest out-of-fold probability of their own class.

    The forests of the folds are grown side by side: each is a long series of short jobs.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sizes = class_sizes(points)
    codes = {c: float(i) for i, c in enumerate(sorted(sizes))}
    ready = points.withColumn("features", array_to_vector("x")).withColumn("y", by_label(codes))
    ready = stratified_folds(ready, "label", "id", folds, 1, seed).drop("repeat")
    if sum(sizes.values()) > ONE_TASK:
        ready = ready.repartition(parallelism(points.sparkSession), "id").sortWithinPartitions("id")
    ready = pin(ready)

    def out_of_fold(f: int) -> DataFrame:
        forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
        model = forest.fit(ready.filter(F.col("fold") != f))
        own = F.element_at(vector_to_array("probability"), F.col("y").cast("int") + 1)
        return model.transform(ready.filter(F.col("fold") == f)).select("id", "label", (1 - own).alias("hardness"))

    with ThreadPool(max(1, folds)) as pool:
        scored = pin(reduce(DataFrame.unionByName, pool.map(out_of_fold, range(folds), chunksize=1)))
    quota = _quota(points.sparkSession, {c: min(sizes.values()) for c in others(sizes)})
    low = minority(sizes)
    kept = smallest(scored.filter(F.col("label") != low), ["label"], "hardness", "id", quota, sum(sizes.values()))
    keep = kept.select("id").unionByName(scored.filter(F.col("label") == low).select("id"))
    return originals(points.join(keep, "id", "left_semi").select("id", "label", "x"))


def _bisected(points: DataFrame, k: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    ready = pin(points.withColumn("features", array_to_vector("x")))
    return pin(BisectingKMeans(k=k, seed=seed, maxIter=300).fit(ready).transform(ready).select("id", "prediction", "x"))


@resampler("ClusterCentroids")
def cluster_centroids(points: DataFrame, seed: int = SEED, method: str = "kmeans") -> DataFrame:
    """Every class but the minority replaced by as many cluster centres as the minority has rows.

    ``method`` is "kmeans" or "bisecting" (hierarchical), the same at every size. A clustering may end with fewer
    clusters than asked for; the rows farthest from their centres then stand in for the missing ones.
    """
    sizes = class_sizes(points)
    low, k = minority(sizes), min(sizes.values())
    out, start = originals(points.filter(F.col("label") == low)), 0
    for c in others(sizes):
        mine = pin(points.filter(F.col("label") == c))
        if sizes[c] == k:
            out = out.unionByName(originals(mine.select("id", "label", "x")))
            continue
        placed = {"kmeans": kmeans, "bisecting": _bisected}[method](mine, k, seed)
        found = placed.select("prediction").distinct().count()
        # centres as per-feature means: one combined aggregation, no centre leaves the cluster
        cells = placed.select("prediction", F.posexplode("x").alias("pos", "v"))
        means = cells.groupBy("prediction", "pos").agg(F.avg("v").alias("v"))
        centres = means.groupBy("prediction").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("cells"))
        centres = centres.select("prediction", F.col("cells.v").alias("x"))
        if found < k:
            apart = placed.join(centres.withColumnRenamed("x", "centre"), "prediction").select("id", "x", euclidean(F.col("x"), F.col("centre")).alias("apart"))
            far = apart.orderBy(F.desc("apart"), "id").limit(k - found)
            more = far.select((F.row_number().over(Window.orderBy(F.desc("apart"), "id")) + k - 1).alias("prediction"), "x")
            centres = centres.unionByName(more)
        none = F.lit(None).cast("bigint")
        out = out.unionByName(centres.select(
            (-1 - start - F.col("prediction")).cast("bigint").alias("id"), F.lit(c).alias("label"),
            "x", F.lit(True).alias("is_synthetic"), none.alias("src_id"), none.alias("nbr_id"),
        ))
        start += 2 * k
    return out
