"""Over-samplers: every class is brought up to the size of the largest."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.draws import SEED, uniform
from lopside.operators.kernel import fourier_map
from lopside.operators.neighbours import distances, nearest, sum_over_all, _codes, _matrix
from lopside.operators.ranks import hash_rank, running
from lopside.operators.resample.common import (
    by_label, class_sizes, deficits, draws, fits_broadcast, interpolate, multiply, originals, pick, resampler,
)
from lopside.session import pin

SYNTHETIC = ["id", "label", "x", "is_synthetic", "src_id", "nbr_id"]


def _dims(points: DataFrame) -> int:
    row = points.select(F.size("x")).head()
    return row[0] if row else 0


def _clamped(sizes: dict[str, int], classes, k: int) -> dict[str, int]:
    """k neighbours where a class has them, all its other rows where it has fewer."""
    for c in classes:
        if sizes[c] < 2:
            raise ValueError(f"class {c} has a single row, nothing to interpolate to")
    return {c: min(k, sizes[c] - 1) for c in classes}


@resampler("RandomOverSampler")
def random_over(points: DataFrame, seed: int = SEED) -> DataFrame:
    """Draw rows of each smaller class with replacement."""
    sizes = class_sizes(points)
    short = deficits(sizes)
    if not short:
        return originals(points)
    few = points.filter(F.col("label").isin(list(short)))
    rows = sum(sizes[c] for c in short)
    seeds = hash_rank(few, ["label"], "id", seed, rows=rows)
    seeds = seeds.select("label", "rank", F.col("id").alias("src_id"), "x")
    if fits_broadcast(rows, _dims(points)):
        seeds = F.broadcast(seeds)
    new = draws(points.sparkSession, short)
    new = new.withColumn("rank", pick(seed, by_label(sizes), F.col("label"), F.col("j"))).join(seeds, ["label", "rank"])
    new = new.select(
        (-1 - F.col("no")).alias("id"), "label", "x", F.lit(True).alias("is_synthetic"), "src_id",
        F.lit(None).cast("bigint").alias("nbr_id"),
    )
    return originals(points).unionByName(new)


def _with_neighbours(seeds: DataFrame, data: DataFrame, k: int, few: bool = True) -> DataFrame:
    """(id, label, x, nrank, nid, nx): seeds joined to their same-class neighbours, through the driver only if ``few``."""
    near = nearest(seeds, data, k, relation="same").select("id", "nid", F.col("rank").alias("nrank"))
    to = data.select(F.col("id").alias("nid"), F.col("x").alias("nx"))
    if not few:
        near, to = near.hint("merge"), to.hint("merge")
    return seeds.select("id", "label", "x").join(near, "id").join(to, "nid")


def _interpolated(spark, seeds: DataFrame, counts: dict[str, int], wanted: dict[str, int], ks: dict[str, int],
                  data: DataFrame, seed: int, start: int = 0, step=None) -> DataFrame:
    """``wanted`` new rows per class between a drawn seed and a drawn neighbour.

    ``step(u)`` turns the uniform draw into the interpolation factor and may use
    columns of ``seeds``.
    """
    ranked = hash_rank(seeds, ["label"], "id", seed, rows=sum(counts.values()))
    extra = [c for c in seeds.columns if c not in ("id", "label", "x")]
    few = fits_broadcast(sum(counts.values()) * max(ks.values()), _dims(data), 2)
    sides = _with_neighbours(seeds.select("id", "label", "x"), data, max(ks.values()), few)
    ranked = ranked.select("id", "rank", *extra)
    sides = sides.join(ranked if few else ranked.hint("merge"), "id")
    # beyond that size never through the driver, also where Spark finds it small after compression
    sides = F.broadcast(sides) if few else sides.hint("merge")
    u = uniform(seed, F.col("label"), F.col("j"), F.lit("gap"))
    new = draws(spark, wanted).select(
        "no", "label", "j",
        pick(seed, by_label(counts), F.col("label"), F.col("j")).alias("rank"),
        pick(seed, by_label(ks), F.col("label"), F.col("j"), F.lit("nn")).cast("int").alias("nrank"),
        u.alias("u"),
    ).join(sides, ["label", "rank", "nrank"])
    factor = F.col("u") if step is None else step(F.col("u"))
    return new.select(
        (-1 - start - F.col("no")).alias("id"), "label", interpolate(F.col("x"), F.col("nx"), factor).alias("x"),
        F.lit(True).alias("is_synthetic"), new["id"].alias("src_id"), F.col("nid").alias("nbr_id"),
    )


@resampler("SMOTE")
def smote(points: DataFrame, seed: int = SEED, k: int = 5) -> DataFrame:
    """New rows on the segment between a row and one of its k same-class neighbours."""
    sizes = class_sizes(points)
    short = deficits(sizes)
    if not short:
        return originals(points)
    ks = _clamped(sizes, short, k)
    few = points.filter(F.col("label").isin(list(short)))
    counts = {c: sizes[c] for c in short}
    new = _interpolated(points.sparkSession, few, counts, short, ks, few, seed)
    return originals(points).unionByName(new)


@resampler("BorderlineSMOTE")
def borderline_smote(points: DataFrame, seed: int = SEED, k: int = 5, m: int = 10) -> DataFrame:
    """SMOTE from the rows of which half or more, but not all, of m neighbours are foreign."""
    sizes = class_sizes(points)
    short = deficits(sizes)
    if not short:
        return originals(points)
    ks = _clamped(sizes, short, k)
    few = points.filter(F.col("label").isin(list(short)))
    foreign = nearest(few, points, m).groupBy("id").agg(
        F.count(F.when(F.col("nlabel") != F.col("label"), 1)).alias("foreign"), F.count(F.lit(1)).alias("m")
    )
    danger = foreign.filter((F.col("foreign") * 2 >= F.col("m")) & (F.col("foreign") < F.col("m")))
    danger = pin(few.join(danger.select("id"), "id", "left_semi"))
    counts = class_sizes(danger)
    wanted = {c: n for c, n in short.items() if counts.get(c)}
    if not wanted:
        return originals(points)
    new = _interpolated(points.sparkSession, danger, counts, wanted, ks, few, seed)
    return originals(points).unionByName(new)


@resampler("ADASYN")
def adasyn(points: DataFrame, seed: int = SEED, k: int = 5) -> DataFrame:
    """New rows in proportion to each row's share of foreign neighbours."""
    sizes = class_sizes(points)
    short = deficits(sizes)
    if not short:
        return originals(points)
    ks = _clamped(sizes, short, k)
    few = points.filter(F.col("label").isin(list(short)))
    foreign = nearest(few, points, k).groupBy("id", "label").agg(
        F.count(F.when(F.col("nlabel") != F.col("label"), 1)).alias("foreign")
    )
    foreign = pin(foreign)
    totals = {r["label"]: r["t"] for r in foreign.groupBy("label").agg(F.sum("foreign").alias("t")).collect()}
    for c in short:
        if not totals.get(c):
            raise ValueError(f"no row of class {c} has a neighbour of another class")
    share = F.col("foreign") / by_label({c: float(t) for c, t in totals.items()}) * by_label({c: float(n) for c, n in short.items()})
    seeds = foreign.select("id", "label", F.rint(share).cast("bigint").alias("g")).filter("g > 0")
    seeds = running(seeds, [], "id", ["g"], rows=sum(sizes[c] for c in short))
    seeds = few.join(seeds.select("id", "g", (F.col("g_upto") - F.col("g")).alias("before")), "id")
    copies = multiply(seeds.drop("x"), "g", "j", sum(short.values()))
    copies = copies.select(
        "id", "label", "j", "before",
        pick(seed, by_label(ks), F.col("label"), F.col("id"), F.col("j"), F.lit("nn")).cast("int").alias("nrank"),
        uniform(seed, F.col("label"), F.col("id"), F.col("j"), F.lit("gap")).alias("u"),
    )
    sides = _with_neighbours(seeds.select("id", "label", "x"), few, k).drop("label")
    if fits_broadcast(sum(sizes[c] for c in short) * k, _dims(points), 2):
        sides = F.broadcast(sides)
    new = copies.join(sides, ["id", "nrank"]).select(
        (-1 - F.col("before") - F.col("j")).alias("id"), "label",
        interpolate(F.col("x"), F.col("nx"), F.col("u")).alias("x"), F.lit(True).alias("is_synthetic"),
        F.col("id").alias("src_id"), F.col("nid").alias("nbr_id"),
    )
    return originals(points).unionByName(new)


def _mean_distance(q, d):
    """Kernel: weighted sum of distances to the other rows of the group."""
    near = distances(_matrix(q.field("x")), _matrix(d.field("x")), "l2")
    return [near @ d.field("w").to_numpy(zero_copy_only=False)]


def cluster_smote(points: DataFrame, clusters: DataFrame, seed: int = SEED, k: int = 2,
                  balance: float | None = None) -> DataFrame:
    """SMOTE inside the clusters (id, cluster) that are rich in the class.

    A cluster qualifies when the class's share reaches ``balance`` (default:
    half the deficit's share of the table) and holds more than k of its rows. It
    receives new rows in proportion to the sparsity of its class rows, measured
    from their mean pairwise distance.
    """
    sizes = class_sizes(points)
    short = deficits(sizes)
    placed = pin(points.join(clusters.select("id", F.col("cluster").cast("int")), "id"))
    mix: dict[int, dict[str, int]] = {}
    for r in placed.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n")).collect():  # clusters x classes
        mix.setdefault(r["cluster"], {})[r["label"]] = r["n"]
    out, start, total = originals(points), 0, sum(sizes.values())
    for c, need in short.items():
        limit = need / total / 2 if balance is None else balance
        good = [g for g, n in sorted(mix.items()) if n.get(c, 0) / sum(n.values()) >= limit and n.get(c, 0) > k]
        if not good:
            raise ValueError(f"no cluster holds enough rows of class {c}")
        mine = placed.filter((F.col("label") == c) & F.col("cluster").isin(good))
        sums = sum_over_all(mine, _mean_distance, ["dist"], within="cluster")
        mean = {}
        for r in sums.groupBy("cell").agg(F.sum(F.col("dist") * F.col("w")).alias("s")).collect():
            n = mix[r["cell"]][c]
            mean[r["cell"]] = r["s"] / (n * n - n)
        sparsity = {g: mean[g] ** (math.log(mix[g][c], 1.6) ** 1.8 * 0.16) / mix[g][c] for g in good}
        whole = sum(sparsity.values())
        if not whole:
            sparsity, whole = {g: 1.0 for g in good}, float(len(good))
        wanted = {f"{g}": math.ceil(round(need * sparsity[g] / whole, 9)) for g in good}
        # the cluster takes the place of the label, so neighbours stay inside it
        inside = mine.select("id", F.col("cluster").cast("string").alias("label"), "x")
        counts = {f"{g}": mix[g][c] for g in good}
        ks = {f"{g}": min(k, mix[g][c] - 1) for g in good}
        wanted = {g: n for g, n in wanted.items() if n > 0}
        new = _interpolated(points.sparkSession, inside, counts, wanted, ks, inside, seed, start)
        start += sum(wanted.values())
        out = out.unionByName(new.withColumn("label", F.lit(c)))
    return out


@resampler("KMeansSMOTE")
def kmeans_smote(points: DataFrame, seed: int = SEED, clusters: int = 8, balance: float | None = None) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = pin(points.withColumn("features", array_to_vector("x")))
    model = KMeans(k=clusters, seed=seed, maxIter=300).fit(vectors)
    found = model.transform(vectors).select("id", F.col("prediction").alias("cluster"))
    return cluster_smote(points, found, seed, balance=balance)


@resampler("SVMSMOTE")
def svm_smote(points: DataFrame, seed: int = SEED, k: int = 5, m: int = 10, out_step: float = 0.5, waves: int = 512) -> DataFrame:
    """New rows from the support rows of a machine with a Gaussian kernel, one class against the rest.

    The kernel stands as ``waves`` random Fourier features before a linear solver; support rows are those of the class
    whose margin is at most 1.
    Support rows whose m neighbours are all foreign are noise. Rows in danger
    (half or more foreign) move towards a class neighbour, safe ones away from it.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sizes = class_sizes(points)
    out, start = originals(points), 0
    lifted = pin(fourier_map(points, waves=waves, seed=seed)(points.select("id", "label", "x"))) if deficits(sizes) else None
    for c, need in deficits(sizes).items():
        few = points.filter(F.col("label") == c)
        ks = _clamped(sizes, [c], k)
        vectors = lifted.select("id", array_to_vector("x").alias("features"), (F.col("label") == c).cast("double").alias("y"))
        model = LinearSVC(labelCol="y", maxIter=100, regParam=1.0 / sum(sizes.values()), standardization=False).fit(vectors)
        mine = model.transform(vectors.filter(F.col("y") == 1.0))
        support = few.join(mine.filter(vector_to_array("rawPrediction")[1] <= 1.0).select("id"), "id", "left_semi").select("id", "label", "x")
        foreign = nearest(support, points, m).groupBy("id").agg(
            F.count(F.when(F.col("nlabel") != F.col("label"), 1)).alias("foreign"), F.count(F.lit(1)).alias("m")
        )
        seeds = support.join(foreign.filter(F.col("foreign") < F.col("m")), "id")
        seeds = pin(seeds.select("id", "label", "x", (F.col("foreign") * 2 >= F.col("m")).alias("danger")))
        counts = class_sizes(seeds)
        if not counts:
            raise ValueError(f"class {c} has no support rows that are not noise")
        new = _interpolated(
            points.sparkSession, seeds, counts, {c: need}, ks, few, seed, start,
            step=lambda u: F.when(F.col("danger"), u).otherwise(-out_step * u),
        )
        start += need
        out = out.unionByName(new)
    return out
