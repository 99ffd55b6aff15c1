"""Complexity meta-features: how hard the classes are to tell apart."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lopside.functions.draws import SEED, uniform
from lopside.operators.neighbours import count_within, nearest
from lopside.operators.profile.concept import scaled
from lopside.operators.profile.scatter import Scatter
from lopside.operators.profile.summary import summarise, summarise_rows
from lopside.operators.ranks import hash_rank
from lopside.operators.resample.common import by_label, class_sizes, fits_broadcast, interpolate, pick
from lopside.session import pin

KNOWN = 8  # nearest rows of a row that are kept while a spanning tree grows
EXPLAINED = 0.95  # variance share that counts as the dimensions of the data


# ---- balance, dimensions, Fisher ratios: from class sizes and scatter ------------------

def from_scatter(s: Scatter) -> dict[str, object]:
    n, k, d = s.n.sum(), len(s.labels), s.mean.shape[1]
    p = s.n / n
    ratio = (k - 1) / k * (s.n / (n - s.n)).sum() if k > 1 else math.inf
    within, between = np.diag(s.within.sum(0)), np.diag(s.between)
    f1 = [1 / (1 + b / w) if w > 0 else (0.0 if b > 0 else None) for b, w in zip(between, within)]
    values = np.sort(np.linalg.eigvalsh(s.covariance))[::-1]
    share = np.cumsum(np.maximum(values, 0)) / max(values.sum(), 1e-300)
    dims = int(np.searchsorted(share, EXPLAINED - 1e-12) + 1)
    return {
        "c1": float(-(p * np.log(p)).sum() / math.log(k)) if k > 1 else None, "c2": 1 - 1 / ratio, "f1": summarise(f1),
        "f1v": summarise([_directional(s, i, j) for i, j in combinations(range(k), 2)]),
        "t2": d / n, "t3": min(dims, d) / n, "t4": min(dims, d) / d,
    }


def _directional(s: Scatter, i: int, j: int) -> float | None:
    """Fisher ratio of a class pair along its discriminant direction, as 1 / (1 + r)."""
    total = s.n[i] + s.n[j]
    w = (s.within[i] + s.within[j]) / total
    gap = s.mean[i] - s.mean[j]
    way = np.linalg.pinv(w) @ gap
    spread = way @ w @ way
    return float(1 / (1 + (way @ gap) ** 2 / spread)) if spread > 0 else None


# ---- overlap of class pairs ------------------------------------------------------------

def _ends(points: DataFrame) -> dict[str, np.ndarray]:
    """Per class the smallest and largest value of every feature: (2, d)."""
    cells = points.select("label", F.posexplode("x").alias("i", "v"))
    rows = cells.groupBy("label", "i").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # classes x features
    d = 1 + max((r["i"] for r in rows), default=-1)
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["label"], np.zeros((2, d)))[:, r["i"]] = r["lo"], r["hi"]
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(a[0], b[0]), np.minimum(a[1], b[1])


def f2_values(ends: dict[str, np.ndarray]) -> list[float]:
    """Per class pair: product over features of overlap length to joint range."""
    out = []
    for a, b in combinations(sorted(ends), 2):
        lo, hi = _overlap(ends[a], ends[b])
        span = np.maximum(ends[a][1], ends[b][1]) - np.minimum(ends[a][0], ends[b][0])
        share = np.divide(np.maximum(hi - lo, 0), span, out=np.zeros_like(span), where=span > 0)
        out.append(float(share.prod()))
    return out


def _inside(i: int, lo: np.ndarray, hi: np.ndarray) -> Column:
    return F.col("x")[i].between(float(lo[i]), float(hi[i]))


def f3_values(points: DataFrame, ends: dict[str, np.ndarray]) -> list[float]:
    """Per class pair: smallest share over features of rows inside the overlap; one scan."""
    pairs = list(combinations(sorted(ends), 2))
    exprs, d = [], next(iter(ends.values())).shape[1]
    for p, (a, b) in enumerate(pairs):
        lo, hi = _overlap(ends[a], ends[b])
        mine = F.col("label").isin(a, b)
        exprs.append(F.count(F.when(mine, 1)).alias(f"n{p}"))
        exprs += [F.count(F.when(mine & _inside(i, lo, hi), 1)).alias(f"c{p}_{i}") for i in range(d)]
    row = points.agg(*exprs).head()
    return [min(row[f"c{p}_{i}"] for i in range(d)) / row[f"n{p}"] for p in range(len(pairs))]


def f4_values(points: DataFrame) -> list[float]:
    """Per class pair: share of rows no single feature can separate.

    Repeatedly the feature leaving fewest rows inside the overlap is applied and
    the rows outside it are gone. What remains is always the table under a list
    of range conditions, so each round is two scans and nothing is carried over.
    """
    points = pin(points)
    out = []
    for a, b in combinations(sorted(class_sizes(points)), 2):
        mine = points.filter(F.col("label").isin(a, b))
        n = mine.count()
        kept: list[Column] = []
        free, left = None, n
        while left and free != set():
            now = mine.filter(reduce(lambda s, c: s & c, kept)) if kept else mine
            ends = _ends(now)
            if len(ends) < 2:
                left = 0
                break
            lo, hi = _overlap(ends[a], ends[b])
            free = set(range(len(lo))) if free is None else free
            row = now.agg(*[F.count(F.when(_inside(i, lo, hi), 1)).alias(f"c{i}") for i in sorted(free)]).head()
            best = min(sorted(free), key=lambda i: row[f"c{i}"])
            left = row[f"c{best}"]
            kept.append(_inside(best, lo, hi))
            free = free - {best}
        out.append(left / n)
    return out


# ---- neighbourhoods --------------------------------------------------------------------

def neighbour_rows(points: DataFrame) -> DataFrame:
    """Per row: distances to the nearest own and other class, nearest label right or wrong.

    Distances are Manhattan over min-max scaled features.
    """
    x = pin(scaled(points))
    own = nearest(x, x, 1, "same", "l1").select("id", F.col("dist").alias("own"), F.col("nid").alias("own_id"))
    other = nearest(x, x, 1, "other", "l1").select("id", F.col("dist").alias("other"), F.col("nid").alias("other_id"))
    both = x.select("id", "label", "x").join(own, "id", "left").join(other, "id", "left")
    wrong = F.col("own").isNull() | (F.col("other") < F.col("own")) | (
        (F.col("other") == F.col("own")) & (F.col("other_id") < F.col("own_id")))
    ratio = F.when(F.col("own") + F.col("other") > 0, F.col("own") / (F.col("own") + F.col("other")))
    return both.withColumns({"n2": ratio, "n3": wrong.cast("double")})


def neighbourhood(points: DataFrame) -> dict[str, object]:
    """n2 (own to other distance, as r / (1 + r)), n3 (nearest-neighbour error) and lsc."""
    rows = pin(neighbour_rows(points))
    out: dict[str, object] = dict(summarise_rows(rows, ["n2", "n3"]))
    n = rows.count()
    sets = count_within(rows.select("id", "x", F.col("other").alias("radius")), rows.select("id", "x"), "l1")
    total = sets.agg(F.sum("n")).head()[0]
    out["lsc"] = 1 - total / n**2
    return out


def _nearest_outside(pts: DataFrame, known: DataFrame, metric: str) -> DataFrame:
    """(id, label, nid, nlabel, dist): a nearest row of another label, for every row that may be the nearest of its label to one.

    ``known`` holds the first rows (id, nid, dist) by distance of every id. A row whose known ones all share its label searches
    only if the farthest of them is not beyond the shortest known way out of its label.
    """
    names = pts.select("id", "label")
    ways = known.join(names, "id").join(names.select(F.col("id").alias("nid"), F.col("label").alias("nlabel")), "nid")
    out = F.when(F.col("label") != F.col("nlabel"), F.struct("dist", "nid", "nlabel"))
    rows = pin(ways.groupBy("id", "label").agg(F.min(out).alias("e"), F.max("dist").alias("upto"), F.count(F.lit(1)).alias("n")))
    best = rows.groupBy("label").agg(F.min("e.dist").alias("least"))
    open_ = rows.filter(F.col("e").isNull() & (F.col("n") >= KNOWN)).join(best, "label")
    open_ = open_.filter(F.col("least").isNull() | (F.col("upto") <= F.col("least"))).select("id")
    asked = pin(pts.join(open_, "id"))
    found = rows.filter(F.col("e").isNotNull()).select("id", "label", "e.nid", "e.nlabel", "e.dist")
    if asked.isEmpty():
        return found
    return found.unionByName(nearest(asked, pts, 1, "other", metric).select("id", "label", "nid", "nlabel", "dist"))


def spanning_tree(points: DataFrame, metric: str = "l2") -> DataFrame:
    """Minimum spanning tree edges (id, nid, dist) over distinct points, ties by ids.

    Boruvka: each round finds every component's shortest edge to another one and
    merges along it; the number of components at least halves. The ``KNOWN`` nearest
    rows of each row are found once, and only rows that these leave open search again.
    ``points`` must hold each x once.
    """
    nodes = pin(points.select("id", "x", F.col("id").alias("comp")))
    known = pin(nearest(nodes.select("id", F.lit("").alias("label"), "x"), nodes.select("id", F.lit("").alias("label"), "x"), KNOWN, "any", metric).select("id", "nid", "dist"))
    edges = None
    while True:
        pts = pin(nodes.select("id", F.col("comp").cast("string").alias("label"), "x"))
        near = _nearest_outside(pts, known, metric)
        edge = F.struct("dist", F.least("id", "nid").alias("a"), F.greatest("id", "nid").alias("b"), F.col("nlabel").cast("bigint").alias("to"))
        best = pin(near.groupBy(F.col("label").cast("bigint").alias("comp")).agg(F.min(edge).alias("e")).select("comp", "e.*"))
        if best.isEmpty():
            break
        found = best.select(F.col("a").alias("id"), F.col("b").alias("nid"), "dist").distinct()
        edges = found if edges is None else edges.unionByName(found)
        # every component points to its partner; the only cycles are pairs, whose
        # smaller number becomes the root. Then pointers are followed by doubling.
        back = best.select(F.col("comp").alias("to"), F.col("to").alias("home"))
        up = best.join(back, "to").select(
            "comp", F.when((F.col("home") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("up"))
        up = pin(up)
        while True:
            hop = up.select(F.col("comp").alias("up"), F.col("up").alias("top"))
            nxt = pin(up.join(hop, "up").select("comp", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = nxt.select("comp", "up")
            if nxt.filter("moved").isEmpty():
                break
        nodes = pin(nodes.join(up, "comp", "left").select("id", "x", F.coalesce("up", "comp").alias("comp")))
        if nodes.agg(F.min("comp") == F.max("comp")).head()[0]:
            break
    if edges is None:
        return points.sparkSession.createDataFrame([], "id bigint, nid bigint, dist double")
    return edges.distinct()


def border_share(points: DataFrame, metric: str = "l2") -> float:
    """n1: share of rows on a spanning-tree edge between classes.

    Identical rows hang on the first of them by edges of length zero, so only
    distinct points enter the tree and copies are counted.
    """
    n = points.count()
    copies = pin(points.groupBy("x", "label").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    first = Window.partitionBy("x")
    # at most one row per class and point, so this window is small
    lead = copies.withColumn("lead", F.min(F.struct("id", "label")).over(first))
    odd = F.sum(F.when(F.col("label") != F.col("lead.label"), F.col("n")).otherwise(0))
    reps = pin(lead.groupBy("x").agg(F.first("lead").alias("lead"), odd.alias("odd")).select(
        F.col("lead.id").alias("id"), F.col("lead.label").alias("label"), "x", "odd"))
    tree = pin(spanning_tree(reps, metric))
    names = reps.select("id", "label")
    ends = tree.join(names, "id").join(names.select(F.col("id").alias("nid"), F.col("label").alias("nlabel")), "nid")
    cross = ends.filter(F.col("label") != F.col("nlabel"))
    touched = cross.select("id").unionByName(cross.select(F.col("nid").alias("id")))
    touched = touched.unionByName(reps.filter(F.col("odd") > 0).select("id")).distinct().count()
    return (touched + (reps.agg(F.sum("odd")).head()[0] or 0)) / n


# ---- random points between rows of a class: properties only -------------------------------

def between_rows(points: DataFrame, seed: int = SEED) -> DataFrame:
    """As many new points as rows: a random class each, between two random rows of it (negative ids)."""
    sizes = class_sizes(points)
    names, n = sorted(sizes), sum(sizes.values())
    ranked = pin(hash_rank(points, ["label"], "id", seed, rows=n).select("label", "rank", "x"))
    no = F.col("no")
    asked = points.sparkSession.range(n).withColumnRenamed("id", "no")
    asked = asked.withColumn("label", F.element_at(F.array(*[F.lit(c) for c in names]), pick(seed, F.lit(len(names)), no, F.lit("class")).cast("int")))
    asked = asked.select("no", "label", pick(seed, by_label(sizes), no, F.lit("a")).alias("a"), pick(seed, by_label(sizes), no, F.lit("b")).alias("b"))
    dims = points.select(F.size("x")).head()[0]
    # a class of few rows is asked for each of them very often: those are broadcast
    small, held = [], 0
    for c in sorted(sizes, key=lambda c: (sizes[c], c)):
        if fits_broadcast(held + sizes[c], dims):
            small.append(c)
            held += sizes[c]
    out = None
    for few in (True, False):
        mine = F.col("label").isin(small) if few else ~F.col("label").isin(small)
        if not (small if few else set(names) - set(small)):
            continue
        side = ranked.filter(mine)
        side = F.broadcast(side) if few else side
        step = uniform(seed, no, F.lit("step"))
        part = asked.filter(mine).join(side.select("label", F.col("rank").alias("a"), F.col("x").alias("xa")), ["label", "a"])
        part = part.join(side.select("label", F.col("rank").alias("b"), F.col("x").alias("xb")), ["label", "b"])
        part = part.select((-1 - no).alias("id"), "label", interpolate(F.col("xa"), F.col("xb"), step).alias("x"))
        out = part if out is None else out.unionByName(part)
    return out


def interpolated_error(points: DataFrame, seed: int = SEED) -> dict[str, float | None]:
    """n4: nearest-neighbour error on interpolated points."""
    x = pin(scaled(points))
    near = nearest(pin(between_rows(x, seed)), x, 1, "any", "l1")
    wrong = near.select((F.col("label") != F.col("nlabel")).cast("double").alias("n4"))
    return summarise_rows(pin(wrong), ["n4"])["n4"]


def linearity(points: DataFrame, seed: int = SEED) -> dict[str, object]:
    """l1, l2, l3: error distance, error rate and interpolated error of linear SVMs, per class pair."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = pin(scaled(points))
    new = pin(between_rows(x, seed))
    found: dict[str, list] = {"l1": [], "l2": [], "l3": []}
    for a, b in combinations(sorted(class_sizes(x)), 2):
        def ready(df):
            df = df.filter(F.col("label").isin(a, b))
            return df.select((F.col("label") == b).cast("double").alias("y"), array_to_vector("x").alias("features"))

        model = LinearSVC(labelCol="y", maxIter=100, regParam=0.001).fit(ready(x))
        wrong = F.col("prediction") != F.col("y")
        margin = F.abs(vector_to_array("rawPrediction")[1])
        norm = float(np.linalg.norm(model.coefficients.toArray())) or 1.0
        fit = model.transform(ready(x)).agg(F.avg(F.when(wrong, margin / norm).otherwise(0.0)).alias("d"), F.avg(wrong.cast("int")).alias("e")).head()
        apart = model.transform(ready(new)).agg(F.avg(wrong.cast("int"))).head()[0]
        found["l1"].append(1 - 1 / (1 + fit["d"]))
        found["l2"].append(fit["e"])
        found["l3"].append(apart)
    return {k: summarise(v) for k, v in found.items()}
