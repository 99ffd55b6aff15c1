import random

import numpy as np
import pytest

from lopside.operators.classify import CLASSIFIERS, Effort, grower
from lopside.operators.classify.grower import Forest, Plan, drawn, grow, impurity, leaf_scores, mixed, times
from lopside.operators.kernel import fourier_map, kernel_width


def rows_of(spark, n, seed=1, classes=3, parts=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1), float(rng.randrange(4)), rng.random(), 7.0]
        y = min(classes - 1, int(x[0] > 0) + int(x[1] > 2))
        rows.append((i, y, x))
    return rows, spark.createDataFrame(rows, "id long, y int, x array<double>").repartition(parts)


def brute(rows, classes, plan):
    """The same trees, row by row on one machine: sorted (tree, path, feature, cut, class counts)."""
    ids, y, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    out = []
    for t in range(plan.trees):
        often = times(ids, y, t, plan)
        counts = np.array([often[y == c].sum() for c in range(classes)])
        weights = counts.sum() / np.maximum(classes * counts, 1) if plan.balanced else np.ones(classes)
        root = root_key(t, plan)
        todo = [("", root, np.flatnonzero(often > 0))]
        while todo:
            path, key, mine = todo.pop()
            counts = np.array([often[mine][y[mine] == c].sum() for c in range(classes)])
            best = None
            if (counts > 0).sum() > 1 and counts.sum() >= plan.min_rows and (plan.depth is None or len(path) < plan.depth):
                feature, cut = drawn(np.array([key], np.uint64), x[mine].min(0)[None], x[mine].max(0)[None], plan)
                for f, c in zip(feature[0].tolist(), cut[0].tolist()):
                    if f < 0:
                        continue
                    low = mine[x[mine, f] <= c]
                    left = np.array([often[low][y[low] == k].sum() for k in range(classes)])
                    cost = impurity(left, weights) + impurity(counts - left, weights)
                    if left.sum() and (counts - left).sum() and (best is None or cost < best[0]):
                        best = (cost, f, c)
            out.append((t, path, best[1] if best else -1, best[2] if best else 0.0, tuple(counts.tolist())))
            if best:
                low = x[mine, best[1]] <= best[2]
                with np.errstate(over="ignore"):
                    keys = mixed(np.array([key], np.uint64) * np.uint64(2) + np.array([1, 2], np.uint64))
                todo += [(path + "l", keys[0], mine[low]), (path + "r", keys[1], mine[~low])]
    return sorted(out)


def root_key(t, plan):
    return Forest.of_roots(np.ones((plan.trees, 2), np.int64), plan).key[t]


def nodes_of(forest):
    out = []
    for t in range(forest.trees):
        todo = [("", t)]
        while todo:
            path, k = todo.pop()
            out.append((t, path, int(forest.feature[k]), float(forest.cut[k]), tuple(forest.counts[k].tolist())))
            if forest.feature[k] >= 0:
                todo += [(path + "l", forest.left[k]), (path + "r", forest.right[k])]
    return sorted(out)


@pytest.mark.parametrize("plan", [
    Plan(3, 2), Plan(2, 4, cuts=5, share=(0.3, 1.0, 0.7)), Plan(2, 2, balanced=False, min_rows=9), Plan(2, 2, depth=2), Plan(2, 9, seed=5),
])
def test_forest_equals_brute_force(spark, plan):
    rows, df = rows_of(spark, 150)
    assert nodes_of(grow(df, 3, plan)) == brute(rows, 3, plan)


def test_forest_does_not_depend_on_partitions_or_waves(spark, monkeypatch):
    from lopside.operators.classify import grower

    rows, df = rows_of(spark, 200)
    want = nodes_of(grow(df, 3, Plan(4, 2)))
    assert nodes_of(grow(df.repartition(7), 3, Plan(4, 2))) == want
    monkeypatch.setattr(grower, "HELD", 24)
    monkeypatch.setattr(grower, "ROWS", 17)
    assert nodes_of(grow(df, 3, Plan(4, 2))) == want


def test_trees_grow_until_rows_are_told_apart(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(2), [i * 1.0]) for i in range(300)]
    forest = grow(spark.createDataFrame(rows, "id long, y int, x array<double>"), 2, Plan(5, 1, cuts=1))
    leaves = forest.feature < 0
    assert ((forest.counts[leaves] > 0).sum(1) == 1).all()
    facts = forest.facts()
    assert all(depth > 12 for _, _, _, depth, _, _ in facts)
    assert len({cut for *_, cut in facts}) == 5
    other = grow(spark.createDataFrame(rows, "id long, y int, x array<double>"), 2, Plan(5, 1, seed=7))
    assert not {cut for *_, cut in facts} & {cut for *_, cut in other.facts()}


def test_odd_tables(spark):
    schema = "id long, y int, x array<double>"
    empty = grow(spark.createDataFrame([], schema), 2, Plan(2, 1))
    assert empty.facts() == [(0, 1, 1, 0, -1, 0.0), (1, 1, 1, 0, -1, 0.0)]
    alike = grow(spark.createDataFrame([(1, 0, [3.0]), (2, 1, [3.0]), (3, 1, [3.0])], schema), 2, Plan(1, 1, balanced=False))
    assert alike.facts() == [(0, 1, 1, 0, -1, 0.0)]
    votes = leaf_scores(spark.createDataFrame([(9, "a", [1.0])], "id long, label string, x array<double>"), alike).head()["votes"]
    assert votes == pytest.approx([1 / 3, 2 / 3])
    holes = grow(spark.createDataFrame([(1, 0, [float("nan"), 1.0]), (2, 1, [2.0, 1.0]), (3, 0, [1.0, 1.0])], schema), 2, Plan(3, 2))
    assert all(n == 3 or n == 5 for _, n, *_ in holes.facts())


def test_bootstraps_are_balanced_and_their_own(spark):
    ids = np.arange(60_000)
    y = (ids % 20 == 0).astype(int)
    plan = Plan(3, 1, share=(1 / 19, 1.0))
    draws = [times(ids, y, t, plan) for t in range(3)]
    for d in draws:
        assert abs(d[y == 0].sum() / d[y == 1].sum() - 1) < 0.06
    assert all((a != b).mean() > 0.05 for a, b in zip(draws, draws[1:]))
    rows, df = rows_of(spark, 400, classes=2)
    forest = grow(df, 2, Plan(6, 2, share=(0.5, 1.0)))
    heavy = forest.counts[:6] * forest.weights
    assert np.allclose(heavy[:, 0], heavy[:, 1])
    assert len({tuple(c) for c in forest.counts[:6].tolist()}) > 1


def rings(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        inner = i % 3 == 0
        r, a = (1.0 if inner else 3.0) + rng.gauss(0, 0.2), rng.uniform(0, 2 * np.pi)
        rows.append((i, "in" if inner else "out", [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, "id long, label string, x array<double>")
    return df.filter("id % 4 != 1"), df.filter("id % 4 = 1")


def right(rows):
    return sum(r.y == r.yhat for r in rows) / len(rows)


@pytest.mark.parametrize("name", ["SVC", "ExtraTreesClassifier", "BalancedRandomForestClassifier"])
def test_rings_are_told_apart(spark, name):
    train, test = rings(spark)
    out = CLASSIFIERS[name](train, ["in", "out"], 42, Effort(trees=15))(test).collect()
    assert len(out) == test.count() and right(out) > 0.95
    assert all(abs(sum(r.scores.values()) - 1) < 1e-9 for r in out)


def test_a_line_does_not_tell_rings_apart(spark):
    train, test = rings(spark)
    assert right(CLASSIFIERS["LogisticRegression"](train, ["in", "out"])(test).collect()) < 0.8


def test_fourier_map_approaches_the_kernel(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, label string, x array<double>")
    assert kernel_width(df) == pytest.approx(1 / (4 * x.var()))
    z = np.array([r.x for r in fourier_map(df, gamma=0.3, waves=20_000)(df).orderBy("id").collect()])
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_svm_smote_takes_support_rows_of_the_curved_border(spark):
    from lopside.operators.resample import resample

    rng = random.Random(5)
    rows = []
    for i in range(300):
        r, a = (rng.uniform(0, 1) if i < 80 else rng.uniform(1.2, 3)), rng.uniform(0, 2 * np.pi)
        rows.append((i, "few" if i < 80 else "many", [float(r * np.cos(a)), float(r * np.sin(a))]))
    df = spark.createDataFrame(rows, "id long, label string, x array<double>")
    made = resample(df, "SVMSMOTE").filter("is_synthetic").collect()
    assert len(made) == 140 and {m.label for m in made} == {"few"}
    where = {i: np.hypot(*x) for i, _, x in rows}
    assert {m.src_id for m in made} < set(range(80))
    assert np.mean([where[m.src_id] for m in made]) > np.mean([where[i] for i in range(80)]) + 0.1


@pytest.mark.parametrize("plan", [Plan(3, 2), Plan(2, 2, cuts=4, share=(0.7, 0.9, 2.0)), Plan(2, 2, depth=5, min_rows=6)])
def test_subtrees_of_small_nodes_are_those_of_level_by_level_growth(spark, monkeypatch, plan):
    _, df = rows_of(spark, 400)
    waves, wave = [], grower._wave
    monkeypatch.setattr(grower, "_wave", lambda *a: waves.append(1) or wave(*a))
    found = {}
    for small in (0, 60, 4096):
        monkeypatch.setattr(grower, "SMALL", small)
        waves.clear()
        found[small] = nodes_of(grow(df, 3, plan)), len(waves)
    assert found[0][0] == found[60][0] == found[4096][0]
    assert found[0][1] >= found[60][1] > found[4096][1] == 0
