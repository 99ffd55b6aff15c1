"""Nearest neighbours, range counts and pair sums against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lopside.operators import neighbours as nb
from lopside.operators.profile import complexity, concept


def table(spark, n=600, d=3, seed=0, copies=200, grid=True):
    """Points of which a third are copies of the first."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, d)).astype(float) if grid else rng.normal(size=(n, d))
    x[:copies] = x[0]
    rows = [(int(i * 7 % 100003), "abc"[int(rng.integers(0, 30)) // 14], [float(v) for v in x[i]]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, label string, x array<double>").repartition(5)


def brute(rows, k, relation, metric):
    ids, labels, x = (np.array([r[i] for r in rows]) for i in range(3))
    dist = np.round(nb.distances(x, x, metric), 9)
    out = {}
    for i in range(len(rows)):
        ok = ids != ids[i]
        ok &= (labels == labels[i]) if relation == "same" else (labels != labels[i]) if relation == "other" else ok
        c = np.nonzero(ok)[0]
        out[int(ids[i])] = [int(v) for v in ids[c][np.lexsort((ids[c], dist[i, c]))[:k]]]
    return out


@pytest.mark.parametrize("relation", ["any", "same", "other"])
@pytest.mark.parametrize("d,grid,metric", [(3, True, "l1"), (12, False, "l2")])
@pytest.mark.parametrize("block_rows", [2048, 40])
def test_nearest(spark, relation, d, grid, metric, block_rows):
    rows, df = table(spark, d=d, grid=grid)
    got = {}
    for r in sorted(nb.nearest(df, df, 3, relation, metric, block_rows).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["nid"])
    assert got == {i: v for i, v in brute(rows, 3, relation, metric).items() if v}


def test_salted_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "SALT_BLOCKS", 1)
    monkeypatch.setattr(nb, "QUERY_BLOCK", 32)
    rows, df = table(spark)
    got = {}
    for r in sorted(nb.nearest(df, df, 2, block_rows=30).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["nid"])
    assert got == brute(rows, 2, "any", "l2")


@pytest.mark.parametrize("block_rows", [2048, 40])
def test_count_within(spark, block_rows):
    rows, df = table(spark)
    x = np.array([r[2] for r in rows])
    want = (np.round(nb.distances(x, x, "l2"), 9) < 1.5).sum(1)
    got = {r["id"]: r["n"] for r in nb.count_within(df.withColumn("radius", F.lit(1.5)), df, "l2", block_rows).collect()}
    assert got == {r[0]: int(n) for r, n in zip(rows, want)}


def test_counted_rows_are_sent_once_to_a_region(spark, monkeypatch):
    """As many copies of a query as regions at most, where there were as many as cells that its radius cuts."""
    rows, df = table(spark, n=1500, grid=False, copies=5)
    sent, dealt = [], nb._dealt
    monkeypatch.setattr(nb, "_dealt", lambda asked, visits, layout, region, *a: sent.append((sum(visits.values()), int(region.max()) + 1, layout.cells)) or dealt(asked, visits, layout, region, *a))
    x = np.array([r[2] for r in rows])
    radius = np.array([None if r[0] % 10 == 0 else (r[0] % 13) / 4 for r in rows], dtype=float)  # without a radius nothing is counted
    want = (np.round(nb.distances(x, x, "l1"), 9) < radius[:, None]).sum(1)
    asked = df.withColumn("radius", F.when(F.col("id") % 10 != 0, (F.col("id") % 13) / 4))
    got = {r["id"]: r["n"] for r in nb.count_within(asked, df, "l1", 40).collect()}
    assert got == {r[0]: int(n) for r, n in zip(rows, want)}
    copies, regions, cells = sent[0]
    assert copies <= regions * len(rows) and regions < cells


@pytest.mark.parametrize("block_rows", [2048, 50])
def test_pair_sums(spark, block_rows):
    rows, df = table(spark, n=300, copies=90)
    x = np.array([r[2] for r in rows])
    want = nb.distances(x, x, "l2").sum()

    def kernel(q, d):
        far = nb.distances(nb._matrix(q.field("x")), nb._matrix(d.field("x")), "l2")
        return [far @ d.field("w").to_numpy(zero_copy_only=False)]

    got = nb.sum_over_all(df, kernel, ["s"], block_rows).agg(F.sum(F.col("s") * F.col("w"))).head()[0]
    assert got == pytest.approx(want)


def test_concept_measures(spark):
    rows, df = table(spark, n=150, copies=50)
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    far = np.round(nb.distances(x, x, "l2"), 9)
    ring = 2.0 ** -np.ceil(far)
    np.fill_diagonal(ring, 0)
    found = concept.concept(df)
    assert found["cohesiveness"]["mean"] == pytest.approx(ring.sum(0).mean())
    assert found["impconceptvar"]["mean"] == pytest.approx((ring * (y[:, None] != y[None, :])).sum(0).mean())


@pytest.mark.parametrize("group, classes", [(65_536, 3), (40, 3), (40, 30)])
def test_concept_measures_of_pairs_seen_once(spark, monkeypatch, group, classes):
    """All four measures, per row and in several groups, with copies, rows on a grid and a class without a name."""
    monkeypatch.setattr(nb, "GROUP_ROWS", group)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.random((150, 3)), rng.integers(0, 3, (60, 3)) / 2, np.eye(3), np.zeros((1, 3)), 1e-7 * rng.random((20, 3))])
    x = np.concatenate([x, x[:50]])
    y = [None if i % 11 == 3 else f"c{i % classes}" for i in range(len(x) - 50)]
    y += y[:50]
    df = spark.createDataFrame([(i, c, v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id long, label string, x array<double>")
    low = x.min(0)
    x = (x - low) / (x.max(0) - low)
    far = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 9)
    rest = np.where(np.sqrt(3) - far > 0, np.sqrt(3) - far, 1e-9)
    near, ring = 2.0 ** (-2 * far / rest), 2.0 ** -np.ceil(far)
    odd = np.array([[a is None or b is None or a != b for b in y] for a in y])
    for k in (near, ring):
        np.fill_diagonal(k, 0)
    want = np.stack([ring.sum(1), (near * odd).sum(1) / near.sum(1), (ring * odd).sum(1), (near * far).sum(1) / near.sum(1)], axis=1)
    got = {r["id"]: [r[c] for c in concept.NAMES] for r in concept.concept_rows(df).collect()}
    same = {i: min(j for j in range(len(x)) if y[j] == y[i] and (x[j] == x[i]).all()) for i in range(len(x))}
    assert set(got) == set(same.values())
    named = [i for i in range(len(x)) if y[i] is not None]  # copies without a class differ from each other, a row from itself does not
    assert np.array([got[same[i]] for i in named]) == pytest.approx(want[named], rel=1e-9)


def test_concept_kernel_looks_at_a_pair_once(monkeypatch):
    rng = np.random.default_rng(6)
    seen, gaps = [], concept._gaps
    monkeypatch.setattr(concept, "_gaps", lambda a, b, *rest: seen.append(len(a) * len(b)) or gaps(a, b, *rest))
    monkeypatch.setattr(concept, "COLUMNS", 64)
    n = 640
    rows = pa.StructArray.from_arrays(
        [pa.array(range(n)), pa.array(["a", "b"] * (n // 2)), pa.array(rng.random((n, 3)).tolist()), pa.array([1] * n)], names=["id", "label", "x", "w"])
    concept._both(rows, None)
    assert sum(seen) <= n * (n + 2 * 64) / 2
    seen.clear()
    concept._both(rows.slice(0, 200), rows.slice(200))
    assert sum(seen) == 200 * (n - 200)


def kruskal(ids, x):
    dist = np.round(nb.distances(x, x, "l2"), 9)
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    edges = sorted((dist[i, j], min(ids[i], ids[j]), max(ids[i], ids[j]), i, j) for i in range(len(ids)) for j in range(i))
    out = set()
    for _, a, b, i, j in edges:
        if root(i) != root(j):
            up[root(i)] = root(j)
            out.add((a, b))
    return out


def test_spanning_tree_and_border_share(spark):
    rows, df = table(spark, n=120, copies=40)
    first = {}
    for i, label, x in sorted(rows):
        first.setdefault(tuple(x), (i, label))
    ids, x = [v[0] for v in first.values()], np.array(list(first))
    want = kruskal(ids, x)
    pts = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in zip(ids, x)], "id bigint, x array<double>")
    assert {(r["id"], r["nid"]) for r in complexity.spanning_tree(pts).collect()} == want
    label = {v[0]: v[1] for v in first.values()}
    touched = {i for e in want if label[e[0]] != label[e[1]] for i in e}
    for i, y, p in rows:
        lead = first[tuple(p)]
        if y != lead[1]:
            touched |= {i, lead[0]}
    assert complexity.border_share(df) == pytest.approx(len(touched) / len(rows))


def test_regions_bound_the_copies_of_a_row(spark, monkeypatch):
    """Cells join into few regions; regions larger than a task's share are cut into chunks and answers stay the same."""
    monkeypatch.setattr(nb, "REGION_ROWS", 12)
    rows, df = table(spark, n=400, d=12, copies=0, grid=False)
    layout = nb.lay_out(df.withColumn("w", F.lit(1)), "l2", 40)
    region = nb._regions(layout, 100)
    per = np.bincount(region, weights=layout.count)
    assert layout.cells == 20 and per.sum() == 400 and len(per) <= 12
    assert all(n <= 100 or (region == r).sum() == 1 for r, n in enumerate(per))
    got = {}
    for r in sorted(nb.nearest(df, df, 2, block_rows=40).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["nid"])
    assert got == brute(rows, 2, "any", "l2")


@pytest.mark.parametrize("d,grid", [(3, True), (12, False)])
@pytest.mark.parametrize("block_rows", [2048, 40])
def test_nearest_of_distinct_labels(spark, d, grid, block_rows):
    """The k nearest labels, each by its nearest row."""
    rows, df = table(spark, n=400, d=d, grid=grid, copies=100)
    names = {r[0]: f"{r[1]}{r[0] % 5}" for r in rows}
    df = df.withColumn("label", F.concat("label", (F.col("id") % 5).cast("string")))
    got = {}
    for r in sorted(nb.nearest(df, df, 3, "distinct", "l2", block_rows).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["nid"])
    want = {}
    for i, near in brute(rows, len(rows), "any", "l2").items():
        first = {}
        for j in near:
            first.setdefault(names[j], j)
        want[i] = list(first.values())[:3]
    assert got == want


def test_spanning_tree_searches_again_for_few_rows(spark, monkeypatch):
    """Rows whose known neighbours lead out of their component do not search in the next round."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) + 9 * (np.arange(80) % 3)[:, None]
    asked, search = [], complexity.nearest

    def counted(q, d, k, relation, metric):
        asked.append((relation, q.count()))
        return search(q, d, k, relation, metric)

    monkeypatch.setattr(complexity, "nearest", counted)
    pts = spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(x)], "id bigint, x array<double>")
    assert {(r["id"], r["nid"]) for r in complexity.spanning_tree(pts).collect()} == kruskal(list(range(80)), x)
    again = [n for relation, n in asked if relation == "other"]
    assert [r for r, _ in asked].count("any") == 1 and len(again) <= 3 and sum(again) <= 160
