import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from lopside.llm import vectors


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes and errors by (vec_id, vector), label sums and the codebooks' digest, with Python integers."""
    kept = [(i, lab, [math.floor(x * 1024) for x in v]) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return Counter(), None
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = -(-len(kept[0][2]) // parts)
    cut = [[(r[2] + [0] * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return min(range(len(book)), key=lambda k: (far[k], k)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(e for _, e in f) for f in found]
    label = {}
    for r, e in zip(kept, errors):
        label[r[1]] = label.get(r[1], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    fit = lambda v: v if v < 2**63 else None
    return Counter((r[0], "".join(f"{k:02x}" for k, _ in f), fit(e), fit(label[r[1]])) for r, f, e in zip(kept, found, errors)), digest


def result(df, **how):
    rows = vectors.quantised(df, **how).collect()
    digests = {r.codebooks_sha256 for r in rows}
    assert len(digests) <= 1
    return Counter((r.vec_id, r.code, r.error, r.label_error) for r in rows), next(iter(digests), None)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def cloud(n, dims, seed=1, groups=9, spread=0.1):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middle)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("listed", [1, 3, 32])
@pytest.mark.parametrize("spread", [0.004, 0.3])
def test_equals_brute_force(spark, listed, spread):
    rows = cloud(300, 8, spread=spread)
    assert result(table(spark, rows), entries=24, listed=listed) == brute(rows, entries=24)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(40, 6, seed=3) + [
        (100, None, 1), (101, [], 1), (102, [0.0, None, 0, 0, 0, 0], 1), (103, [nan] * 6, 0), (104, [inf, 0.0, 0, 0, 0, 0], 0), (105, [1.0, 2.0], 0),
        (5, [0.5] * 6, 7), (5, [0.5] * 6, 7), (5, [-0.5] * 6, None), (None, [0.25] * 6, None), (None, [0.25] * 6, 2), (106, [-0.0001] * 6, 2), (107, [90_000.5] * 6, 3),
        (108, [3e9, -3e9, 1e12, 0.0, 0.0, 1.0], 4), (109, [-2e15] * 6, 5), (-3, [0.1] * 6, 1),
    ]
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], lab) for i, v, lab in rows]
    assert result(table(spark, rows), entries=8) == brute(rows, entries=8)
    extra = table(spark, rows).selectExpr("*", "'z' AS code", "1 AS v", "'q' AS near", "2 AS error", "3 AS n", "4 AS part")
    assert result(extra, entries=8) == brute(rows, entries=8)


def test_few_vectors_and_none(spark):
    for n in (0, 1, 3):
        rows = cloud(n, 4)
        assert result(table(spark, rows)) == brute(rows)
    assert vectors.quantised(table(spark, [(1, None, 2)])).collect() == []


def test_equal_vectors_and_ties(spark):
    """Copies, entries at equal distances, and entries that no vector takes."""
    rows = [(i, [float((i % 3) * 2 + (j % 2)) / 1024 for j in range(4)], i % 2) for i in range(60)] + [(100 + i, [1 / 1024, 0.0, 3 / 1024, 0.0], 0) for i in range(20)]
    assert result(table(spark, rows), entries=10) == brute(rows, entries=10)


def test_labels_of_any_number(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HOT", 3)  # labels of up to a third of the rows are joined, not broadcast
    rows = [(i, v, None if i % 2 else i) for i, v, _ in cloud(60, 4, seed=8)]
    assert result(table(spark, rows), entries=6) == brute(rows, entries=6)


def test_a_component_beyond_all_integers_is_an_error(spark):
    with pytest.raises(Exception, match="2\\*\\*52"):
        vectors.quantised(table(spark, [(1, [1e300] * 4, 0)])).collect()


def test_bounds_hold_and_decide_most_rows(spark):
    """Every bound stays below the true distance, and settled vectors are not looked at again."""
    coded = vectors.clustered(vectors.points(table(spark, cloud(600, 8, spread=0.002))), entries=20, rounds=6)
    assert sum(n[0] for n in coded.needed[-1]) > 0.95 * 4 * 600
    assert all(min(a) >= min(b) for a, b in zip(coded.widths[1:], coded.widths[2:]))
    held = np.cumsum(coded.widths[-1])[:-1], np.cumsum(np.array(coded.widths[-1]) + 1)[:-1]
    for row in coded.state.limit(50).collect():
        x = np.array(row.v).reshape(4, -1)
        near, lower = np.split(np.frombuffer(row.near, np.uint8), held[0]), np.split(np.frombuffer(row.lower, np.float32), held[1])
        for p in range(4):
            far = np.sqrt(((coded.codebooks[p] - x[p]) ** 2).sum(1))
            assert far[row.code[p]] == far.min() and np.frombuffer(row.upper, np.float32)[p] >= far.min()
            rest = [k for k in range(20) if k != row.code[p] and k not in near[p]]
            assert lower[p][-1] <= min(far[rest], default=np.inf)
            assert all(lower[p][j] <= far[near[p][j:]].min() for j in range(len(near[p])))


def test_registered_query(spark):
    from lopside.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op13_vector_codes"](spark, sf).collect()
    want, digest = brute(rows)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got) == want and {r.codebooks_sha256 for r in got} == {digest}


def test_next_width_weighs_distances_against_bounds():
    assert vectors.next_width(np.array([100] + [0] * 16), 8) == 1
    needed = np.zeros(17, dtype=np.int64)
    needed[3] = 100
    assert vectors.next_width(needed, 8) == 3
