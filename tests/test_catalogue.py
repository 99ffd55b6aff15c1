"""Counting the matches of many searches, and what a task of the knowledge base holds."""

import numpy as np

from lopside.plans import ranking
from lopside.sources import catalogue as cat
from pyspark.sql import functions as F

SETS = "NumberOfClasses bigint, NumberOfInstances bigint, NumberOfFeatures bigint, MajorityClassSize bigint, MinorityClassSize bigint, NumberOfMissingValues bigint"
SEARCHES = ("config_id bigint, min_classes bigint, max_classes bigint, min_instances bigint, max_instances bigint, min_features bigint, max_features bigint, "
            "min_imbalance double, max_imbalance double, allow_missing_values boolean, max_results bigint, Datasets_Found bigint")


def sets_and_searches(n=3000, m=60):
    rng = np.random.default_rng(3)
    draw = lambda lo, hi: [int(v) for v in rng.integers(lo, hi, n)]
    sets = list(zip(draw(1, 9), draw(100, 12000), draw(2, 82), draw(100, 5000), draw(0, 400), draw(0, 2)))
    sets[:500] = [sets[0]] * 500  # many copies of one
    sets[7] = (None, *sets[7][1:])
    ask = []
    for i in range(m):
        c, r, f = int(rng.integers(1, 6)), int(rng.integers(100, 4000)), int(rng.integers(2, 30))
        ask.append((i, c, c + int(rng.integers(0, 4)), r, r + int(rng.integers(10, 8000)), f, f + int(rng.integers(0, 60)), 1.5, float(rng.integers(2, 90)),
                    [True, False, None][i % 3], [5, 100, 10_000, None][i % 4], -1 if i % 9 == 0 else None))
    ask += [(3, *ask[4][1:]), (m, 5, 2, *ask[0][3:-1], None), (m + 1, None, *ask[1][2:-1], None)]
    return sets, ask


def brute(sets, ask):
    rows = [(*s[:3], s[3] / s[4], s[5]) for s in sets if None not in s and s[4] > 0]
    n = {}
    for q in ask:
        if q[11] is None and None not in q[:9]:
            n[q[0]] = n.get(q[0], 0) + sum(all(a <= v <= b for v, a, b in zip(r, q[1:9:2], q[2:9:2])) and (bool(q[9]) or r[4] == 0) for r in rows)
    return sorted((q[0], q[11] if q[11] is not None else min(n.get(q[0], 0), q[10] if q[10] is not None else 10**9)) for q in ask)


def test_counts_of_searches(spark):
    sets, ask = sets_and_searches()
    found = cat.count_matches(spark.createDataFrame(ask, SEARCHES), spark.createDataFrame(sets, SETS))
    assert sorted((r["config_id"], r["Datasets_Found"]) for r in found.collect()) == brute(sets, ask)


def test_only_cut_cells_are_checked_row_by_row(spark, monkeypatch):
    """A search that cells inside its ranges already answer asks for no row; before, it met every row of its bins."""
    sets, _ = sets_and_searches()
    asked = []
    monkeypatch.setattr(cat, "pin", lambda df: asked.append(df.cache()) or asked[-1])
    wide = spark.createDataFrame([(1, 1, 9, 1, 20000, 1, 90, 0.0, 1e9, True, 10, None)], SEARCHES)
    assert cat.count_matches(wide, spark.createDataFrame(sets, SETS)).head()["Datasets_Found"] == 10
    assert asked[-1].agg(F.sum(F.size("cut"))).head()[0] == 0


def test_rank_sums_work_scores_out_once(spark):
    """The scores are read from a written table, so the expressions behind them run in one job."""
    df = spark.createDataFrame([(i, "ab"[i % 2], round(i % 7 / 7, 3)) for i in range(50)], "id bigint, name string, v double")
    full = df.select("id", "name", (F.col("v") * 3 + 1).alias("final score"))
    sums = ranking.rank_sums(full, "name", "id")
    assert sum(r["score"] for r in sums.collect()) == 50 * 49 // 2
    assert "* 3.0" not in sums._jdf.queryExecution().toString()
