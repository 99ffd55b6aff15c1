"""Bucketed ranking gives what a plain sort gives."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lopside.operators.quantiles import order_stats, quantiles
from lopside.operators.ranks import hash_rank, hash_take, running, smallest
from lopside.sources.tables import with_row_id


def drawn(i):
    return int(hashlib.md5(f"42|{i}".encode()).hexdigest()[:8], 16)


def frame(spark, n=3000):
    rows = [(i, "big" if i % 10 else "small", float((i * 7919) % 40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, g string, v double").repartition(6)


@pytest.mark.parametrize("bucket_rows", [10**6, 200])
def test_hash_rank(spark, bucket_rows):
    rows, df = frame(spark)
    want = {}
    for g in ("big", "small"):
        for r, i in enumerate(sorted((i for i, h, _ in rows if h == g), key=lambda i: (drawn(i), i)), 1):
            want[i] = r
    assert {r["id"]: r["rank"] for r in hash_rank(df, ["g"], "id", bucket_rows=bucket_rows).collect()} == want


@pytest.mark.parametrize("bucket_rows", [10**6, 150])
def test_hash_take(spark, bucket_rows):
    rows, df = frame(spark)
    quota = spark.createDataFrame([("big", 300), ("small", 17)], "g string, take bigint")
    want = set()
    for g, n in (("big", 300), ("small", 17)):
        want |= set(sorted((i for i, h, _ in rows if h == g), key=lambda i: (drawn(i), i))[:n])
    assert {r["id"] for r in hash_take(df, ["g"], "id", quota, bucket_rows=bucket_rows).collect()} == want


@pytest.mark.parametrize("bucket_rows", [10**6, 100])
def test_smallest(spark, bucket_rows):
    rows, df = frame(spark)
    quota = spark.createDataFrame([("big", 700), ("small", 9999)], "g string, take bigint")
    want = set(i for _, i in sorted((v, i) for i, g, v in rows if g == "big")[:700]) | {i for i, g, _ in rows if g == "small"}
    got = smallest(df, ["g"], "v", "id", quota, len(rows), bucket_rows)
    assert {r["id"] for r in got.collect()} == want


@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, descending):
    rows, df = frame(spark)
    freq = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    one = {(r["g"], r["v"]): r["n_upto"] for r in running(freq, ["g"], "v", ["n"], 80, descending).collect()}
    many = {(r["g"], r["v"]): r["n_upto"] for r in running(freq, ["g"], "v", ["n"], 80, descending, bucket_rows=7).collect()}
    assert one == many
    assert max(v for (g, _), v in one.items() if g == "big") == sum(1 for r in rows if r[1] == "big")


@pytest.mark.parametrize("direct_rows", [10**6, 10])
def test_quantiles(spark, direct_rows):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=2001), rng.integers(0, 4, 2001).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, ["a", "b"], probs, direct_rows=direct_rows)
    assert got["a"] == pytest.approx(list(np.quantile(a, probs)))
    assert got["b"] == pytest.approx(list(np.quantile(b, probs)))
    stats = order_stats(df, ["a"], lambda n: [0, 400, n - 401], direct_rows=direct_rows)
    assert stats["a"] == [sorted(a)[0], sorted(a)[400], sorted(a)[-401]]


def test_row_ids_do_not_depend_on_partitions(spark):
    rows = [(i % 7, "x") for i in range(400)] + [(1, "y")] * 300
    df = spark.createDataFrame(rows, "a int, b string")
    ids = [sorted(map(tuple, with_row_id(df.repartition(p)).collect())) for p in (1, 6)]
    assert ids[0] == ids[1]
    assert len({r[2] for r in ids[0]}) == 700
