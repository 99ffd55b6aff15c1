"""The multivariate group is whole: covariances, eigenvalues and discriminants of all numeric columns, as in its SQL."""

import duckdb
import numpy as np
import pytest

from lopside.suite import profile_queries as pq


def test_all_multivariate_features(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.integers(1, 51)), float(rng.normal(30000, 9000)) + 5000 * (i % 3), float(rng.integers(0, 11)) / 100,
             float(rng.integers(0, 9)) / 100 + (i % 3 == 0) / 50, "OF"[i % 2], "ANR"[i % 3]) for i in range(300)]
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_returnflag"]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r[0]: r[1] for r in pq.multivariate(spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = dict(c.execute(pq.query.__globals__["SQL"]["multivariate_meta_features"]).fetchall())
    assert set(found) == set(want) >= {"w_lambda", "p_trace", "lh_trace", "roy_root", "nr_disc", "sd_ratio", "eigenvalues.mean", "can_cor.sd", "gravity"}
    assert all(found[k] == pytest.approx(want[k], abs=1.01e-4) for k in want)
    assert found["lh_trace"] > 0.1
