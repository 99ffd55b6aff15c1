"""The wide table of meta-features."""

from lopside.suite import score_queries as sq


def test_datasets_are_dealt_out_before_they_turn(spark, monkeypatch):
    rows = [(f"d{i}", *[None if (i + j) % 5 == 0 else float(i * j) for j in range(sq.N_FEATURES)]) for i in range(40)]
    ch = spark.createDataFrame(rows, "dataset string, " + ", ".join(f"{c} double" for c in sq._EACH))
    monkeypatch.setattr(sq, "characteristics", lambda spark, sf: ch)
    monkeypatch.setattr(sq, "DATASETS_A_TASK", 2)
    wide = sq.wide_row(spark, "")
    assert sorted(map(tuple, wide.collect())) == sorted(rows)
    plan = wide._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(dataset" in plan and ", 20), REPARTITION_BY_NUM" in plan
    assert "Expand" not in plan  # it would forget how the rows were dealt out, and shuffle the long table
