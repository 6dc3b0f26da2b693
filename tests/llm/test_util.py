from __future__ import annotations

from panelcast.llm.util import join_hot, stage


def test_salted_rows_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 5 else None) for i in range(60)], "id long, k long")
    dim = stage(spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string"), "dim")  # Spark knows a file's size
    out = join_hot(rows, dim, "k")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    plain = rows.join(dim, "k", "left")
    assert out.columns == plain.columns and sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))
