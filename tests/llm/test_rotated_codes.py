"""Findings of round 3 on op6_rotated_codes: partitions follow the vectors, and a block of queries gets the exact scores."""

import numpy as np

from graphmill.llm import op6_rotated_codes as op6


def test_partitions_follow_the_vectors(spark):
    df = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(16).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        plan = op6.nearest(df, df.where("vec_id % 20 = 0"), 5)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert "REPARTITION_BY_NUM" in plan and ", 64), REPARTITION_BY_NUM" not in plan


def test_block_is_exact():
    g = np.random.default_rng(3)
    x = g.standard_normal((9_000, 24))
    x[5_000:5_040] = x[7]  # copies, and rows that differ in the last places
    x[6_000:6_040] = x[7] * (1 + 1e-15 * np.arange(40))[:, None]
    ids = g.permutation(len(x)).astype(np.int64)
    centre, turn = x.mean(0), op6.rotation(24)
    part = op6.Part(ids, x, *op6.encode_rows(x, centre, turn))
    rows = np.append(np.arange(30), [5_003, 6_007])
    got = part.nearest(ids[rows], x[rows], x[rows] @ turn.T, x[rows] @ centre, 20)
    for i, (near, scores) in zip(rows, got):
        exact = np.zeros(len(x))
        for d in range(24):
            exact += x[:, d] * x[i, d]
        order = [j for j in np.lexsort((ids, -exact)) if j != i][:20]
        assert near.tolist() == ids[order].tolist() and scores.tolist() == exact[order].tolist()
