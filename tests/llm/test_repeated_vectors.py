"""Nearest neighbours of tables whose rows repeat ids and vectors more often than k + 1 times."""

import numpy as np

from quillspark.llm import neighbours


def test_repeated_rows_do_not_push_out_other_ids(spark):
    rng = np.random.default_rng(5)
    same, near = rng.standard_normal(6), rng.standard_normal(6)
    rows = [(7, same.tolist())] * 8 + [(i, same.tolist()) for i in range(8, 21)]
    rows += [(30, near.tolist())] * 9 + [(31, (near + 0.001 * j).tolist()) for j in range(12)]
    rows += [(40 + i, (near + 0.05 * rng.standard_normal(6)).tolist()) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, df, k=5, probes=200).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for own in (7, *range(8, 21)):
        assert got[own] == [i for i in range(7, 21) if i != own][:5]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    best = {}
    for i, v in rows:
        best[i] = max(best.get(i, -2.0), cos(near, v))
    assert got[30] == sorted((i for i in best if i != 30), key=lambda i: -best[i])[:5]
