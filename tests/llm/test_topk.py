import math

import numpy as np
from pyspark.sql import functions as F

from casetriage.llm import topk
from casetriage.llm.topk import top_k


def brute(rows, k, every, scale=64):
    ok = {i: [math.floor(scale * x) for x in v] for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % every == 0:
            got = sorted(((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q))[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(got)]
    return sorted(out)


def run(spark, rows, k, every):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as cid", "1 as score", "2 as rank", "3 as v")
    return sorted(map(tuple, top_k(df.repartition(4), F.col("vec_id") % every == 0, k=k).collect()))


def test_equals_brute_force_with_clusters_and_copies(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 40)  # several blocks of queries
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 0.3, (4, 12))
    rows = [(int(i), (centres[i % 4] + rng.normal(0, 0.1, 12)).astype(np.float32).tolist()) for i in range(300)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(120)]
    assert run(spark, rows, 20, 5) == brute(rows, 20, 5)


def test_edge_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (6, [1.0]),
            (7, [1.0, 2.0, 3.0]), (8, [-1.0, -2.0]), (9, [0.0, 0.0]), (10, [1.0, 2.0]), (10, [1.0, 2.0]), (None, [5.0, 5.0]), (12, [0.01, -0.01])]
    want = brute([r for n, r in enumerate(rows) if r not in rows[:n]], 4, 2)
    assert run(spark, rows, 4, 2) == want


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [2.0])]
    assert run(spark, rows, 20, 2) == brute(rows, 20, 2)
    assert run(spark, [(0, [1.0])], 5, 2) == []
    assert run(spark, [], 5, 2) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**17 + i), float(-(2**17) + 3 * i)]) for i in range(30)]
    assert run(spark, rows, 3, 10) == brute(rows, 3, 10)


def test_components_of_any_size(spark):
    """Components are floored whole; scores are exact as far as a long goes and saturate beyond 2^62."""
    rows = [(0, [1.0, 1.0]), (1, [3e6, 0.0]), (2, [2e6, 0.0]), (3, [2.0**23, -7.0]), (4, [2.0**23, -6.0]), (5, [2.0**24, 2.0**21])]
    assert run(spark, rows, 5, 5) == brute(rows, 5, 5)
    rows += [(6, [1e30, 1.0]), (7, [-1e30, 3.0]), (10, [2.0**40, 2.0**40])]
    want = [(q, r, c, max(-(2**62), min(2**62, s))) for q, r, c, s in brute(rows, 8, 5)]
    got = run(spark, rows, 8, 5)
    assert [x[3] for x in got] == [x[3] for x in want] and sorted(x[:2] + x[3:] for x in got) == sorted(x[:2] + x[3:] for x in want)
