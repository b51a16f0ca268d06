"""Tree SHAP: against subset enumeration, additivity against the Spark model, and a depth-1 tree by hand."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorIndexer
from pyspark.ml.linalg import Vectors

from casetriage.operators.explain.tree import leaf_paths, node_table, path_groups, path_shap, shap_tree

from conftest import SF_SMALL


def test_forest_additivity_matches_model(spark):
    import __spark_entry__ as E
    rows = E.queries()["shap_tree"](spark, SF_SMALL).collect()
    assert rows
    for r in rows:
        assert abs(r.fx - r.model_prob) < 1e-9          # the leaf paths' walk = Spark's probability
        assert abs(r.reconstructed - r.fx) < 1e-9       # base + sum(phi) = f(x)


def test_depth_one_tree_by_hand(spark, tmp_path):
    data = [(Vectors.dense([0.0, 5.0]), 0.0), (Vectors.dense([0.0, 1.0]), 0.0),
            (Vectors.dense([1.0, 3.0]), 1.0), (Vectors.dense([1.0, 2.0]), 1.0),
            (Vectors.dense([1.0, 4.0]), 0.0)]
    df = spark.createDataFrame(data, ["features", "label"])
    m = DecisionTreeClassifier(maxDepth=1).fit(df)
    groups = path_groups(leaf_paths(spark, m, str(tmp_path / "dt")).toArrow())
    phi, base, fx = path_shap(np.array([[1.0, 3.0]]), np.array([1]), groups)
    # root P(class 1) = 2/5; the right leaf (x0 = 1) has 2/3
    assert abs(phi[0, 0] - (2 / 3 - 2 / 5)) < 1e-12 and phi[0, 1] == 0.0
    assert abs(base[0] - 2 / 5) < 1e-12 and abs(fx[0] - 2 / 3) < 1e-12


def subset_values(nodes, x, cls, known):
    """What the tree expects when only the features ``known`` are: other splits share by cover."""
    def walk(i):
        n = nodes[i]
        if n.left < 0:
            return n.stats[cls] / sum(n.stats)
        if n.feature in known:
            v = x[n.feature]
            left = v in n.goes_left if n.n_categories >= 0 else v <= n.goes_left[0]
            return walk(n.left if left else n.right)
        a, b = sum(nodes[n.left].stats), sum(nodes[n.right].stats)
        return (a * walk(n.left) + b * walk(n.right)) / (a + b)
    return walk(0)


def enumerated(trees, x, cls):
    """Shapley values from all subsets of features, by their definition."""
    k = len(x)
    f = {s: np.mean([subset_values(t, x, cls, s) for t in trees]) for m in range(k + 1) for s in combinations(range(k), m)}
    phi = np.zeros(k)
    for i in range(k):
        for s in f:
            if i not in s:
                w = math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k)
                phi[i] += w * (f[tuple(sorted((*s, i)))] - f[s])
    return phi, f[()]


@pytest.mark.parametrize("categorical", [False, True])
def test_forest_equals_enumeration(spark, tmp_path, categorical):
    """Numeric and categorical splits, features that occur again and again on a path, one round and several."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 4, 400), rng.normal(size=400), rng.integers(0, 3, 400), rng.normal(size=400), rng.random(400)]).astype(float)
    y = ((x[:, 1] + (x[:, 0] == 2) - x[:, 3] * x[:, 4] > 0).astype(int) + (x[:, 2] == 1)).astype(float)
    df = spark.createDataFrame([(i, Vectors.dense(r), float(c)) for i, (r, c) in enumerate(zip(x, y))], ["case_id", "raw", "label"])
    if categorical:
        df = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(df).transform(df)
    else:
        df = df.withColumnRenamed("raw", "features")
    m = RandomForestClassifier(numTrees=4, maxDepth=7, seed=3).fit(df)
    trees = {}
    for r in node_table(spark, m, str(tmp_path / "nodes")).collect():
        trees.setdefault(r.tree, {})[r.id] = r
    scored = m.transform(df).withColumnRenamed("prediction", "predicted_priority").where("case_id < 12")
    one = {r.case_id: r for r in shap_tree(spark, scored, m, str(tmp_path / "one")).collect()}
    more = {r.case_id: r for r in shap_tree(spark, scored, m, str(tmp_path / "more"), path_bytes=4000).collect()}
    assert len(one) == len(more) == 12
    for r in scored.collect():
        got = one[r.case_id]
        phi, base = enumerated(list(trees.values()), r.features.toArray(), int(r.predicted_priority))
        assert np.allclose(got.phi, phi, atol=1e-10) and abs(got.base_value - base) < 1e-10
        assert abs(got.fx - r.probability[int(r.predicted_priority)]) < 1e-10
        assert np.allclose(more[r.case_id].phi, phi, atol=1e-10) and abs(more[r.case_id].fx - got.fx) < 1e-10


def test_deep_paths_stay_exact(spark, tmp_path):
    """Paths of 18 different features: additive to the last digits."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (300, 18)).astype(float)
    df = spark.createDataFrame([(i, Vectors.dense(r), float(i % 3)) for i, r in enumerate(x)], ["case_id", "features", "label"])
    m = DecisionTreeClassifier(maxDepth=18).fit(df)
    scored = m.transform(df).withColumnRenamed("prediction", "predicted_priority")
    for r in shap_tree(spark, scored, m, str(tmp_path / "deep")).collect():
        assert abs(r.base_value + sum(r.phi) - r.fx) < 1e-10


def test_sampled_shapley_is_efficient(spark):
    """sum(phi) = f(x) - base for every case (telescoping permutations)."""
    import __spark_entry__ as E
    from pyspark.sql import functions as F
    s = E.queries()["shap_sampled"](spark, SF_SMALL)
    per = s.groupBy("case_id").agg(F.sum("phi").alias("t"), F.first("base_value").alias("b"),
                                   F.first("fx").alias("fx"), F.count("*").alias("k")).collect()
    assert per
    for r in per:
        assert r.k == 6
        assert abs(r.t - (r.fx - r.b)) < 1e-9


def test_rows_of_one_partition_reach_all_cores(spark, tmp_path):
    """A sample of a few rows comes in one partition; every row meets every leaf, so the rows are dealt out."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, Vectors.dense(r), float(i % 3)) for i, r in enumerate(rng.random((60, 4)))], ["case_id", "features", "label"])
    m = DecisionTreeClassifier(maxDepth=4).fit(df)
    scored = m.transform(df.coalesce(1)).withColumnRenamed("prediction", "predicted_priority")
    out = shap_tree(spark, scored, m, str(tmp_path / "dealt"))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for r in out.collect():
        assert abs(r.base_value + sum(r.phi) - r.fx) < 1e-10
