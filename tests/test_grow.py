"""Trees grown whole in a task: equal to Spark's trainer, search, forests kept as tables, and what is left to Spark's trainer."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from casetriage.operators import grow as G
from casetriage.operators import models as M
from casetriage.operators import tuning as T
from casetriage.operators.explain import explainer_kind
from casetriage.operators.explain.tree import shap_tree

WEIGHTS = [0.4, 1.7, 11.3, 2.9]


def made(spark, n=400, classes=4, seed=1):
    """Sparse, dense, negative, constant and two-valued features, and rows that come twice."""
    rng = np.random.default_rng(seed)
    sparse = np.where(rng.random((n, 4)) < 0.2, rng.random((n, 4)), 0.0)
    x = np.column_stack([sparse, rng.normal(size=(n, 2)), rng.integers(-2, 3, n), np.zeros(n), rng.random((n, 2)) < 0.3]).astype(float)
    x[n // 2:n // 2 + 20] = x[:20]
    y = (np.digitize(x[:, 4] + 2 * x[:, 0] - x[:, 8], [-0.8, 0.3, 1.2]) + (rng.random(n) < 0.15)) % classes
    rows = [(i, Vectors.dense(r), int(c), WEIGHTS[int(c)], i % 5) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["case_id", "features", "priority_encoded", "weight", "fold"])
    attrs = {"numeric": [{"idx": i} for i in range(8)], "binary": [{"idx": i} for i in (8, 9)]}
    kept = df.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"attrs": attrs, "num_attrs": 10}}))
    return kept.coalesce(1)


def text(m) -> str:
    return m.toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize("weight", ["weight", None])
@pytest.mark.parametrize("depth,least,kind,gain", [(3, 1, "gini", 0.0), (12, 1, "entropy", 0.0), (25, 4, "gini", 0.01), (9, 30, "entropy", 0.02)])
def test_tree_equals_sparks(spark, tmp_path, weight, depth, least, kind, gain):
    df = made(spark).persist()
    spark_dt = DecisionTreeClassifier(labelCol="priority_encoded", maxDepth=depth, minInstancesPerNode=least, impurity=kind, minInfoGain=gain, seed=42)
    want = (spark_dt.setWeightCol(weight) if weight else spark_dt).fit(df)
    got = M.train_dt(df, weight=weight, max_depth=depth, min_instances=least, impurity=kind, min_info_gain=gain)
    assert isinstance(got, G.TableForest) and got.numClasses == want.numClasses == 4
    got.write().save(str(tmp_path / "saved"))
    copy = M.load_model(str(tmp_path / "saved"), "rf")
    assert text(copy.trees[0]).strip() == text(want).strip() and copy.trees[0].numNodes == want.numNodes
    a, b = ([(r.probability.toArray(), r.prediction) for r in m.transform(df).orderBy("case_id").collect()] for m in (want, got))
    assert np.allclose([p for p, _ in a], [p for p, _ in b], atol=1e-12) and [c for _, c in a] == [c for _, c in b]
    assert np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray(), atol=1e-12)


def test_search_equals_cross_validator(spark, monkeypatch):
    """The same trials, scores and best tree as a fit of Spark's trainer for every trial and fold, without any."""
    df = made(spark).persist()
    est = DecisionTreeClassifier(labelCol="priority_encoded", seed=42)
    rows = df.withColumn(T.UNIT_WEIGHT, F.lit(1.0))
    maps = T.draw_params(est, T.DT_SPACE, 8, 42)
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=T.MacroF1Evaluator(), numFolds=5, foldCol="fold", parallelism=4, seed=42).fit(rows)

    def never(*a):
        raise AssertionError("a trial was fitted by Spark's trainer")
    monkeypatch.setattr(T.FewTasksTree, "_fit", never)
    best, trials = T.tune(df, "dt", n_trials=8, k=5)
    assert [p for p, _ in trials] == [{p.name: v for p, v in m.items()} for m in maps]
    assert np.allclose([s for _, s in trials], cv.avgMetrics, atol=1e-12)
    a, b = ([r.prediction for r in m.transform(df).orderBy("case_id").collect()] for m in (cv.bestModel, best))
    assert a == b


def test_forest_is_a_table(spark, tmp_path, monkeypatch):
    """All trees, whatever the partitioning; a copy saved for Spark has the same probabilities and importances."""
    monkeypatch.setattr(M, "ROWS_PER_TREE_PARTITION", 100)
    df = made(spark, 600).persist()
    m = M.train_rf(df, num_trees=37, max_depth=8)
    assert isinstance(m, G.TableForest) and explainer_kind(m) == "tree" and m.getNumTrees == m.table().count() == 37
    M.save_model(m, str(tmp_path / "saved"))
    copy = M.load_model(str(tmp_path / "saved"), "rf")
    assert isinstance(copy, RandomForestClassificationModel) and copy.getNumTrees == 37 and copy.numClasses == 4
    assert len({t.toDebugString for t in copy.trees}) == 37 and all(isinstance(t, DecisionTreeClassificationModel) for t in copy.trees)
    a, b, c = (np.array([r.probability.toArray() for r in x.transform(df).orderBy("case_id").collect()])
               for x in (m, copy, M.train_rf(df.repartition(5, "case_id"), num_trees=37, max_depth=8)))
    assert np.allclose(a, b, atol=1e-12) and np.array_equal(a, c)
    assert np.allclose(m.featureImportances.toArray(), copy.featureImportances.toArray(), atol=1e-12)
    scored = M.with_probs(m.transform(df))
    assert scored.where("predicted_priority = priority_encoded").count() > 480
    other = m.transform(df, {m.probabilityCol: "_p", m.rawPredictionCol: "_r", m.predictionCol: "_c"})
    assert {"_p", "_r", "_c"} <= set(other.columns) and "probability" not in other.columns


def test_tree_shap_of_a_table_forest(spark, tmp_path, monkeypatch):
    """The values of the saved copy's leaf paths."""
    monkeypatch.setattr(M, "ROWS_PER_TREE_PARTITION", 100)
    df = made(spark, 500)
    m = M.train_rf(df, num_trees=19, max_depth=9)
    m.write().overwrite().save(str(tmp_path / "saved"))
    copy = M.load_model(str(tmp_path / "saved"), "rf")
    scored = M.with_probs(m.transform(df)).where("case_id < 40")
    a, b = ({r.case_id: r for r in shap_tree(spark, scored, x, str(tmp_path / f"paths{i}")).collect()} for i, x in enumerate((m, copy)))
    assert len(a) == len(b) == 40
    for r in scored.collect():
        x, y = a[r.case_id], b[r.case_id]
        assert x.explained_class == y.explained_class == r.predicted_priority
        assert np.allclose(x.phi, y.phi, atol=1e-10) and abs(x.base_value - y.base_value) < 1e-10
        assert abs(x.fx - r.confidence) < 1e-10 and abs(x.base_value + sum(x.phi) - x.fx) < 1e-10


def test_other_rows_are_left_to_sparks_trainer(spark, monkeypatch):
    """Two classes, weights that differ within a class, categories of three values, too many cells."""
    facts = lambda d, w="weight": G.training_facts(d, "features", "priority_encoded", w)
    df = made(spark)
    assert facts(df).weights == tuple(WEIGHTS) and facts(df).two_valued[8:] == (True, True) and facts(df, None).weights == (1.0,) * 4
    assert facts(made(spark, classes=2)) is None
    assert facts(df.withColumn("weight", F.col("weight") + F.col("case_id") % 2)) is None
    assert facts(df.withColumn("weight", F.when(F.col("case_id") > 0, F.col("weight")))) is None
    three = F.col("features").alias("features", metadata={"ml_attr": {"attrs": {"nominal": [{"idx": 6, "vals": ["a", "b", "c"]}]}, "num_attrs": 10}})
    assert facts(df.withColumn("features", three)) is None
    assert facts(df.limit(20)) is None
    monkeypatch.setattr(G, "MAX_CELLS", 100)
    assert facts(df) is None and isinstance(M.train_dt(df), DecisionTreeClassificationModel)
