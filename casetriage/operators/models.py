"""Classifiers, scoring and model tables.

Training uses Spark ML's distributed optimisers (L-BFGS with tree
aggregation for LR, binned split search for trees); the model itself is a
driver-side object whose size is bounded by (#classes x #features) or the
tree sizes, so model tables (coefficients, importances) are small frames.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import PRIORITY_LEVELS, decode_priority
from ..session import scratch_path
from . import grow as G
from .features import FeatureSpace
from .reshape import explode_array

LABEL = "priority_encoded"


ROWS_PER_TRAINING_PARTITION = 100_000
#: Trees read a row once for every group of nodes and tree: so few rows are worth a task.
ROWS_PER_TREE_PARTITION = 1_000


def persist_training(df: DataFrame, n_rows: int | None = None, trees: bool = False) -> DataFrame:
    """Iterative optimisers read the training matrix many times: keep it in
    memory, spilling to disk; lost blocks are recomputed from lineage.

    Every optimiser iteration is one job with a task per partition, so the
    matrix is sized to ~100k rows per partition (never more partitions than
    it already has): small training sets do not pay per-task overhead
    hundreds of times, large ones keep full parallelism.

    ``trees``: a pass of a tree trainer costs far more than a task, so the rows
    are dealt to as many tasks as the cluster runs at a time, if each has
    ROWS_PER_TREE_PARTITION.  More would not help: every task holds and sends
    the statistics of all nodes of a pass.

    The reduction is a shuffle of the finished (sparse) feature rows, not a
    ``coalesce``: a coalesce would pull the upstream tokenising and
    featurising into the same few tasks."""
    if n_rows is not None:
        want = max(1, -(-n_rows // ROWS_PER_TRAINING_PARTITION))
        have = df.rdd.getNumPartitions()
        if trees:
            cores = df.sparkSession.sparkContext.defaultParallelism
            want = max(want, min(cores, -(-n_rows // ROWS_PER_TREE_PARTITION)))
        if want < have or trees and want != have:
            df = df.repartition(want)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def tree_fits(train: DataFrame, n_rows: int) -> tuple[int, int]:
    """(tasks of one fit, fits at a time) for several tree fits on the same rows.

    In every pass each task of a fit holds and sends the statistics of all
    nodes of the pass, however few rows it has.  So fits share the cores
    instead of splitting the rows, unless a fit has ROWS_PER_TRAINING_PARTITION
    for each of more than half of them; then there is one fit at a time."""
    tasks = max(1, -(-n_rows // ROWS_PER_TRAINING_PARTITION))
    return tasks, max(1, train.sparkSession.sparkContext.defaultParallelism // tasks)


def _fit_forests(train: DataFrame, rf: RandomForestClassifier, n: int, tasks: int):
    """One forest of all trees of ``rf``, grown as ``n`` smaller ones at a time
    with seeds of their own: a forest's trees don't depend on each other.

    The parts are saved with the ML writer, their trees numbered through, and
    the whole is loaded like any saved model."""
    spark, trees, base = train.sparkSession, rf.getNumTrees(), scratch_path(train.sparkSession, "forests")
    ends = [trees * i // n for i in range(n + 1)]

    def grow(i: int) -> None:
        part = rf.copy({rf.numTrees: ends[i + 1] - ends[i], rf.seed: rf.getSeed() + 1_000_003 * i})
        part.fit(train.repartition(tasks)).write().save(f"{base}/{i}")  # not the cached rows' tasks: they would all go where those lie

    with ThreadPoolExecutor(n) as pool:
        list(pool.map(inheritable_thread_target(spark)(grow), range(n)))
    for table in ("data", "treesMetadata"):
        out = None
        for i in range(n):
            df = spark.read.parquet(f"{base}/{i}/{table}")
            tree = df.columns[0]
            df = df.withColumn(tree, (F.col(tree) + ends[i]).cast("int"))
            out = df if out is None else out.unionByName(df)
        out.write.parquet(f"{base}/whole/{table}")
    about = json.loads(spark.read.text(f"{base}/0/metadata").first()[0])
    about["numTrees"] = about["paramMap"]["numTrees"] = trees
    about["paramMap"]["seed"] = rf.getSeed()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{base}/whole/metadata")
    return RandomForestClassificationModel.load(f"{base}/whole")


def train_lr(train: DataFrame, features: str = "features", label: str = LABEL,
             weight: str | None = "weight", max_iter: int = 1000, C: float = 1.0,
             tol: float = 1e-4):
    """multinomial LR with the reference's objective.

    The reference minimises C * sum_i w_i * loss_i + ||W||^2 / 2; Spark
    minimises sum_i w_i * loss_i / sum_i w_i + regParam * ||W||^2 / 2, so
    regParam = 1 / (C * sum_i w_i) gives the same optimum."""
    sum_w = train.agg(F.sum(F.col(weight)) if weight else F.count(F.lit(1))).first()[0]
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial",
                            maxIter=max_iter, tol=tol, regParam=1.0 / (C * float(sum_w)),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True)
    if weight:
        lr.setWeightCol(weight)
    return lr.fit(train)


def train_dt(train: DataFrame, features: str = "features", label: str = LABEL,
             weight: str | None = "weight", max_depth: int = 3, min_instances: int = 1,
             impurity: str = "gini", min_info_gain: float = 0.0, seed: int = 42, max_bins: int = 32):
    """decision tree (balanced weights), grown in one task if its rows allow that (``grow.training_facts``)."""
    facts = G.training_facts(train, features, label, weight) if max_bins <= G.BINS else None
    if facts:
        return G.grow_forest(train, facts, features, label, 1, max_depth, min_instances, impurity, "all", seed, False, min_info_gain, max_bins)
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=label, maxDepth=max_depth,
                                minInstancesPerNode=min_instances, impurity=impurity,
                                minInfoGain=min_info_gain, seed=seed, maxBins=max_bins)
    if weight:
        dt.setWeightCol(weight)
    return dt.fit(train)


def train_rf(train: DataFrame, features: str = "features", label: str = LABEL,
             weight: str | None = "weight", num_trees: int = 413, max_depth: int = 18,
             min_instances: int = 1, subset: str = "sqrt", seed: int = 42,
             impurity: str = "gini"):
    """random forest with the reference's tuned settings by default
    (413 trees, depth 18, sqrt features, bootstrap, balanced weights).

    Above ROWS_PER_TREE_PARTITION rows, whole trees are grown by each task, if
    the rows allow that (``grow.training_facts``).  Otherwise they are grown in
    several fits at a time (``tree_fits``), if there are ROWS_PER_TREE_PARTITION
    rows for every fit."""
    n_rows = train.count()
    facts = G.training_facts(train, features, label, weight) if n_rows > ROWS_PER_TREE_PARTITION and subset in G.SUBSETS else None
    if facts:
        return G.grow_forest(train, facts, features, label, num_trees, max_depth, min_instances, impurity, subset, seed, True)
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=num_trees,
                                maxDepth=max_depth, minInstancesPerNode=min_instances,
                                featureSubsetStrategy=subset, bootstrap=True, seed=seed,
                                impurity=impurity)
    if weight:
        rf.setWeightCol(weight)
    tasks, fits = tree_fits(train, n_rows)
    fits = min(fits, num_trees, -(-n_rows // ROWS_PER_TREE_PARTITION))
    return rf.fit(train) if fits < 2 else _fit_forests(train, rf, fits, tasks)


def with_probs(scored: DataFrame, labels: list[str] = PRIORITY_LEVELS,
               probability: str = "probability", prediction: str = "prediction") -> DataFrame:
    """Predicted class (int + label), per-class probability
    columns and confidence (largest probability)."""
    arr = vector_to_array(F.col(probability))
    cols = {f"prob_{lbl}": arr[i] for i, lbl in enumerate(labels)}
    cols["predicted_priority"] = F.col(prediction).cast("int")
    cols["confidence"] = F.array_max(arr)
    out = scored.withColumns(cols)
    return out.withColumn("predicted_label", decode_priority("predicted_priority"))


def score(model, df: DataFrame, space: FeatureSpace | None = None) -> DataFrame:
    """features (if a feature space is given) then the classifier."""
    x = space.transform(df) if space is not None else df
    return with_probs(model.transform(x))


def score_all(models: dict, df: DataFrame, space: FeatureSpace | None = None,
              keep: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """score every model on the same rows; one frame keyed by model.

    The features are computed once: all models add their columns to one frame,
    and each of its rows becomes a row a model."""
    x = space.transform(df) if space is not None else df
    for i, m in enumerate(models.values()):
        x = m.transform(x, {m.probabilityCol: f"_p{i}", m.rawPredictionCol: f"_r{i}", m.predictionCol: f"_c{i}"})
        x = x.withColumn(f"_a{i}", vector_to_array(f"_p{i}")).drop(f"_p{i}", f"_r{i}")
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_c{i}").cast("int").alias("c"), F.col(f"_a{i}").alias("p"))
                     for i, name in enumerate(models)])
    rows = explode_array(x, list(keep), each, "m")
    return rows.select(F.col("m.model").alias("model"), *keep, F.col("m.c").alias("predicted_priority"),
                       F.array_max("m.p").alias("confidence"),
                       *[F.col("m.p")[i].alias(f"prob_{lbl}") for i, lbl in enumerate(PRIORITY_LEVELS)])


def coefficients(spark: SparkSession, model, space: FeatureSpace,
                 labels: list[str] = PRIORITY_LEVELS) -> DataFrame:
    """Intercept row + one row per feature with a coefficient per
    class (the wide, transposed table of the reference)."""
    W = model.coefficientMatrix.toArray()
    b = model.interceptVector.toArray()
    rows = [("intercept", -1, *[float(x) for x in b])]
    rows += [(n["name"], n["idx"], *[float(W[k, n["idx"]]) for k in range(len(labels))])
             for n in space.names]
    cols = "feature string, idx int, " + ", ".join(f"coef_{lbl} double" for lbl in labels)
    return spark.createDataFrame(rows, cols)


def tree_importance(spark: SparkSession, model, space: FeatureSpace, k: int | None = 20) -> DataFrame:
    """F8: impurity importance per feature, top k."""
    imp = model.featureImportances.toArray()
    rows = [(n["name"], n["block"], n["source_col"], float(imp[n["idx"]])) for n in space.names]
    df = spark.createDataFrame(rows, "feature string, block string, source_col string, importance double")
    df = df.orderBy(F.desc("importance"), F.asc("feature"))
    return df.limit(k) if k else df


def save_model(model, path: str) -> None:
    """Persist with the ML writer (pipeline or classifier)."""
    model.write().overwrite().save(path)


def load_model(path: str, kind: str = "pipeline"):
    """Restore a persisted pipeline / classifier."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import (DecisionTreeClassificationModel,
                                           LogisticRegressionModel,
                                           RandomForestClassificationModel)
    cls = {"pipeline": PipelineModel, "lr": LogisticRegressionModel,
           "dt": DecisionTreeClassificationModel, "rf": RandomForestClassificationModel}[kind]
    return cls.load(path)
