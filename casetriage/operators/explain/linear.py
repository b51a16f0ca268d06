"""Linear SHAP (I1, I5, I10) as row-local array expressions.

For a linear model with independent features and background mean mu,
the Shapley value of feature j for class c is W[c, j] * (x_j - mu_j) in
margin space and the base value is b_c + W[c] . mu (Lundberg & Lee 2017).

The coefficient matrix (#classes x #features) and mu are bounded by the
fitted feature space (the vocabulary is capped by ``max_features``) and are
folded into one constant; every row is then explained in place -- no join,
no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.scalar import PRIORITY_LEVELS, const_array

@dataclass
class LinearExplainer:
    W: list[list[float]]
    b: list[float]
    mu: list[float]
    names: list[dict]
    labels: list[str]

    @property
    def n_features(self) -> int:
        return len(self.mu)


def background_mean(background: DataFrame, features: str = "features") -> list[float]:
    """Mean feature vector of the background rows (one distributed
    aggregation; the result has one value per feature slot)."""
    from pyspark.sql.types import ArrayType
    if isinstance(background.schema[features].dataType, ArrayType):
        n = background.select(F.max(F.size(features))).first()[0] or 0
        row = background.agg(*[F.avg(F.col(features)[j]).alias(f"m{j}") for j in range(n)]).first()
        return [float(row[f"m{j}"]) for j in range(n)]
    row = background.select(Summarizer.mean(F.col(features)).alias("m")).first()
    return [float(v) for v in row["m"].toArray()]


def from_lr(model, names: list[dict], background: DataFrame, features: str = "features",
            labels: list[str] = PRIORITY_LEVELS) -> LinearExplainer:
    W = model.coefficientMatrix.toArray().tolist()
    b = model.interceptVector.toArray().tolist()
    return LinearExplainer(W, b, background_mean(background, features), names, labels)


def _x(features: str, df: DataFrame | None = None) -> Column:
    """Feature values as array<double> (vector columns are converted)."""
    from pyspark.sql.types import ArrayType
    if df is not None and isinstance(df.schema[features].dataType, ArrayType):
        return F.col(features)
    return vector_to_array(F.col(features))


def _dot(w: list[float], x: Column) -> Column:
    return F.aggregate(F.zip_with(const_array(w), x, lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)


def margins(x: Column, ex: LinearExplainer) -> Column:
    """Per-class margins b_c + W_c . x.

    The class loop is unrolled on purpose: a lambda that captures ``x``
    would let the optimizer inline the (expensive) feature expression into
    it and evaluate it once per class; as separate references it is
    computed once per row."""
    return F.array(*[F.lit(ex.b[k]) + _dot(ex.W[k], x) for k in range(len(ex.W))])


def argmax(arr: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def shap_linear(df: DataFrame, ex: LinearExplainer, features: str = "features",
                pred_col: str | None = "predicted_priority") -> DataFrame:
    """Adds ``phi`` (array, one value per feature slot, for the explained
    class), ``base_value`` and ``margin``; ``explained_class`` is the given
    prediction or the argmax margin."""
    x = _x(features, df)
    d = df.withColumn("_x", x).withColumn("_m", margins(F.col("_x"), ex))
    cls = F.col(pred_col).cast("int") if pred_col else argmax(F.col("_m"))
    d = d.withColumn("explained_class", cls)
    W, b, mu = const_array(ex.W), const_array(ex.b), const_array(ex.mu)
    wc = W[F.col("explained_class")]
    phi = F.zip_with(F.zip_with(F.col("_x"), mu, lambda a, m: a - m), wc, lambda d_, w: d_ * w)
    base = b[F.col("explained_class")] + F.aggregate(F.zip_with(wc, mu, lambda w, m: w * m),
                                                     F.lit(0.0), lambda s, v: s + v)
    return (d.withColumn("phi", phi).withColumn("base_value", base)
            .withColumn("margin", F.col("_m")[F.col("explained_class")])
            .drop("_x"))


def softmax(m: Column) -> Column:
    """Class probabilities from margins (stable: subtract the max)."""
    mx = F.array_max(m)
    e = F.transform(m, lambda v: F.exp(v - mx))
    tot = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / tot)


def shap_all_classes_abs_mean(df: DataFrame, ex: LinearExplainer, features: str = "features") -> DataFrame:
    """Per row: |phi| averaged over classes, one value per feature slot."""
    x = _x(features, df)
    mu = const_array(ex.mu)
    k = len(ex.W)
    d = df.withColumn("_dx", F.zip_with(x, mu, lambda a, m: a - m))
    summed = None
    for w in ex.W:  # unrolled (see ``margins``)
        part = F.zip_with(const_array(w), F.col("_dx"), lambda a, c: F.abs(a * c))
        summed = part if summed is None else F.zip_with(summed, part, lambda a, c: a + c)
    return d.withColumn("abs_phi", F.transform(summed, lambda v: v / k)).drop("_dx")


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of a task to their number and their sum."""
    n, total = 0, None
    for b in batches:
        if b.num_rows:
            x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0)
            n, total = n + b.num_rows, x if total is None else total + x
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total], pa.list_(pa.float64()))], names=["n", "total"])


def mean_importance(vectors: DataFrame, names: list[dict]) -> DataFrame:
    """(feature, importance): the mean of the rows' only column, an array with
    a value a feature, most important first.  The vectors are added up
    inside the tasks: one vector a task is shuffled, not a row a case and slot."""
    from ..reshape import explode_array
    parts = vectors.mapInArrow(_added_up, "n long, total array<double>")
    means = explode_array(parts, ["n"], "total", "v", "idx").groupBy("idx").agg((F.sum("v") / F.sum("n")).alias("importance"))
    names_ = const_array([n["name"] for n in names])
    return means.select(names_[F.col("idx")].alias("feature"), "importance").orderBy(F.desc("importance"), "feature")


def global_importance(sample: DataFrame, ex: LinearExplainer, features: str = "features",
                      key: str = "case_id") -> DataFrame:
    """Mean |phi| per feature over the sample rows and all classes,
    most important first."""
    return mean_importance(shap_all_classes_abs_mean(sample, ex, features).select("abs_phi"), ex.names)
