"""End-to-end plans: clean -> split -> features -> classifier -> score.

``fit_triage`` fits once per (session, data dir, settings) and memoises the
fitted objects on the driver (they are small: vocabulary, category lists,
coefficients / trees), so several registered queries share one fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import cleaning as C
from ..operators import features as FE
from ..operators import models as M
from ..operators import ranking as R
from ..operators import splits as SP
from ..sources.fixtures import view

FEATURE_COLS = ["case_id", "case_summary", "created_at", "channel", "case_type", "category",
                "plan_tier", "customer_tenure_months"]


def normalise_cases(df: DataFrame) -> DataFrame:
    """Reference cleaning of case fields: trimmed lower-case text and
    categoricals, numeric tenure, empty text for missing summaries."""
    cols = {c: S.norm_lower(c) for c in C.CATEGORICAL_COLUMNS if c in df.columns}
    cols["case_summary"] = F.coalesce(S.norm_lower("case_summary"), F.lit(""))
    cols["customer_tenure_months"] = S.to_num("customer_tenure_months")
    return df.withColumns(cols)


def labelled_split(cases: DataFrame, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Labelled rows with ``split`` train/test; unlabelled rows get 'new'."""
    c = normalise_cases(cases).withColumn("priority_encoded", S.encode_priority("priority"))
    lab = SP.stratified_split(c.filter(F.col("priority_encoded").isNotNull()),
                              test_frac=test_frac, seed=seed)
    new = c.filter(F.col("priority_encoded").isNull()).withColumn("split", F.lit("new"))
    return lab.unionByName(new)


@dataclass
class Triage:
    data: DataFrame          # all cases with split
    train: DataFrame         # persisted training matrix (features, label, weight)
    space: FE.FeatureSpace
    model: object
    kind: str


_FITTED: dict = {}
_SPACES: dict = {}  # (split cases, training rows, feature space, number of training rows): the same for every classifier


def _prepared(spark: SparkSession, sf_dir: str, text: bool, max_features: int, variant: str | None):
    key = (id(spark), sf_dir, text, max_features, variant)
    if key not in _SPACES:
        # every fitting step (quotas, weights, vocabulary, categories, bins,
        # indexers, the optimiser) re-reads the split cases: keep them once,
        # spilling to disk; lost blocks are recomputed from lineage
        data = labelled_split(view(spark, sf_dir, "cases")).persist(StorageLevel.MEMORY_AND_DISK)
        train_rows = SP.with_class_weights(data.filter(F.col("split") == "train"))
        space = FE.fit_features(train_rows, text_col=FE.TEXT_COL if text else None,
                                max_features=max_features, variant=variant)
        _SPACES[key] = data, train_rows, space, train_rows.count()
    return _SPACES[key]


def fit_triage(spark: SparkSession, sf_dir: str, kind: str = "lr", text: bool = True,
               max_features: int = 500, variant: str | None = None, **train_kw) -> Triage:
    key = (id(spark), sf_dir, kind, text, max_features, variant, tuple(sorted(train_kw.items())))
    if key in _FITTED:
        return _FITTED[key]
    data, train_rows, space, n_train = _prepared(spark, sf_dir, text, max_features, variant)
    train = M.persist_training(
        space.transform(train_rows).select("case_id", "features", "priority_encoded", "weight"),
        n_train, trees=kind != "lr")
    if kind == "lr":
        model = M.train_lr(train, **train_kw)
    elif kind == "dt":
        model = M.train_dt(train, **train_kw)
    else:
        model = M.train_rf(train, **train_kw)
    t = Triage(data, train, space, model, kind)
    _FITTED[key] = t
    return t


def scored_cases(t: Triage, which: tuple[str, ...] = ("test", "new")) -> DataFrame:
    rows = t.data.filter(F.col("split").isin(list(which)))
    return M.score(t.model, rows, t.space)


PRED_COLS = ["case_id", "split", "priority_encoded", "predicted_priority", "predicted_label",
             "confidence", "prob_Low", "prob_Medium", "prob_High", "prob_Urgent"]


def flagship(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Clean -> split -> TF-IDF/one-hot/bins -> balanced multinomial LR ->
    the n most urgent not-yet-trained-on cases."""
    t = fit_triage(spark, sf_dir, "lr")
    return R.urgent_contacts(scored_cases(t).select(*PRED_COLS), n)


def release_fitted() -> None:
    """Unpersist and forget every memoised fit (long-running drivers)."""
    from . import explain as X
    for t in list(_FITTED.values()):
        t.train.unpersist()
        t.data.unpersist()
    _FITTED.clear()
    _SPACES.clear()
    for fz in list(X._FROZEN.values()):
        if fz.source is not None:
            fz.source.unpersist()
    X._FROZEN.clear()
    X._LR_EXPLAINERS.clear()
