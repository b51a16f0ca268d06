"""Explanation operators: Shapley contributions (linear, tree, exact coalitions, sampled),
roll-ups, semantic groups, documents and narratives."""

from __future__ import annotations


def explainer_kind(model) -> str:
    """I4: pick the explainer from the model class."""
    from pyspark.ml.classification import (DecisionTreeClassificationModel,
                                           LogisticRegressionModel,
                                           RandomForestClassificationModel)
    from ..grow import TableForest
    if isinstance(model, LogisticRegressionModel):
        return "linear"
    if isinstance(model, (DecisionTreeClassificationModel, RandomForestClassificationModel, TableForest)):
        return "tree"
    # any other classifier is a black box; boosted trees too, as they add up weighted margins, not class shares
    return "agnostic"
