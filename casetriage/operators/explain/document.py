"""Explanation documents and cards.

A document is one nested struct per case, built from the contribution
arrays in the row; the dictionary lookup is an in-row literal map (the
dictionary is fixed and small), so no join is needed at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import formatting as FMT
from ...functions.scalar import round_keep_sign
from ...functions.scalar import PRIORITY_LEVELS, const_array, tenure_tier
from .vocab import FEATURE_EXPLANATIONS

TENURE = "customer_tenure_months"
SEP = "\t"


def _dict_map(dictionary: dict) -> Column:
    kv = []
    for f, vals in dictionary.items():
        if f == TENURE:
            continue
        for v, text in vals.items():
            kv += [F.lit(f"{f}{SEP}{v}"), F.lit(text)]
    return F.create_map(*kv)


def explanation_text(feature: Column, value: Column, dictionary: dict = FEATURE_EXPLANATIONS) -> Column:
    """H5 with the reference's fallbacks: known value -> sentence; known
    feature -> 'f = v'; unknown feature -> 'f value: v'; tenure -> tier
    sentence."""
    v = F.coalesce(value, F.lit("None"))
    known = const_array([f for f in dictionary])
    by_value = _dict_map(dictionary)[F.concat(feature, F.lit(SEP), F.lower(value))]
    tiers = dictionary.get(TENURE, {})
    tier_map = F.create_map(*[x for k, t in tiers.items() for x in (F.lit(k), F.lit(t))])
    tier_text = F.coalesce(tier_map[tenure_tier(value)],
                           F.concat(F.lit("Customer tenure: "), v, F.lit(" months")))
    return (F.when(feature == TENURE, tier_text if tiers else F.lit(None))
            .when(F.array_contains(known, feature),
                  F.coalesce(by_value, F.concat(feature, F.lit(" = "), v)))
            .otherwise(F.concat(feature, F.lit(" value: "), v)))


def enrich(contribs: Column, dictionary: dict = FEATURE_EXPLANATIONS) -> Column:
    """Value + rounded contribution + explanation per contribution."""
    return F.transform(contribs, lambda c: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value"),
        round_keep_sign(c["contribution"], 3).alias("contribution"),
        explanation_text(c["feature"], c["value"], dictionary).alias("explanation")))


def split_signs(contribs: Column, dictionary: dict = FEATURE_EXPLANATIONS) -> tuple[Column, Column]:
    """H9: positive / negative lists (zero dropped), enriched, order kept."""
    pos = enrich(F.filter(contribs, lambda c: c["contribution"] > 0), dictionary)
    neg = enrich(F.filter(contribs, lambda c: c["contribution"] < 0), dictionary)
    return pos, neg


def with_document_parts(df: DataFrame, probs: str = "probs", cls: str = "explained_class",
                        contribs: str = "contributions", labels: list[str] = PRIORITY_LEVELS,
                        dictionary: dict = FEATURE_EXPLANATIONS) -> DataFrame:
    """Adds priority, confidence (3 dp), probabilities map (3 dp),
    positive / negative factor lists."""
    pos, neg = split_signs(F.col(contribs), dictionary)
    lab = F.lit(labels)
    return df.withColumns({
        "priority": lab[F.col(cls)],
        "confidence": F.round(F.col(probs)[F.col(cls)], 3),
        "probabilities": F.map_from_arrays(lab, F.transform(F.col(probs), lambda p: round_keep_sign(p, 3))),
        "positive": pos,
        "negative": neg,
    })


def to_document(key: str = "case_id", raw_features: str | None = "raw_features") -> Column:
    """The nested explanation document (plus the uncategorised text
    contribution, which the reference computes but drops)."""
    meta = [F.col(raw_features).alias("raw_features")] if raw_features else []
    return F.struct(
        F.col(key).cast("string").alias("case_id"),
        F.struct(F.col("priority").alias("priority"), F.col("confidence").alias("confidence"),
                 F.col("probabilities").alias("probabilities")).alias("prediction"),
        F.struct(F.col("positive").alias("positive"), F.col("negative").alias("negative"))
        .alias("feature_contributions"),
        F.struct(F.col("top_tokens").alias("top_tokens"),
                 F.transform_values("semantic_groups", lambda k, v: round_keep_sign(v, 3)).alias("semantic_groups"))
        .alias("text_analysis"),
        F.struct(*meta, F.col("uncategorized").alias("uncategorized")).alias("metadata"),
    )


def _factor(c):
    return F.struct(c["feature"].alias("name"), c["value"].alias("value"),
                    c["contribution"].alias("impact"), c["explanation"].alias("explanation"))


def to_card(key: str = "case_id", n_pos: int = 3, n_neg: int = 2) -> Column:
    """Card projection (top 3 positive, top 2 negative, confidence %)."""
    return F.struct(
        F.struct(F.col(key).cast("string").alias("case_id"), F.col("priority").alias("priority"),
                 FMT.pct("confidence", 0).alias("confidence_pct")).alias("header"),
        F.col("probabilities").alias("probability_chart"),
        F.transform(F.slice("positive", 1, n_pos), _factor).alias("top_positive_factors"),
        F.transform(F.slice("negative", 1, n_neg), _factor).alias("top_negative_factors"),
        F.struct(F.col("top_tokens").alias("top_tokens"),
                 F.transform_values("semantic_groups", lambda k, v: round_keep_sign(v, 3)).alias("semantic_groups"))
        .alias("text_insights"),
    )


def with_importance_fallback(df: DataFrame, importance_top: list[tuple[str, float]],
                             contribs: str = "positive") -> DataFrame:
    """When a case has no factor, show the model's global top
    features instead (a small literal list)."""
    fb = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance"))
                   for f, v in importance_top]) if importance_top else \
        F.array().cast("array<struct<feature:string,importance:double>>")
    return df.withColumn("fallback_factors", F.when(F.size(contribs) == 0, fb))
