"""Top-k, samples and in-row rankings.

Global top-k is ``orderBy(...).limit(n)``, which Spark plans as
``TakeOrderedAndProject``: every partition keeps its own n best rows and only
those reach the final merge, so the cost is one scan, no full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import hash_order


def urgent_contacts(preds: DataFrame, n: int = 10, predicted: str = "predicted_priority",
                    key: str = "case_id") -> DataFrame:
    """G1: the n cases with the highest predicted priority; ties broken by
    urgency probability, confidence, then id (deterministic)."""
    order = [F.desc(predicted)]
    if "prob_Urgent" in preds.columns:
        order.append(F.desc("prob_Urgent"))
    if "confidence" in preds.columns:
        order.append(F.desc("confidence"))
    order.append(F.asc(key))
    return preds.orderBy(*order).limit(n)


def head(df: DataFrame, n: int, key: str = "case_id") -> DataFrame:
    """First n rows in key order."""
    return df.orderBy(key).limit(n)


def sample_n(df: DataFrame, n: int, key: str = "case_id", seed: int = 42) -> DataFrame:
    """N rows without replacement, deterministic for a seed.

    Each task keeps its n first rows.  What is computed of the sample stays
    behind the ``coalesce`` (the limit has one partition anyway): pushed below the
    limit, it would hide the order from it, and all rows would be shuffled and sorted."""
    return df.orderBy(hash_order(key, seed), F.col(key)).limit(n).coalesce(1)


def top_abs(arr_col, k: int, value_field: str = "contribution"):
    """G3/G4 in-row: sort an array of structs by |value| descending and keep
    k (stable for equal magnitudes: original order)."""
    return F.slice(sort_abs_desc(arr_col, value_field), 1, k)


def sort_abs_desc(arr_col, value_field: str = "contribution"):
    """Array of structs sorted by |field| descending, stable on ties (the
    position is part of the sort key)."""
    a = arr_col if not isinstance(arr_col, str) else F.col(arr_col)
    indexed = F.transform(a, lambda x, i: F.struct(F.abs(x[value_field]).alias("_k"),
                                                   i.alias("_i"), x.alias("_x")))
    ordered = F.array_sort(indexed, lambda l, r: F.when(l["_k"] > r["_k"], -1)
                           .when(l["_k"] < r["_k"], 1)
                           .otherwise(l["_i"] - r["_i"]))
    return F.transform(ordered, lambda s: s["_x"])


def probs_long(df: DataFrame, labels: list[str], prob_cols: list[str],
               key: str = "case_id") -> DataFrame:
    """Zip labels and probabilities into a map, then explode to rows."""
    m = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]),
                          F.array(*[F.col(c) for c in prob_cols]))
    return df.select(key, F.explode(m).alias("class", "probability"))
