"""Array / map -> rows.

``explode`` of a *derived* array makes the optimizer infer a
``size(array) > 0`` filter and push it down below joins and projections,
where the whole array expression is inlined and evaluated again (for a
feature vector or a contribution array that means re-running tokenisation
and the model per row).  The outer generators infer no filter; the empty /
null case is removed after the generator instead, which cannot be pushed
below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_array(df: DataFrame, keep: list, arr: Column | str, value: str = "value",
                  pos: str | None = None) -> DataFrame:
    """One row per element of ``arr`` (no row for empty / null arrays);
    ``pos`` (0-based) is kept when a name is given."""
    a = F.col(arr) if isinstance(arr, str) else arr
    p = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(a).alias(p, value)).filter(F.col(p).isNotNull())
    return out if pos else out.drop(p)


def explode_map(df: DataFrame, keep: list, m: Column | str, key: str = "key",
                value: str = "value") -> DataFrame:
    """One row per map entry (in map order)."""
    mm = F.col(m) if isinstance(m, str) else m
    return (explode_array(df, keep, F.map_entries(mm), "_e")
            .select(*keep, F.col("_e.key").alias(key), F.col("_e.value").alias(value)))
