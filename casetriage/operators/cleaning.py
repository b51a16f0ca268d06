"""Cleaning, projection and de-duplication operators (B*, C1-C4)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import scalar as S

# Leakage columns that must not reach a model.
LEAKAGE_COLUMNS = [
    "first_response_time_hours", "resolution_time_hours", "escalated", "assigned_team",
    "escalation_team", "gender", "resolution_code",
]

# The model-data projection of the cleaned extract.
MODEL_COLUMNS = ["case_id", "case_summary", "created_at", "channel", "case_type",
                 "category", "plan_tier", "customer_tenure_months", "priority"]

CATEGORICAL_COLUMNS = ["channel", "case_type", "category", "plan_tier"]


def select_existing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def drop_leakage(df: DataFrame, cols: Iterable[str] = LEAKAGE_COLUMNS) -> DataFrame:
    """B2: drop post-outcome columns (missing ones are ignored)."""
    return df.drop(*list(cols))


def drop_blank(df: DataFrame, col: str = "age_band") -> DataFrame:
    """Drop rows whose value is null or whitespace-only."""
    return df.filter(F.col(col).isNotNull() & (S.trim_ws(F.col(col).cast("string")) != ""))


def fill_text(df: DataFrame, col: str = "case_summary") -> DataFrame:
    """Null text -> ''."""
    return df.fillna({col: ""})


def filter_priority(df: DataFrame, values: list[str] | None, col: str = "priority") -> DataFrame:
    """Membership filter; an empty list means no filter."""
    return df.filter(F.col(col).isin(list(values))) if values else df


def order_by_priority(df: DataFrame, col: str = "priority", descending: bool = False,
                      key: str = "case_id") -> DataFrame:
    """Order by the custom ordinal Low..Urgent, unknown last; ties by
    ``key``, which also lets the range partitioning split a priority that
    holds most rows."""
    k = S.priority_rank(col)
    return df.orderBy(k.desc() if descending else k.asc(), *([key] if key in df.columns else []))


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row distinct (hash aggregate with map-side partial
    aggregation, so heavily duplicated rows collapse before the shuffle)."""
    return df.distinct()


def union_months(dfs: list[DataFrame]) -> DataFrame:
    """Bag union by column name, tolerating missing columns."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def dedup_latest(df: DataFrame, key: str = "case_id",
                 order_cols: tuple[str, ...] = ("file_seq", "row_seq")) -> DataFrame:
    """Keep the most recent version of every key.

    Written as an aggregation (``max_by`` over the ordering struct) rather
    than a ``row_number`` window: the aggregate combines map-side, so a hot
    key with millions of versions is reduced in every input partition before
    the shuffle instead of being sorted in one task.
    """
    rest = [c for c in df.columns if c != key]
    latest = F.max_by(F.struct(*[F.col(c) for c in rest]),
                      F.struct(*[F.col(c) for c in order_cols]))
    return df.groupBy(key).agg(latest.alias("_v")).select(key, *[f"_v.{c}" for c in rest])


def clean_cases(df: DataFrame, key: str = "case_id",
                order_cols: tuple[str, ...] = ("file_seq", "row_seq")) -> DataFrame:
    """Reference cleaning path A: keep-last per case, coerce types,
    normalise text, encode the label and drop unmapped labels."""
    d = dedup_latest(df, key, order_cols)
    cols = {}
    if "created_at" in d.columns:
        cols["created_at"] = S.to_ts("created_at")
    if "priority" in d.columns:
        cols["priority"] = S.norm_title("priority")
    if "case_summary" in d.columns:
        cols["case_summary"] = S.norm_lower("case_summary")
    if "customer_tenure_months" in d.columns:
        cols["customer_tenure_months"] = S.to_num("customer_tenure_months")
    for c in CATEGORICAL_COLUMNS:
        if c in d.columns:
            cols[c] = S.norm_lower(c)
    d = d.withColumns(cols)
    d = d.withColumn("priority_encoded", S.encode_priority("priority"))
    return d.dropna(subset=["priority_encoded"])


def with_gender_clean(df: DataFrame, col: str = "gender") -> DataFrame:
    """B15 as a column."""
    return df.withColumn("gender_clean", S.clean_gender(col)) if col in df.columns else df


def with_calendar(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Hour and day name of the creation timestamp."""
    return df.withColumns(S.with_calendar_cols(ts))


def validate_cases(df: DataFrame, options: dict[str, list[str]] = S.VALID_OPTIONS) -> DataFrame:
    """``is_valid`` and ``reasons`` for incoming cases; checks only the
    columns that are present.  ``options`` lists the accepted values."""
    checks = []
    t = None
    for c in options:
        if c in df.columns:
            ok = F.coalesce(S.norm_lower(c).isin(options[c]), F.lit(False))
            checks.append(F.when(~ok, F.lit(f"invalid {c}")))
    if "customer_tenure_months" in df.columns:
        t = F.col("customer_tenure_months").try_cast("double")
        checks.append(F.when(t.isNull() | (t < S.TENURE_MIN) | (t > S.TENURE_MAX),
                             F.lit("tenure out of range")))
    if "case_summary" in df.columns:
        checks.append(F.when(F.coalesce(S.trim_ws("case_summary"), F.lit("")) == "",
                             F.lit("empty summary")))
    reasons = F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else \
        F.array().cast("array<string>")
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def numeric_cols(df: DataFrame) -> list[str]:
    """Numeric columns by type (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def round_cols(df: DataFrame, cols: Iterable[str], dp: int = 3) -> DataFrame:
    """Fixed-decimal rounding."""
    return df.withColumns({c: F.round(F.col(c), dp) for c in cols})


def load_report(raw: DataFrame, key: str = "case_id", file_col: str = "file_seq") -> DataFrame:
    """C4: rows loaded, unique cases after keep-last, rows removed, files.

    One aggregation pass over the raw rows; the keep-last result has
    exactly one row per distinct key (nulls form one group)."""
    agg = raw.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        (F.count_distinct(key) + F.max(F.col(key).isNull().cast("int"))).alias("after_dedup"),
        F.count_distinct(file_col).alias("files_loaded"),
    )
    return agg.select(
        "files_loaded", "initial_rows", "after_dedup",
        (F.col("initial_rows") - F.col("after_dedup")).alias("rows_removed"))
