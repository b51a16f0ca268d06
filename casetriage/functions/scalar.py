"""Column-level (row-local) functions.  All built-in expressions, no UDFs,
so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference: class order Low < Medium < High < Urgent = 0..3.
PRIORITY_LEVELS = ["Low", "Medium", "High", "Urgent"]

# Tenure tier thresholds (months) — below 6 is low, above 24 is high.
TENURE_LOW_BELOW = 6
TENURE_HIGH_ABOVE = 24

# Gender recode groups.
GENDER_MALE = ["m", "male"]
GENDER_FEMALE = ["f", "female"]
GENDER_NONBINARY = ["nb", "non-binary", "nonbinary", "non binary"]

# Allowed options for incoming cases, tenure range 0..240.
VALID_OPTIONS = {
    "channel": ["email", "phone", "webchat", "mobile_app"],
    "case_type": ["incident", "service_request", "question", "problem"],
    "category": ["billing_payments", "account_admin", "technical_support", "product_feedback",
                 "feature_request", "general_enquiry"],
    "plan_tier": ["free", "standard", "pro", "enterprise"],
}
TENURE_MIN, TENURE_MAX = 0, 240


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_const(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            return f"double('{v}')"
        return f"{v!r}D"  # shortest round-trip text: parses back to the same double
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(_sql_const(x) for x in v) + ")"
    if hasattr(v, "item"):  # numpy scalar
        return _sql_const(v.item())
    raise TypeError(f"no SQL constant for {type(v).__name__}")


def const_array(values) -> Column:
    """A (nested) constant array as one expression.

    ``F.lit(list)`` builds the array element by element, one JVM call each;
    model-sized constants (coefficient matrices, slot names) then cost
    seconds of driver time per plan.  One parsed expression costs one
    call.  Same values and types as ``F.lit``."""
    return F.expr(_sql_const(list(values)))


def trim_ws(c) -> Column:
    """Strip leading/trailing whitespace of any kind (pandas ``str.strip``);
    Spark's ``trim`` strips spaces only."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def norm_lower(c) -> Column:
    """Trim + lower."""
    return F.lower(trim_ws(c))


def norm_title(c) -> Column:
    """Trim + title case."""
    return F.initcap(F.lower(trim_ws(c)))


def to_ts(c) -> Column:
    """Coercing timestamp parse, bad input -> null."""
    return F.try_to_timestamp(_c(c).cast("string"))


def to_num(c) -> Column:
    """Coercing numeric parse, bad input -> null."""
    return _c(c).try_cast("double")


def sla_met(res="resolution_time_hours", sla="sla_target_hours") -> Column:
    """Resolution within SLA; a null comparison counts as not met."""
    return F.coalesce(_c(res) <= _c(sla), F.lit(False))


def clean_gender(c="gender") -> Column:
    """Recode to Male/Female/Non-Binary, everything else null."""
    g = norm_lower(c)
    return (F.when(g.isin(GENDER_MALE), "Male")
            .when(g.isin(GENDER_FEMALE), "Female")
            .when(g.isin(GENDER_NONBINARY), "Non-Binary"))


def encode_priority(c="priority") -> Column:
    """Label -> 0..3, unmapped -> null."""
    m = F.create_map(*[x for i, p in enumerate(PRIORITY_LEVELS) for x in (F.lit(p), F.lit(i))])
    return m[_c(c)]


def decode_priority(c) -> Column:
    """B16 inverse: 0..3 -> label."""
    return F.array(*[F.lit(p) for p in PRIORITY_LEVELS])[_c(c).cast("int")]


def priority_rank(c="priority", unknown: int = 99) -> Column:
    """G5 sort key: Low..Urgent = 0..3, anything else last."""
    return F.coalesce(encode_priority(c), F.lit(unknown))


def tenure_tier(c="customer_tenure_months") -> Column:
    """H4: <6 low, >24 high, else (incl. null / non-numeric) medium."""
    x = _c(c).try_cast("double")
    return (F.when(x < TENURE_LOW_BELOW, "low").when(x > TENURE_HIGH_ABOVE, "high")
            .otherwise("medium"))


def humanise(c) -> Column:
    """H6: underscores to spaces, Title Case."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


def spaced(c) -> Column:
    """Underscores to spaces (no case change)."""
    return F.regexp_replace(_c(c), "_", " ")


def fmt_pct(c, dp: int = 0) -> Column:
    """H7: fraction -> 'NN%' with ``dp`` decimals."""
    return F.concat(F.format_string(f"%.{dp}f", _c(c) * 100), F.lit("%"))


def fmt_signed(c, dp: int = 3) -> Column:
    """H7: '%+.3f'."""
    return F.format_string(f"%+.{dp}f", _c(c))


def with_calendar_cols(ts="created_at"):
    """Hour of day and English day name."""
    return {"hour": F.hour(_c(ts)), "day_of_week": F.date_format(_c(ts), "EEEE")}


def validation_reasons(channel="channel", case_type="case_type", plan_tier="plan_tier",
                       tenure="customer_tenure_months", summary="case_summary") -> Column:
    """List of reasons an incoming case is invalid (empty = valid)."""
    t = _c(tenure).try_cast("double")
    checks = [
        F.when(~F.coalesce(norm_lower(channel).isin(VALID_OPTIONS["channel"]), F.lit(False)),
               F.lit("invalid channel")),
        F.when(~F.coalesce(norm_lower(case_type).isin(VALID_OPTIONS["case_type"]), F.lit(False)),
               F.lit("invalid case_type")),
        F.when(~F.coalesce(norm_lower(plan_tier).isin(VALID_OPTIONS["plan_tier"]), F.lit(False)),
               F.lit("invalid plan_tier")),
        F.when(t.isNull() | (t < TENURE_MIN) | (t > TENURE_MAX), F.lit("tenure out of range")),
        F.when(F.coalesce(trim_ws(summary), F.lit("")) == "", F.lit("empty summary")),
    ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def round_keep_sign(c, dp: int = 3) -> Column:
    """Round to ``dp`` decimals keeping the sign of a value that rounds to
    zero (-0.0003 -> -0.0, as the reference's rounding does); Spark's
    ``round`` returns +0.0 there, which prints differently."""
    x = _c(c)
    r = F.round(x, dp)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)
