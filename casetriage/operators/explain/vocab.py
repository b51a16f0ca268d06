"""Fixed dictionaries of the explanation layer and the operators that use
them directly: keyword extraction (H1) and token -> group mapping (H2).

All dictionaries are parameters; the defaults below are the fixed values of
the reference and are passed to Spark as small literals (no join)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semantic keyword groups (group -> keywords), in declared order.
SEMANTIC_GROUPS = {
    "urgency_keywords": [
        "crash", "urgent", "broken", "down", "emergency", "critical", "asap", "immediately",
        "outage", "unavailable", "dead", "stuck", "blocked", "frozen", "unresponsive",
        "failing", "failed",
    ],
    "financial_keywords": [
        "invoice", "payment", "billing", "refund", "charge", "subscription", "vat", "receipt",
        "pricing", "cost", "fee", "credit", "debit", "transaction", "upgrade", "downgrade",
        "renewal", "cancel",
    ],
    "account_keywords": [
        "login", "password", "access", "permission", "user", "account", "authentication", "sso",
        "2fa", "mfa", "locked", "reset", "credentials", "sign", "register", "activate",
        "deactivate",
    ],
    "technical_keywords": [
        "error", "bug", "api", "sync", "integration", "export", "import", "data", "report",
        "dashboard", "connection", "timeout", "slow", "performance", "loading", "display",
        "render", "configuration",
    ],
}

# Explanation sentence per (feature, value); tenure by tier.
FEATURE_EXPLANATIONS = {
    "channel": {
        "email": "Email channel indicates a non-time-sensitive contact method",
        "webchat": "Webchat indicates the customer expects faster responses",
        "phone": "Phone contact typically signals higher urgency",
        "mobile_app": "Mobile app submissions may indicate on-the-go issues",
    },
    "case_type": {
        "incident": "Incidents typically require faster response times",
        "service_request": "Service requests are generally planned activities",
        "question": "Questions usually have lower urgency",
        "problem": "Problems may indicate systemic issues needing attention",
    },
    "category": {
        "billing_payments": "Billing issues can block business operations",
        "account_admin": "Account administration is usually routine",
        "technical_support": "Technical issues may impact productivity",
        "product_feedback": "Feedback is typically non-urgent",
        "feature_request": "Feature requests are low priority by nature",
        "general_enquiry": "General enquiries are typically informational",
    },
    "plan_tier": {
        "enterprise": "Enterprise customers have SLA commitments",
        "pro": "Pro tier customers expect priority support",
        "standard": "Standard tier follows normal queue priority",
        "free": "Free tier has lowest support priority",
    },
    "customer_tenure_months": {
        "high": "Long-tenured customers are high-value relationships",
        "medium": "Established customer with moderate history",
        "low": "New customer, building relationship",
    },
}

# Speculative phrases flagged in generated text.
SPECULATIVE_PHRASES = [
    "it seems", "probably", "likely that", "might be", "could be", "appears to",
    "suggests that", "we can assume", "it's possible", "based on my knowledge",
    "generally speaking", "in my experience", "typically", "usually",
]

# Test dictionary whose words occur in the generated prose (overrides the default).
FIXTURE_GROUPS = {
    "en": ["the", "and", "that", "is"],
    "function": ["in", "of", "to", "as"],
    "junk": ["worthless"],
    "technical": ["render"],
}


def _kw_array(groups: dict) -> Column:
    return F.array(*[F.struct(F.lit(g).alias("group"), F.lit(k).alias("keyword"))
                     for g, kws in groups.items() for k in kws])


def word_pattern(keyword: str) -> str:
    """Case-insensitive whole-word pattern (Unicode word boundaries)."""
    return r"(?U)\b" + re.escape(keyword.lower()) + r"\b"


def keyword_hits(text_col, keywords: list[str]) -> Column:
    """All of ``keywords`` that the text has as whole words, in one pass over it.

    One alternation, the longest first, is tried at every place (a
    lookahead, so places may overlap).  What it finds there holds every
    shorter keyword that begins at the same place and ends at a word's end."""
    t = F.lower(F.coalesce(F.col(text_col) if isinstance(text_col, str) else text_col, F.lit("")))
    lower = sorted({k.lower() for k in keywords}, key=lambda k: (-len(k), k))
    if not lower:
        return F.array().cast("array<string>")
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?U)(?=\b(" + "|".join(map(re.escape, lower)) + r")\b)"), F.lit(1)))
    within = {k: [x for x in lower if re.match(re.escape(x) + r"\b", k)] for k in lower}
    if all(len(v) == 1 for v in within.values()):
        return found
    closure = F.create_map(*[x for k, v in within.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(found, lambda k: closure[k])))


def extract_keywords(text_col, groups: dict = SEMANTIC_GROUPS) -> Column:
    """H1: map group -> keywords found as whole words (groups with no match
    omitted, keyword order as declared); all groups' keywords are looked for
    in one pass over the text; no shuffle."""
    hits = keyword_hits(text_col, [k for kws in groups.values() for k in kws])
    pairs = F.array(*[F.struct(F.lit(g).alias("key"), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(k.lower()).alias("low")) for k in kws]).alias("kws"))
                      for g, kws in groups.items()])
    held = F.aggregate(F.array(hits), pairs, lambda acc, h: F.transform(acc, lambda g: F.struct(
        g["key"].alias("key"), F.filter(g["kws"], lambda k: F.array_contains(h, k["low"])).alias("kws"))))
    entries = F.transform(F.filter(held, lambda g: F.size(g["kws"]) > 0),
                          lambda g: F.struct(g["key"].alias("key"), F.transform(g["kws"], lambda k: k["k"]).alias("value")))
    return F.map_from_entries(entries)


def token_groups(vocab: DataFrame, groups: dict = SEMANTIC_GROUPS, token_col: str = "term",
                 idx_col: str | None = None) -> DataFrame:
    """H2: (token, group) for every vocabulary token that contains a group
    keyword as a substring (a token can be in several groups, once each).
    The keyword list is an in-row literal, so this is a narrow map + explode
    over the (bounded) vocabulary, not a join."""
    kw = _kw_array(groups)
    keep = [token_col] + ([idx_col] if idx_col else [])
    hits = F.filter(kw, lambda x: F.instr(F.lower(F.col(token_col)), F.lower(x["keyword"])) > 0)
    from ..reshape import explode_array
    return explode_array(vocab, keep, F.array_distinct(F.transform(hits, lambda x: x["group"])), "group")
