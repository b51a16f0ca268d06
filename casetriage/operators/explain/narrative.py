"""Narrative text, prompts and grounding checks (K1-K7, H6, H7).

Texts are assembled with built-in string/array expressions from the
document columns (priority, confidence, probabilities, positive, negative,
top_tokens, semantic_groups); only number -> text rendering uses the
formatting helper.  Helper columns holding formatted numbers are added
first so that the array lambdas only reference plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions import formatting as FMT
from ...functions.scalar import round_keep_sign
from ...functions.scalar import humanise, spaced, trim_ws
from .vocab import SPECULATIVE_PHRASES

# Prompt templates ({context}, {case_id}, {priority}, {factors}).
SYSTEM_PROMPT = """You are an explanation assistant for a customer support priority classification system.

CRITICAL RULES - YOU MUST FOLLOW THESE EXACTLY:
1. ONLY use information explicitly provided in the data below
2. NEVER invent, assume, or speculate about information not provided
3. NEVER mention specific customer names, dates, or details not in the data
4. If a value is missing or unclear, say "information not available"
5. Use professional, neutral language suitable for business reports
6. Keep explanations concise (2-4 sentences for summary)

Your task is to explain WHY the model predicted a specific priority level based on the contributing factors provided."""

EXPLANATION_PROMPT_TEMPLATE = """Based on the following model output, write a brief natural language explanation of why this case was classified with this priority level.

=== MODEL OUTPUT DATA (GROUND TRUTH - USE ONLY THIS) ===
{context}
=== END OF DATA ===

Write a 2-4 sentence explanation that:
1. States the predicted priority and confidence level
2. Lists the top 2-3 factors that most strongly influenced this prediction
3. Mentions any text patterns that contributed (if significant)

DO NOT include:
- Information not present in the data above
- Speculation about the customer or their situation
- Recommendations or next steps
- Phrases like "it seems" or "probably" or "likely"

Explanation:"""

SUMMARY_PROMPT_TEMPLATE = """Create a one-sentence summary of why case {case_id} was classified as {priority} priority.

Key factors:
{factors}

Write exactly ONE sentence that captures the main reason for this classification.
Use only the factors provided above. Do not add any information.

Summary:"""


def _v(c) -> Column:
    return F.coalesce(c["value"], F.lit("None"))


def with_number_text(df: DataFrame) -> DataFrame:
    """Formatted numbers used by the narratives (one helper pass)."""
    contrib = lambda arr: F.transform(F.col(arr), lambda c: c["contribution"])
    return df.withColumns({
        "_conf0": FMT.fixed(F.col("confidence") * 100, 0),
        "_conf1": FMT.fixed(F.col("confidence") * 100, 1),
        "_probs1": FMT.fixed_array(F.transform(F.map_values("probabilities"), lambda p: p * 100), 1),
        "_pos3": FMT.fixed_array(contrib("positive"), 3),
        "_neg3": FMT.fixed_array(contrib("negative"), 3),
        "_pos2": FMT.fixed_array(contrib("positive"), 2),
        "_neg2": FMT.fixed_array(contrib("negative"), 2),
        "_tok3": FMT.fixed_array(contrib("top_tokens"), 3),
        "_grp3": FMT.fixed_array(F.map_values(F.transform_values(
            "semantic_groups", lambda k, v: round_keep_sign(v, 3))), 3),
    })


NUMBER_TEXT_COLS = ["_conf0", "_conf1", "_probs1", "_pos3", "_neg3", "_pos2", "_neg2", "_tok3", "_grp3"]


def narrate() -> Column:
    """K1: template explanation (needs ``with_number_text``)."""
    first = F.concat(F.lit("This case has been classified as **"), F.col("priority"),
                     F.lit("** priority with "), F.col("_conf0"), F.lit("% confidence."))
    parts = F.transform(F.slice("positive", 1, 3),
                        lambda f: F.concat(spaced(f["feature"]), F.lit(" ("), _v(f), F.lit(")")))
    has_pos = F.size("positive") > 0
    factors = F.when(has_pos, F.concat(F.lit("The main contributing factors are: "),
                                       F.array_join(parts, ", "), F.lit(".")))
    top = F.when(has_pos, F.concat(F.col("positive")[0]["explanation"], F.lit(".")))
    rounded = F.transform_values("semantic_groups", lambda k, v: round_keep_sign(v, 3))
    themes = F.filter(F.map_entries(rounded), lambda e: e["value"] > 0.05)
    theme = F.when(F.size(themes) > 0, F.concat(F.lit("The case text shows "),
                                                spaced(themes[0]["key"]), F.lit(" patterns.")))
    return F.concat_ws(" ", first, factors, top, theme)


def summarise() -> Column:
    """K2: one-line summary with the no-factor fallback."""
    top = F.col("positive")[0]
    return F.when(F.size("positive") > 0,
                  F.concat(F.lit("Classified as "), F.col("priority"),
                           F.lit(" priority primarily due to "), spaced(top["feature"]),
                           F.lit(" ("), _v(top), F.lit(").")))\
        .otherwise(F.concat(F.lit("Classified as "), F.col("priority"),
                            F.lit(" priority based on overall case characteristics.")))


def _section(cond: Column, header: list[str], body: Column) -> Column:
    return F.when(cond, F.concat(F.array(*[F.lit(h) for h in header]), body)) \
        .otherwise(F.array().cast("array<string>"))


def prompt_context(key: str = "case_id") -> Column:
    """K3: grounding context text (needs ``with_number_text``)."""
    head = F.array(F.concat(F.lit("Case ID: "), F.col(key).cast("string")),
                   F.concat(F.lit("Predicted Priority: "), F.col("priority")),
                   F.concat(F.lit("Confidence: "), F.col("_conf1"), F.lit("%")),
                   F.lit(""), F.lit("Class Probabilities:"))
    probs = F.transform(F.map_keys("probabilities"),
                        lambda k, i: F.concat(F.lit("  - "), k, F.lit(": "), F.col("_probs1")[i], F.lit("%")))
    pos = F.flatten(F.transform(F.slice("positive", 1, 5), lambda c, i: F.array(
        F.concat(F.lit("  - "), c["feature"], F.lit("="), _v(c), F.lit(": +"), F.col("_pos3")[i]),
        F.concat(F.lit("    Reason: "), c["explanation"]))))
    neg = F.flatten(F.transform(F.slice("negative", 1, 3), lambda c, i: F.array(
        F.concat(F.lit("  - "), c["feature"], F.lit("="), _v(c), F.lit(": "), F.col("_neg3")[i]),
        F.concat(F.lit("    Reason: "), c["explanation"]))))
    toks = F.transform(F.slice("top_tokens", 1, 5), lambda t, i: F.concat(
        F.lit('  - "'), t["token"], F.lit('": '),
        F.when(t["contribution"] > 0, F.lit("+")).otherwise(F.lit("")), F.col("_tok3")[i]))
    rounded = F.map_entries(F.transform_values("semantic_groups", lambda k, v: round_keep_sign(v, 3)))
    grp = F.filter(F.transform(rounded, lambda e, i: F.when(
        F.abs(e["value"]) > 0.01,
        F.concat(F.lit("  - "), e["key"], F.lit(": "),
                 F.when(e["value"] > 0, F.lit("+")).otherwise(F.lit("")), F.col("_grp3")[i]))),
        lambda x: x.isNotNull())
    lines = F.concat(
        head, probs, F.array(F.lit(""), F.lit("Positive Contributing Factors:")), pos,
        _section(F.size("negative") > 0, ["", "Negative Contributing Factors:"], neg),
        _section(F.size("top_tokens") > 0, ["", "Key Text Tokens:"], toks),
        _section(F.size(F.map_keys("semantic_groups")) > 0, ["", "Semantic Theme Contributions:"], grp))
    return F.array_join(lines, "\n")


def factor_list() -> Column:
    """K5: bulleted factors (4 positive, 2 negative) with a counterbalancing
    intro, outer whitespace stripped (needs ``with_number_text``)."""
    pos = F.flatten(F.transform(F.slice("positive", 1, 4), lambda f, i: F.array(
        F.concat(F.lit("• "), humanise(f["feature"]), F.lit(": "), _v(f), F.lit(" (+"),
                 F.col("_pos2")[i], F.lit(")")),
        F.concat(F.lit("  → "), f["explanation"]))))
    neg = F.flatten(F.transform(F.slice("negative", 1, 2), lambda f, i: F.array(
        F.concat(F.lit("• "), humanise(f["feature"]), F.lit(": "), _v(f), F.lit(" ("),
                 F.col("_neg2")[i], F.lit(")")),
        F.concat(F.lit("  → "), f["explanation"]))))
    intro = F.when(F.size(neg) > 0, F.lit("\nCounterbalancing factors:")).otherwise(F.lit(""))
    text = F.concat(F.lit("Factors contributing to "), F.col("priority"), F.lit(" priority:\n"),
                    F.array_join(pos, "\n"), F.lit("\n\n"), intro, F.lit("\n"), F.array_join(neg, "\n"))
    return trim_ws(text)


def explanation_prompt(context: Column) -> Column:
    """K4: the explanation prompt around a context text."""
    pre, post = EXPLANATION_PROMPT_TEMPLATE.split("{context}")
    return F.concat(F.lit(pre), context, F.lit(post))


def summary_prompt(key: str = "case_id") -> Column:
    """K4: the summary prompt over the top-3 positive factors."""
    factors = F.array_join(F.transform(F.slice("positive", 1, 3), lambda f: F.concat(
        F.lit("- "), f["feature"], F.lit("="), _v(f), F.lit(": "), f["explanation"])), "\n")
    a, rest = SUMMARY_PROMPT_TEMPLATE.split("{case_id}")
    b, rest = rest.split("{priority}")
    c, d = rest.split("{factors}")
    return F.concat(F.lit(a), F.col(key).cast("string"), F.lit(b), F.col("priority"), F.lit(c),
                    factors, F.lit(d))


def check_grounding(text: Column, priority: Column, case_id: Column, features: Column,
                    phrases: list[str] = SPECULATIVE_PHRASES) -> Column:
    """K6: struct(is_valid, warnings) for a generated text.  ``features``
    is the array of positive factor names in rank order (first 3 checked)."""
    low = F.lower(F.coalesce(text, F.lit("")))
    spec = [F.when(F.instr(low, p) > 0, F.lit(f"Speculative language detected: '{p}'")) for p in phrases]
    prio = F.when((F.coalesce(priority, F.lit("")) != "") & (F.instr(low, F.lower(priority)) == 0),
                  F.concat(F.lit("Generated text doesn't mention predicted priority: "), priority))
    cid = F.when((F.coalesce(case_id, F.lit("")) != "") & (F.instr(low, "nd-") > 0)
                 & (F.instr(low, F.lower(case_id)) == 0),
                 F.lit("Case ID mentioned but doesn't match source data"))
    top3 = F.slice(F.coalesce(features, F.array().cast("array<string>")), 1, 3)
    mentioned = F.exists(top3, lambda f: F.instr(low, F.lower(F.regexp_replace(f, "_", " "))) > 0)
    feat = F.when((F.size(top3) > 0) & ~mentioned, F.lit("No source features mentioned in explanation"))
    warnings = F.filter(F.array(*spec, prio, cid, feat), lambda w: w.isNotNull())
    return F.struct((F.size(warnings) == 0).alias("is_valid"), warnings.alias("warnings"))


def resolve_text(generated: Column, validation: Column, template: Column,
                 policy: str = "strict") -> Column:
    """K7: strict -> invalid text falls back to the template (warnings
    kept); permissive -> keep the text and attach the warnings."""
    ok = validation["is_valid"]
    if policy == "strict":
        text = F.when(generated.isNotNull() & ok, generated).otherwise(template)
        source = F.when(generated.isNotNull() & ok, F.lit("llm")).otherwise(F.lit("template"))
    else:
        text = F.coalesce(generated, template)
        source = F.when(generated.isNotNull(), F.lit("llm")).otherwise(F.lit("template"))
    return F.struct(text.alias("explanation"), source.alias("source"),
                    validation["warnings"].alias("warnings"))
