"""casetriage — Spark-native support-case triage: cleaning, profiling,
features, classifiers, explanations and streaming scoring as DataFrame
operators (DataFrame in, DataFrame out)."""

__version__ = "0.1.0"

# Public surface (L5): import the operator modules from here.
__all__ = [
    "session",
    "sources",      # readers (A1-A9), fixtures
    "functions",    # scalar column functions, number formatting
    "operators",    # cleaning, profiling, splits, features, models, tuning, evaluation, ranking, explain
    "plans",        # flagship, explain plans, query registry
    "streaming",    # score_stream, latest_scores
]
