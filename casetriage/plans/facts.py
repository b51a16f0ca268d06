"""Value checks of trained-model queries: facts about every row that SQL can state.

A trained model's numbers have no SQL twin, but what must hold for each row
has: which cases are scored, that probabilities form a distribution, that the
prediction is their maximum, that contributions add up, that a reloaded model
and the stream agree with the batch.  Each query computes the fact from the
real outputs; its oracle lists the rows with the fact being true.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import PRIORITY_LEVELS
from .oracle import ORACLE, _cte, _split_sql
from ..operators.tuning import DT_SPACE
from .queries import (QUERIES, RF, SOURCE_FEATURES, TRIALS, _dt_trials, _scored, _triage, q_dt_scored, q_explain_batch_lr, q_explain_dispatch, q_global_importance_lr,
                      q_global_importance_rf,
                      q_model_roundtrip, q_score_all, q_shap_coalitions, q_shap_sampled, q_shap_tree, q_stream_latest, q_stream_scored,
                      q_variant_b_scored)

EPS = 1e-9


def _probability_facts(df: DataFrame, keep: list[str]) -> DataFrame:
    p = F.array(*[F.col(f"prob_{x}") for x in PRIORITY_LEVELS])
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return df.select(
        *keep, ((F.abs(total - 1) < EPS) & (F.array_min(p) >= 0)).alias("probs_ok"),
        (p[F.col("predicted_priority").cast("int")] == F.array_max(p)).alias("argmax_ok"),
        (F.abs(F.col("confidence") - F.array_max(p)) < EPS).alias("confidence_ok"))


def _scored_facts(kind: str, **kw):
    return lambda spark, d: _probability_facts(_scored(spark, d, kind, **kw), ["case_id", "split"])


def q_variant_b_facts(spark, d):
    return _probability_facts(q_variant_b_scored(spark, d), ["case_id", "split"])


def q_score_all_facts(spark, d):
    return _probability_facts(q_score_all(spark, d), ["model", "case_id"])


def q_explain_batch_facts(spark, d):
    """Base value plus contributions is the margin, with a theme and a narrative for every case."""
    return q_explain_batch_lr(spark, d).select(
        "case_id", (F.abs(F.col("reconstructed") - F.col("margin")) < EPS).alias("additive"),
        (F.length("narrative") > 0).alias("narrated"))


def q_explain_dispatch_facts(spark, d):
    return q_explain_dispatch(spark, d).select("model", "case_id", "explainer",
                                               (F.abs(F.col("reconstructed") - F.col("fx")) < EPS).alias("additive"))


def q_shap_tree_facts(spark, d):
    return q_shap_tree(spark, d).select(
        "case_id", (F.abs(F.col("reconstructed") - F.col("fx")) < EPS).alias("additive"),
        (F.abs(F.col("fx") - F.col("model_prob")) < EPS).alias("is_model_prob"))


def q_shap_sampled_facts(spark, d):
    s = q_shap_sampled(spark, d).groupBy("case_id").agg(
        F.count("*").alias("n_features"), F.sum("phi").alias("phi"), F.first("base_value").alias("b"), F.first("fx").alias("fx"))
    return s.select("case_id", "n_features", (F.abs(F.col("b") + F.col("phi") - F.col("fx")) < EPS).alias("additive"))


def q_model_roundtrip_facts(spark, d):
    return q_model_roundtrip(spark, d).select("case_id", "same")


def _stream_facts(spark, d, stream):
    batch = _scored(spark, d, "lr", ("new",)).select("case_id", F.col("predicted_priority").alias("p"), F.col("confidence").alias("c"))
    same = ~F.col("is_valid") & F.col("predicted_priority").isNull() | F.col("is_valid") & (F.col("predicted_priority") == F.col("p")) & (
        F.abs(F.col("confidence") - F.col("c")) <= 0.0005 + EPS)
    return stream.join(batch, "case_id").select("case_id", F.col("version").cast("int"), same.alias("as_batch"))


def q_stream_facts(spark, d):
    """The stream keeps one row of every new case, of its latest version, equal to the batch's prediction (confidences have three digits)."""
    return _stream_facts(spark, d, q_stream_scored(spark, d))


def q_stream_latest_facts(spark, d):
    """The same of the rows kept in the stream's state."""
    return _stream_facts(spark, d, q_stream_latest(spark, d))


def q_shap_coalitions_facts(spark, d):
    s = q_shap_coalitions(spark, d).groupBy("case_id").agg(
        F.count("*").alias("n_features"), F.sum("phi").alias("phi"), F.first("base_value").alias("b"), F.first("fx").alias("fx"))
    own = _scored(spark, d, "lr", ("test",)).select("case_id", "confidence")
    return s.join(own, "case_id").select("case_id", "n_features", (F.abs(F.col("b") + F.col("phi") - F.col("fx")) < EPS).alias("additive"),
                                         (F.abs(F.col("fx") - F.col("confidence")) < EPS).alias("is_model_prob"))


def q_tune_facts(spark, d):
    """Every trial lies in the search ranges, no two are alike, and its score is between a constant answer's and 1."""
    trials = _dt_trials(spark, d)
    rows = []
    for i, (p, f1) in enumerate(trials):
        inside = all(p[n] in r if isinstance(r, list) else r[0] <= p[n] <= r[1] for n, r in DT_SPACE.items() if n != "weightCol")
        rows.append((i, inside, sum(q == p for q, _ in trials) == 1, bool(0 < f1 <= 1)))
    return spark.createDataFrame(rows, "trial int, in_ranges boolean, different boolean, f1_ok boolean")


def q_importance_facts(spark, d):
    """Global importance of LR and forest: every feature once, none negative, and the values of a plain mean over rows."""
    from ..operators import ranking as R
    from ..operators.explain import linear as L
    from ..operators.explain.tree import shap_tree
    from ..operators.reshape import explode_array
    from ..session import scratch_path
    from .explain import BACKGROUND, lr_explainer
    out = None
    lr, ex, _ = lr_explainer(spark, d)
    rf = _triage(spark, d, "rf", **RF)
    rows = {"lr": L.shap_all_classes_abs_mean(R.sample_n(lr.train, BACKGROUND), ex).select("abs_phi")}
    classes = explode_array(R.sample_n(rf.train, BACKGROUND), ["case_id", "features"], F.array(*map(F.lit, range(4))), "c")
    rows["rf"] = shap_tree(spark, classes, rf.model, scratch_path(spark, "rf-check"), pred_col="c").select(
        F.transform("phi", lambda v: F.abs(v)).alias("abs_phi"))
    for name, got in (("lr", q_global_importance_lr(spark, d)), ("rf", q_global_importance_rf(spark, d))):
        names = lr.space.names_df(spark).select("idx", F.col("name").alias("feature"))
        plain = explode_array(rows[name], [], "abs_phi", "v", "idx").groupBy("idx").agg(F.avg("v").alias("plain"))
        one = got.join(names, "feature").join(plain, "idx").agg(
            F.count("*").alias("n"), F.min("importance").alias("low"), F.max(F.abs(F.col("importance") - F.col("plain"))).alias("off"))
        one = one.select(F.lit(name).alias("model"), (F.col("n") == len(lr.space.names)).alias("all_features"), (F.col("low") >= 0).alias("none_negative"),
                         (F.col("off") < EPS).alias("as_plain_mean"))
        out = one if out is None else out.union(one)
    return out


def q_gradient_facts(spark, d):
    """Importances: all features of the forest, none negative, with the sum of 1; coefficients: all finite."""
    from ..operators import models as M
    lr, rf = _triage(spark, d, "lr"), _triage(spark, d, "rf", **RF)
    imp = M.tree_importance(spark, rf.model, rf.space, None).agg(
        F.lit("importance").alias("what"), ((F.abs(F.sum("importance") - 1) < EPS) & (F.min("importance") >= 0)).alias("ok"))
    co = M.coefficients(spark, lr.model, lr.space)
    cols = [F.col(f"coef_{x}") for x in PRIORITY_LEVELS]
    mean = sum(cols[1:], cols[0])  # the penalised multinomial solution has coefficients that sum to zero over the classes
    fact = co.where("idx >= 0").agg(F.lit("coefficients").alias("what"), (F.max(F.abs(mean)) < 1e-6).alias("ok"))
    return imp.union(fact)


QUERIES.update({
    "lr_scored_facts": _scored_facts("lr"),
    "dt_scored_facts": lambda spark, d: _probability_facts(q_dt_scored(spark, d), ["case_id", "split"]),
    "rf_scored_facts": _scored_facts("rf", **RF),
    "variant_b_facts": q_variant_b_facts,
    "score_all_facts": q_score_all_facts,
    "explain_batch_facts": q_explain_batch_facts,
    "explain_dispatch_facts": q_explain_dispatch_facts,
    "shap_tree_facts": q_shap_tree_facts,
    "shap_sampled_facts": q_shap_sampled_facts,
    "shap_coalitions_facts": q_shap_coalitions_facts,
    "model_roundtrip_facts": q_model_roundtrip_facts,
    "stream_facts": q_stream_facts,
    "stream_latest_facts": q_stream_latest_facts,
    "tune_facts": q_tune_facts,
    "model_sums_facts": q_gradient_facts,
    "importance_facts": q_importance_facts,
})


def _rows(body: str) -> str:
    return _cte(("cases",), _split_sql() + """,
test AS (SELECT case_id, 'test' AS split FROM split WHERE split = 'test'),
fresh AS (SELECT case_id, channel FROM cases WHERE priority IS NULL),
scored AS (SELECT case_id, split FROM test UNION ALL SELECT case_id, 'new' FROM fresh)""", body)


_PROB = "true AS probs_ok, true AS argmax_ok, true AS confidence_ok"
for _name in ("lr_scored_facts", "dt_scored_facts", "rf_scored_facts"):
    ORACLE[_name] = _rows(f"SELECT case_id, split, {_PROB} FROM scored")
ORACLE["variant_b_facts"] = _rows(f"SELECT case_id, split, {_PROB} FROM test")
ORACLE["score_all_facts"] = _rows(f"""
SELECT m.model, case_id, {_PROB} FROM test, (VALUES ('Logistic Regression'), ('Decision Tree'), ('Random Forest')) m(model)""")
ORACLE["explain_batch_facts"] = _rows("SELECT case_id, true AS additive, true AS narrated FROM scored")
ORACLE["explain_dispatch_facts"] = _rows("""
SELECT m.model, case_id, m.explainer, true AS additive
FROM test, (VALUES ('lr', 'linear'), ('dt', 'tree'), ('rf', 'tree'), ('vote', 'agnostic'), ('stack', 'agnostic')) m(model, explainer)""")
ORACLE["shap_tree_facts"] = _rows("SELECT case_id, true AS additive, true AS is_model_prob FROM test")
ORACLE["shap_sampled_facts"] = _rows(f"SELECT case_id, {len(SOURCE_FEATURES)} AS n_features, true AS additive FROM test")
ORACLE["model_roundtrip_facts"] = _rows("SELECT case_id, true AS same FROM test")
ORACLE["stream_facts"] = ORACLE["stream_latest_facts"] = _rows(
    "SELECT case_id, CASE WHEN channel = 'email' THEN 2 ELSE 1 END AS version, true AS as_batch FROM fresh")
ORACLE["shap_coalitions_facts"] = _rows(
    f"SELECT case_id, {len(SOURCE_FEATURES)} AS n_features, true AS additive, true AS is_model_prob FROM test")
ORACLE["tune_facts"] = f"SELECT CAST(i AS INTEGER) AS trial, true AS in_ranges, true AS different, true AS f1_ok FROM range({TRIALS}) t(i)"
ORACLE["model_sums_facts"] = "SELECT * FROM (VALUES ('importance', true), ('coefficients', true)) v(what, ok)"
ORACLE["importance_facts"] = """
SELECT m AS model, true AS all_features, true AS none_negative, true AS as_plain_mean FROM (VALUES ('lr'), ('rf')) v(m)"""
