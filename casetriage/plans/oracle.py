"""Oracle SQL (DuckDB dialect) for the registered queries.

Each text starts from the same fixture views as the Spark query (as CTEs)
and states the operator's semantics independently in plain SQL.
"""

from __future__ import annotations

from ..sources.fixtures import with_views

TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
PRIO_CODE = ("CASE {x} WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 "
             "WHEN 'Urgent' THEN 3 END")
HASH = "md5('42-' || CAST({k} AS VARCHAR))"


def trim(x: str) -> str:
    return TRIM.format(x=x)


def _metrics_sql(source: str, group: str | None, dp: int | None, focus: int = 3) -> str:
    """Per-class counters -> precision/recall/F1 -> summary, wide, one row per group."""
    g_sel = f"{group}, " if group else ""
    g_by = f" GROUP BY {group}" if group else ""
    cnt = ", ".join(
        f"CAST(sum(CASE WHEN actual_priority = {c} THEN 1 ELSE 0 END) AS BIGINT) AS sup{c}, "
        f"CAST(sum(CASE WHEN predicted_priority = {c} THEN 1 ELSE 0 END) AS BIGINT) AS prd{c}, "
        f"CAST(sum(CASE WHEN actual_priority = {c} AND predicted_priority = {c} THEN 1 ELSE 0 END) AS BIGINT) AS tp{c}"
        for c in range(4))
    pr = ", ".join(
        f"CASE WHEN prd{c} = 0 THEN 0.0E0 ELSE CAST(tp{c} AS DOUBLE) / CAST(prd{c} AS DOUBLE) END AS p{c}, "
        f"CASE WHEN sup{c} = 0 THEN 0.0E0 ELSE CAST(tp{c} AS DOUBLE) / CAST(sup{c} AS DOUBLE) END AS r{c}"
        for c in range(4))
    f1 = ", ".join(f"CASE WHEN p{c} + r{c} = 0 THEN 0.0E0 ELSE 2 * p{c} * r{c} / (p{c} + r{c}) END AS f{c}"
                   for c in range(4))

    def rnd(e):
        return f"round({e}, {dp})" if dp is not None else e
    return f"""
w AS (SELECT {g_sel}count(*) AS n, {cnt} FROM {source}{g_by}),
pc AS (SELECT *, {pr} FROM w),
fc AS (SELECT *, {f1} FROM pc),
summ AS (SELECT {g_sel}
  {rnd('CASE WHEN n = 0 THEN 0.0E0 ELSE CAST(tp0 + tp1 + tp2 + tp3 AS DOUBLE) / CAST(n AS DOUBLE) END')} AS accuracy,
  {rnd('(p0 + p1 + p2 + p3) / 4')} AS macro_precision,
  {rnd('(r0 + r1 + r2 + r3) / 4')} AS macro_recall,
  {rnd('(f0 + f1 + f2 + f3) / 4')} AS macro_f1,
  {rnd('CASE WHEN n = 0 THEN 0.0E0 ELSE (f0 * sup0 + f1 * sup1 + f2 * sup2 + f3 * sup3) / CAST(n AS DOUBLE) END')} AS weighted_f1,
  {rnd(f'r{focus}')} AS urgent_recall, {rnd(f'f{focus}')} AS urgent_f1, n AS support FROM fc)"""


def _split_sql() -> str:
    """Labelled cases -> largest-remainder quotas -> hash rank -> split."""
    return f"""
lab AS (SELECT case_id, {PRIO_CODE.format(x='priority')} AS priority_encoded FROM cases WHERE priority IS NOT NULL),
cnt AS (SELECT priority_encoded, count(*) AS n_c FROM lab GROUP BY priority_encoded),
tot AS (SELECT CAST(sum(n_c) AS BIGINT) AS n, CAST(ceil(0.2E0 * sum(n_c) - 1e-9) AS BIGINT) AS n_test FROM cnt),
ex AS (SELECT c.priority_encoded, c.n_c, t.n_test, CAST(c.n_c * t.n_test AS DOUBLE) / CAST(t.n AS DOUBLE) AS exact FROM cnt c, tot t),
fl AS (SELECT *, CAST(floor(exact) AS BIGINT) AS fq, exact - floor(exact) AS frac FROM ex),
lr AS (SELECT *, row_number() OVER (ORDER BY frac DESC, priority_encoded ASC) AS rr, n_test - sum(fq) OVER () AS leftover FROM fl),
quota AS (SELECT priority_encoded, CASE WHEN n_c >= 2 THEN least(fq + CASE WHEN rr <= leftover THEN 1 ELSE 0 END, n_c - 1)
          ELSE fq + CASE WHEN rr <= leftover THEN 1 ELSE 0 END END AS q FROM lr),
ranked AS (SELECT l.*, row_number() OVER (PARTITION BY priority_encoded ORDER BY {HASH.format(k='case_id')}, case_id) AS rk FROM lab l),
split AS (SELECT r.case_id, r.priority_encoded, r.rk, CASE WHEN r.rk <= q.q THEN 'test' ELSE 'train' END AS split
          FROM ranked r JOIN quota q ON q.priority_encoded = r.priority_encoded)"""


def _cte(views: tuple[str, ...], extra: str, body: str) -> str:
    """views as CTEs, then extra CTE text (comma-led pieces), then body."""
    base = with_views("SELECT 1", *views)
    assert base.endswith("SELECT 1")
    head = base[: -len("SELECT 1")].rstrip()
    if extra.strip():
        head = head + ",\n" + extra.strip() if head else "WITH " + extra.strip()
    return f"{head}\n{body.strip()}"


DQ_COLS = [("case_id", "string"), ("file_seq", "int"), ("row_seq", "bigint"),
           ("created_at", "string"), ("priority", "string"), ("channel", "string"),
           ("customer_tenure_months", "string"), ("age_band", "string"), ("gender", "string")]

CORR_COLS = ["case_id", "first_response_time_hours", "resolution_time_hours", "sla_target_hours"]


def _dq_sql() -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
        f"round((count(*) - count({c})) * 100.0E0 / count(*), 2) AS null_pct, "
        f"count(DISTINCT {c}) AS distinct_count FROM raw_cases" for c, t in DQ_COLS]
    return with_views("SELECT * FROM (" + " UNION ALL ".join(parts) +
                      ") t ORDER BY null_pct DESC, \"column\" LIMIT 10", "raw_cases")


def _corr_sql() -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 2) AS r "
             f"FROM case_facts" for a in CORR_COLS for b in CORR_COLS]
    return with_views(" UNION ALL ".join(parts), "case_facts")


CAT_COLS = ["channel", "case_type", "category", "plan_tier"]


def _onehot_sql() -> str:
    longv = " UNION ALL ".join(f"SELECT case_id, '{c}' AS source_col, {c} AS v FROM cases" for c in CAT_COLS)
    return _cte(("cases",), f"""
longv AS ({longv}),
modes AS (SELECT source_col, v AS mode_v FROM (
  SELECT source_col, v, row_number() OVER (PARTITION BY source_col ORDER BY count(*) DESC, v ASC) AS rn
  FROM longv WHERE v IS NOT NULL GROUP BY source_col, v) t WHERE rn = 1),
imputed AS (SELECT l.case_id, l.source_col, coalesce(l.v, m.mode_v) AS v FROM longv l JOIN modes m ON m.source_col = l.source_col),
cats AS (SELECT DISTINCT source_col, v FROM imputed)""", """
SELECT i.case_id, c.source_col, c.source_col || '_' || c.v AS feature,
  CASE WHEN i.v = c.v THEN 1.0E0 ELSE 0.0E0 END AS x
FROM imputed i JOIN cats c ON c.source_col = i.source_col""")


def _tenure_edges_cte(src: str = "cases", col: str = "customer_tenure_months") -> str:
    return f"""
qe AS (SELECT min({col}) AS lo, quantile_cont({col}, [0.2, 0.4, 0.6, 0.8]) AS q, max({col}) AS hi FROM {src}),
ek AS (SELECT unnest(range(1, 6)) AS k, lo, q, hi FROM qe),
ev AS (SELECT k, CASE WHEN k = 5 THEN hi ELSE q[k] END AS edge, CASE WHEN k = 1 THEN lo ELSE q[k - 1] END AS prev FROM ek),
kept AS (SELECT k, edge FROM ev WHERE edge - prev > 1e-8),
inner_e AS (SELECT edge FROM kept WHERE k < (SELECT max(k) FROM kept))"""


def _tenure_bin(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN NULL ELSE CAST((SELECT count(*) FROM inner_e "
            f"WHERE inner_e.edge <= {col}) AS INTEGER) END")


ORACLE: dict[str, str] = {}

ORACLE["case_kpis"] = with_views("""
SELECT count(*) AS total_cases,
 CAST(count(*) FILTER (WHERE status = 'open') AS BIGINT) AS open_cases,
 round(avg(CAST(first_response_time_hours AS DOUBLE)), 6) AS avg_response_hours,
 round(avg(CAST(resolution_time_hours AS DOUBLE)), 6) AS avg_resolution_hours,
 round(avg(TRY_CAST(csat_score AS DOUBLE)), 6) AS avg_csat,
 round(avg(CAST(escalated AS DOUBLE)) * 100, 6) AS escalation_rate_pct,
 round(avg(CASE WHEN resolution_time_hours <= sla_target_hours THEN 1.0E0 ELSE 0.0E0 END) * 100, 6) AS sla_met_pct
FROM case_facts""", "case_facts")

ORACLE["value_counts_case_type"] = with_views(
    'SELECT case_type, count(*) AS "count" FROM case_facts WHERE case_type IS NOT NULL GROUP BY case_type',
    "case_facts")
ORACLE["value_counts_category"] = with_views(
    'SELECT category, count(*) AS "count" FROM case_facts WHERE category IS NOT NULL GROUP BY category',
    "case_facts")

ORACLE["gender_clean_counts"] = with_views(f"""
SELECT gender_clean, count(*) AS "count" FROM (
 SELECT CASE WHEN g IN ('m', 'male') THEN 'Male' WHEN g IN ('f', 'female') THEN 'Female'
   WHEN g IN ('nb', 'non-binary', 'nonbinary', 'non binary') THEN 'Non-Binary' END AS gender_clean
 FROM (SELECT lower({trim('gender')}) AS g FROM raw_cases) t) u
GROUP BY gender_clean""", "raw_cases")

LATEST = """latest AS (SELECT case_id, file_seq, row_seq, created_at, priority, channel, customer_tenure_months, age_band, gender
 FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY file_seq DESC, row_seq DESC) AS rn FROM raw_cases) t WHERE rn = 1)"""

ORACLE["latest_cases"] = _cte(("raw_cases",), LATEST, "SELECT * FROM latest")

ORACLE["clean_cases"] = _cte(("raw_cases",), LATEST + f""",
cleaned AS (SELECT case_id, file_seq, row_seq, try_cast(created_at AS TIMESTAMP) AS created_at,
  array_to_string(list_transform(string_split(lower({trim('priority')}), ' '),
                  lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS priority,
  lower({trim('channel')}) AS channel,
  TRY_CAST(customer_tenure_months AS DOUBLE) AS customer_tenure_months, age_band, gender FROM latest)""", f"""
SELECT *, {PRIO_CODE.format(x='priority')} AS priority_encoded FROM cleaned
WHERE {PRIO_CODE.format(x='priority')} IS NOT NULL""")

ORACLE["nonblank_distinct"] = with_views(f"""
SELECT DISTINCT case_id, priority, channel, age_band, gender FROM raw_cases
WHERE age_band IS NOT NULL AND {trim('age_band')} <> ''""", "raw_cases")

ORACLE["load_report"] = with_views("""
SELECT CAST(count(DISTINCT file_seq) AS BIGINT) AS files_loaded, count(*) AS initial_rows,
 (SELECT count(*) FROM (SELECT DISTINCT case_id FROM raw_cases) d) AS after_dedup,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT case_id FROM raw_cases) d) AS rows_removed
FROM raw_cases""", "raw_cases")

ORACLE["dq_summary"] = _dq_sql()
ORACLE["dq_months_merged"] = with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
    f"round((count(*) - count({c})) * 100.0E0 / count(*), 2) AS null_pct, true AS distinct_close FROM raw_cases"
    for c, t in DQ_COLS if c != "file_seq"), "raw_cases")
ORACLE["corr_matrix"] = _corr_sql()

ORACLE["calendar_features"] = with_views("""
SELECT case_id, created_at, CAST(hour(created_at) AS INTEGER) AS hour, dayname(created_at) AS day_of_week
FROM case_facts""", "case_facts")

ORACLE["priority_filter_ordered"] = with_views("""
SELECT case_id, priority, CASE priority WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2
  WHEN 'Urgent' THEN 3 ELSE 99 END AS priority_rank
FROM case_facts WHERE priority IN ('High', 'Urgent')""", "case_facts")

ORACLE["case_validation"] = with_views(f"""
SELECT case_id, row_seq, n_reasons = 0 AS is_valid, n_reasons, reasons FROM (
 SELECT case_id, row_seq,
  CAST((CASE WHEN ch_bad THEN 1 ELSE 0 END) + (CASE WHEN ca_bad THEN 1 ELSE 0 END) + (CASE WHEN t_bad THEN 1 ELSE 0 END) AS INTEGER) AS n_reasons,
  concat_ws('; ', CASE WHEN ch_bad THEN 'invalid channel' END, CASE WHEN ca_bad THEN 'invalid category' END, CASE WHEN t_bad THEN 'tenure out of range' END) AS reasons
 FROM (SELECT case_id, row_seq,
   NOT coalesce(lower({trim('channel')}) IN ('email', 'phone', 'webchat', 'mobile_app'), false) AS ch_bad,
   row_seq % 4 IN (2, 3) AS ca_bad,
   (TRY_CAST(customer_tenure_months AS DOUBLE) IS NULL OR TRY_CAST(customer_tenure_months AS DOUBLE) < 0
    OR TRY_CAST(customer_tenure_months AS DOUBLE) > 240) AS t_bad
  FROM raw_cases) a) b""", "raw_cases")

ORACLE["monthly_load"] = with_views("""
SELECT case_id, CAST(row_seq AS BIGINT) AS file_row, CASE WHEN file_seq % 3 <> 2 THEN priority END AS priority,
 channel, CASE WHEN file_seq % 3 <> 2 THEN gender END AS gender,
 CASE WHEN file_seq % 3 = 1 THEN concat('x,', CAST(row_seq AS STRING)) END AS extra, CAST(file_seq % 3 AS INTEGER) AS month, 'ok' AS record_status
FROM raw_cases""", "raw_cases")

ORACLE["monthly_load_ragged"] = with_views("""
SELECT CAST(case_id AS VARCHAR) AS case_id, CAST(row_seq AS VARCHAR) AS file_row, 'a "quoted" word,|and row ' || row_seq AS summary,
 coalesce(priority, '') AS priority, coalesce(channel, '') AS channel, CASE WHEN row_seq % 5 = 0 THEN '' ELSE coalesce(gender, '') END AS gender,
 CASE WHEN row_seq % 5 <> 2 THEN '' END AS extra, CASE WHEN row_seq % 5 <> 2 THEN coalesce(age_band, '') END AS age_band,
 CAST(file_seq % 3 AS INTEGER) AS month, row_seq % 5 = 0 AS was_repaired,
 CASE row_seq % 5 WHEN 0 THEN 'repaired' WHEN 1 THEN 'long' WHEN 2 THEN 'short' ELSE 'ok' END AS record_status
FROM raw_cases""", "raw_cases")

ORACLE["drop_leakage"] = with_views(
    "SELECT case_id, created_at, status, case_type, category, priority, sla_target_hours, csat_score FROM case_facts",
    "case_facts")
ORACLE["select_existing"] = with_views(
    "SELECT case_id, priority, case_type, category, status FROM case_facts", "case_facts")

ORACLE["impute_mode_onehot"] = _onehot_sql()

ORACLE["impute_median"] = with_views("""
SELECT case_id, coalesce(first_response_time_hours, (SELECT median(first_response_time_hours) FROM case_facts))
  AS first_response_time_hours FROM case_facts""", "case_facts")

ORACLE["tenure_bins"] = _cte(("cases",), _tenure_edges_cte(), f"""
SELECT case_id, customer_tenure_months, {_tenure_bin('customer_tenure_months')} AS tenure_bin FROM cases""")

ORACLE["stratified_split"] = _cte(("cases",), _split_sql(),
                                  "SELECT case_id, priority_encoded, split FROM split")
ORACLE["class_balance"] = _cte(("cases",), _split_sql(),
                               'SELECT split, priority_encoded, count(*) AS "count" FROM split GROUP BY split, priority_encoded')
ORACLE["stratified_folds"] = _cte(("cases",), _split_sql(),
                                  "SELECT case_id, priority_encoded, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM ranked")
ORACLE["class_weights"] = _cte(("cases",), _split_sql(), """
SELECT priority_encoded, n_c, round(CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(*) OVER () * n_c AS DOUBLE), 6) AS weight
FROM cnt""")

ORACLE["confusion_matrix"] = _cte(("predictions_fixture",), """
grid AS (SELECT CAST(a.range AS INTEGER) AS actual, CAST(p.range AS INTEGER) AS predicted FROM range(4) a, range(4) p)""", """
SELECT g.actual, g.predicted, CAST(count(f.case_id) AS BIGINT) AS n
FROM grid g LEFT JOIN predictions_fixture f ON f.actual_priority = g.actual AND f.predicted_priority = g.predicted
GROUP BY g.actual, g.predicted""")

ORACLE["classification_report"] = _cte(("predictions_fixture",), """
cls AS (SELECT * FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High'), (3, 'Urgent')) c(k, name)),
cc AS (SELECT c.k, c.name AS class,
  CAST(sum(CASE WHEN f.actual_priority = c.k THEN 1 ELSE 0 END) AS BIGINT) AS sup,
  CAST(sum(CASE WHEN f.predicted_priority = c.k THEN 1 ELSE 0 END) AS BIGINT) AS prd,
  CAST(sum(CASE WHEN f.actual_priority = c.k AND f.predicted_priority = c.k THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM predictions_fixture f, cls c GROUP BY c.k, c.name),
pr AS (SELECT class, sup, CASE WHEN prd = 0 THEN 0.0E0 ELSE CAST(tp AS DOUBLE) / CAST(prd AS DOUBLE) END AS p,
  CASE WHEN sup = 0 THEN 0.0E0 ELSE CAST(tp AS DOUBLE) / CAST(sup AS DOUBLE) END AS r FROM cc)""", """
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0E0 ELSE 2 * p * r / (p + r) END, 6) AS f1, sup AS support FROM pr""")

ORACLE["summary_metrics"] = _cte(("predictions_fixture",), _metrics_sql("predictions_fixture", None, 6),
                                 "SELECT * FROM summ")

_CMP = _metrics_sql("model_predictions", "model", 3)
ORACLE["model_comparison"] = _cte(("model_predictions",), _CMP,
                                  "SELECT model, accuracy, macro_f1, weighted_f1, urgent_recall, urgent_f1 FROM summ")
ORACLE["select_model"] = _cte(("model_predictions",), _CMP, """
SELECT model, accuracy, macro_f1, weighted_f1, urgent_recall, urgent_f1 FROM summ
ORDER BY urgent_recall DESC, model ASC LIMIT 1""")
ORACLE["metrics_long"] = _cte(("model_predictions",), _CMP, """
SELECT model, 'accuracy' AS metric, accuracy AS score FROM summ
UNION ALL SELECT model, 'macro_f1', macro_f1 FROM summ
UNION ALL SELECT model, 'urgent_recall', urgent_recall FROM summ""")

ORACLE["match_flags"] = with_views("""
SELECT p.case_id, c.category, p.actual_priority, p.predicted_priority,
  p.actual_priority = p.predicted_priority AS is_match
FROM predictions_fixture p JOIN case_facts c ON c.case_id = p.case_id""", "predictions_fixture")

ORACLE["urgent_top10"] = with_views("""
SELECT case_id, predicted_priority, prob_Urgent, greatest(prob_Low, prob_Medium, prob_High, prob_Urgent) AS confidence
FROM predictions_fixture ORDER BY predicted_priority DESC, prob_Urgent DESC, confidence DESC, case_id ASC LIMIT 10""",
                                    "predictions_fixture")

ORACLE["sample_background"] = with_views(f"""
SELECT case_id, channel, case_type FROM cases ORDER BY {HASH.format(k='case_id')}, case_id LIMIT 50""", "cases")
