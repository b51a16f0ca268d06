"""Oracle SQL (DuckDB) for the explanation queries over the frozen model.

The frozen model is restated from scratch in SQL: top-500 terms (words and word pairs), category
and tenure-bin slots, a 64-row hashed background, coefficients
(((len(name)*7 + 3c + slot) mod 11) - 5)/16 and intercepts (c - 1.5)/8.
"""

from __future__ import annotations

from ..operators.explain.narrative import EXPLANATION_PROMPT_TEMPLATE, SUMMARY_PROMPT_TEMPLATE
from ..operators.explain.vocab import FEATURE_EXPLANATIONS, FIXTURE_GROUPS, SEMANTIC_GROUPS, SPECULATIVE_PHRASES
from .oracle import HASH, ORACLE, _cte, _tenure_edges_cte

LABELS = ["Low", "Medium", "High", "Urgent"]
TAB = ["channel", "case_type", "category", "plan_tier", "customer_tenure_months"]
NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


KW = _values([(g, k, i) for i, (g, k) in enumerate((g, k) for g, ks in FIXTURE_GROUPS.items() for k in ks)],
             ["grp", "keyword", "ko"])
GRP = _values([(g, i) for i, g in enumerate(FIXTURE_GROUPS)], ["grp", "go"])
DICT = _values([(f, v, t) for f, vs in FEATURE_EXPLANATIONS.items() if f != "customer_tenure_months"
                for v, t in vs.items()], ["feature", "v", "text"])
TIERS = _values([(k, t) for k, t in FEATURE_EXPLANATIONS["customer_tenure_months"].items()], ["tier", "text"])
LAB = _values([(i, lbl) for i, lbl in enumerate(LABELS)], ["c", "label"])
SRC = _values([(s, i) for i, s in enumerate(TAB)], ["feature", "so"])


def value_expr(alias: str = "cs") -> str:
    return (f"CASE t.feature WHEN 'channel' THEN {alias}.channel WHEN 'case_type' THEN {alias}.case_type "
            f"WHEN 'category' THEN {alias}.category WHEN 'plan_tier' THEN {alias}.plan_tier "
            f"ELSE CAST({alias}.customer_tenure_months AS VARCHAR) END")


def tier_expr(v: str) -> str:
    return (f"CASE WHEN TRY_CAST({v} AS DOUBLE) < 6 THEN 'low' WHEN TRY_CAST({v} AS DOUBLE) > 24 THEN 'high' "
            f"ELSE 'medium' END")


def explanation_expr(feature: str, value: str) -> str:
    """Dictionary sentence with the reference's fallbacks."""
    return (f"CASE WHEN {feature} = 'customer_tenure_months' THEN "
            f"(SELECT text FROM {TIERS} tt WHERE tt.tier = {tier_expr(value)}) "
            f"WHEN {feature} IN ('channel', 'case_type', 'category', 'plan_tier') THEN "
            f"coalesce((SELECT text FROM {DICT} dd WHERE dd.feature = {feature} AND dd.v = lower({value})), "
            f"{feature} || ' = ' || coalesce({value}, 'None')) "
            f"ELSE {feature} || ' value: ' || coalesce({value}, 'None') END")


FROZEN = _tenure_edges_cte() + f""",
tok AS (SELECT case_id, regexp_extract_all(lower(coalesce(case_summary, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM cases),
gram AS (SELECT case_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term FROM tok),
utf AS (SELECT term, count(*) AS tf FROM gram GROUP BY term HAVING count(DISTINCT case_id) >= 2),
vocab AS (SELECT term FROM utf ORDER BY tf DESC, term ASC LIMIT 500),
nb AS (SELECT count(*) + 1 AS nbins FROM inner_e),
slots0 AS (
  SELECT term AS name, 'text' AS block, 'case_summary' AS source_col, 0 AS bo, term AS v FROM vocab
  UNION ALL SELECT DISTINCT 'channel_' || channel, 'cat', 'channel', 1, channel FROM cases WHERE channel IS NOT NULL
  UNION ALL SELECT DISTINCT 'case_type_' || case_type, 'cat', 'case_type', 2, case_type FROM cases WHERE case_type IS NOT NULL
  UNION ALL SELECT DISTINCT 'category_' || category, 'cat', 'category', 3, category FROM cases WHERE category IS NOT NULL
  UNION ALL SELECT DISTINCT 'plan_tier_' || plan_tier, 'cat', 'plan_tier', 4, plan_tier FROM cases WHERE plan_tier IS NOT NULL
  UNION ALL SELECT 'customer_tenure_months_' || CAST(k AS VARCHAR) || '.0', 'tenure', 'customer_tenure_months', 5,
    CAST(k AS VARCHAR) FROM (SELECT unnest(range(0, (SELECT nbins FROM nb))) AS k) r),
slots AS (SELECT *, CAST(row_number() OVER (ORDER BY bo, name) - 1 AS INTEGER) AS idx FROM slots0),
hit AS (SELECT DISTINCT g.case_id, s.idx FROM gram g JOIN slots s ON s.block = 'text' AND s.v = g.term),
cb AS (SELECT c.*, CASE WHEN c.customer_tenure_months IS NULL THEN NULL ELSE
         (SELECT count(*) FROM inner_e WHERE inner_e.edge <= c.customer_tenure_months) END AS bin
       FROM cases c),
xv AS (SELECT cb.case_id, s.idx, s.name, s.block, s.source_col,
  CASE WHEN s.block = 'text' THEN (CASE WHEN h.idx IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END)
       WHEN s.source_col = 'channel' THEN (CASE WHEN cb.channel = s.v THEN 1.0E0 ELSE 0.0E0 END)
       WHEN s.source_col = 'case_type' THEN (CASE WHEN cb.case_type = s.v THEN 1.0E0 ELSE 0.0E0 END)
       WHEN s.source_col = 'category' THEN (CASE WHEN cb.category = s.v THEN 1.0E0 ELSE 0.0E0 END)
       WHEN s.source_col = 'plan_tier' THEN (CASE WHEN cb.plan_tier = s.v THEN 1.0E0 ELSE 0.0E0 END)
       ELSE (CASE WHEN cb.bin = CAST(s.v AS BIGINT) THEN 1.0E0 ELSE 0.0E0 END) END AS x
  FROM cb CROSS JOIN slots s LEFT JOIN hit h ON h.case_id = cb.case_id AND h.idx = s.idx),
bg AS (SELECT case_id FROM cases ORDER BY {HASH.format(k='case_id')}, case_id LIMIT 64),
mu AS (SELECT x.idx, avg(x.x) AS mu FROM xv x JOIN bg ON bg.case_id = x.case_id GROUP BY x.idx),
cls AS (SELECT unnest(range(0, 4)) AS c),
wt AS (SELECT s.idx, cls.c, (((length(s.name) * 7 + 3 * cls.c + s.idx) % 11) - 5) / 16.0E0 AS w FROM slots s, cls),
marg AS (SELECT x.case_id, w.c, (w.c - 1.5E0) / 8.0E0 + sum(w.w * x.x) AS m FROM xv x JOIN wt w ON w.idx = x.idx
         GROUP BY x.case_id, w.c),
pred AS (SELECT case_id, CAST(c AS INTEGER) AS explained_class, m AS margin FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m DESC, c ASC) AS rn FROM marg) t WHERE rn = 1),
sm AS (SELECT case_id, c, exp(m - max(m) OVER (PARTITION BY case_id)) AS e FROM marg),
probs AS (SELECT case_id, c, e / sum(e) OVER (PARTITION BY case_id) AS p FROM sm),
phi AS (SELECT x.case_id, p.explained_class, x.idx, x.name, x.block, x.source_col, w.w * (x.x - mu.mu) AS phi,
          w.w * mu.mu AS wmu
        FROM xv x JOIN pred p ON p.case_id = x.case_id JOIN wt w ON w.idx = x.idx AND w.c = p.explained_class
        JOIN mu ON mu.idx = x.idx),
base AS (SELECT p.case_id, p.explained_class, p.margin,
          (p.explained_class - 1.5E0) / 8.0E0 + sum(ph.wmu) AS base_value, sum(ph.phi) AS phi_sum
        FROM pred p JOIN phi ph ON ph.case_id = p.case_id GROUP BY p.case_id, p.explained_class, p.margin),
tab0 AS (SELECT case_id, source_col AS feature, sum(phi) AS contribution FROM phi WHERE block <> 'text' GROUP BY 1, 2),
tab AS (SELECT t.case_id, t.feature, {value_expr('cs')} AS value, t.contribution,
          row_number() OVER (PARTITION BY t.case_id ORDER BY abs(t.contribution) DESC, src.so ASC) AS rank
        FROM tab0 t JOIN cases cs ON cs.case_id = t.case_id JOIN {SRC} src ON src.feature = t.feature),
kw AS {KW},
grp AS {GRP},
tg AS (SELECT DISTINCT s.idx, k.grp FROM slots s JOIN kw k ON s.block = 'text' AND contains(lower(s.name), lower(k.keyword))),
gs AS (SELECT p.case_id, tg.grp, sum(p.phi) AS s FROM phi p JOIN tg ON tg.idx = p.idx GROUP BY 1, 2),
gsum AS (SELECT pc.case_id, g.grp, g.go, coalesce(gs.s, 0.0E0) AS contribution FROM pred pc CROSS JOIN grp g
         LEFT JOIN gs ON gs.case_id = pc.case_id AND gs.grp = g.grp),
unc AS (SELECT pc.case_id, coalesce((SELECT sum(p.phi) FROM phi p WHERE p.case_id = pc.case_id AND p.block = 'text'
          AND p.idx NOT IN (SELECT idx FROM tg)), 0.0E0) AS contribution FROM pred pc),
toks_top AS (SELECT * FROM (SELECT case_id, name AS token, phi AS contribution,
    row_number() OVER (PARTITION BY case_id ORDER BY abs(phi) DESC, idx ASC) AS rank FROM phi WHERE block = 'text') t
  WHERE rank <= 10 AND abs(contribution) > 0.001),
doc AS (SELECT p.case_id, lb.label AS priority, round(pr.p, 3) AS confidence FROM pred p
        JOIN probs pr ON pr.case_id = p.case_id AND pr.c = p.explained_class JOIN {LAB} lb ON lb.c = p.explained_class),
enr AS (SELECT t.case_id, t.feature, t.value, t.rank, t.contribution AS raw, round(t.contribution, 3) AS contribution,
          {explanation_expr('t.feature', 't.value')} AS explanation FROM tab t),
pos AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS k FROM enr WHERE raw > 0),
neg AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS k FROM enr WHERE raw < 0),
theme AS (SELECT case_id, grp FROM (SELECT case_id, grp, row_number() OVER (PARTITION BY case_id ORDER BY go) AS r
          FROM gsum WHERE round(contribution, 3) > 0.05) t WHERE r = 1)"""


def frozen_sql(body: str, extra: str = "") -> str:
    return _cte(("cases",), FROZEN + ("," + extra if extra else ""), body)


def title(x: str) -> str:
    return (f"array_to_string(list_transform(string_split(replace({x}, '_', ' '), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


NARR = f"""
narr AS (SELECT d.case_id,
  'This case has been classified as **' || d.priority || '** priority with ' || printf('%.0f', d.confidence * 100)
  || '% confidence.'
  || coalesce(' The main contributing factors are: ' || (SELECT string_agg(replace(p.feature, '_', ' ') || ' ('
       || coalesce(p.value, 'None') || ')', ', ' ORDER BY p.k) FROM pos p WHERE p.case_id = d.case_id AND p.k <= 3)
       || '. ' || (SELECT p.explanation FROM pos p WHERE p.case_id = d.case_id AND p.k = 1) || '.', '')
  || coalesce(' The case text shows ' || (SELECT replace(th.grp, '_', ' ') FROM theme th WHERE th.case_id = d.case_id)
       || ' patterns.', '') AS narrative,
  CASE WHEN EXISTS (SELECT 1 FROM pos p WHERE p.case_id = d.case_id) THEN
    'Classified as ' || d.priority || ' priority primarily due to ' ||
    (SELECT replace(p.feature, '_', ' ') || ' (' || coalesce(p.value, 'None') || ').' FROM pos p WHERE p.case_id = d.case_id AND p.k = 1)
  ELSE 'Classified as ' || d.priority || ' priority based on overall case characteristics.' END AS summary
  FROM doc d)"""

CTX = f"""
ctx AS (SELECT d.case_id,
  'Case ID: ' || CAST(d.case_id AS VARCHAR) || {NL} || 'Predicted Priority: ' || d.priority || {NL}
  || 'Confidence: ' || printf('%.1f', d.confidence * 100) || '%' || {NL} || {NL} || 'Class Probabilities:'
  || (SELECT string_agg({NL} || '  - ' || lb.label || ': ' || printf('%.1f', round(pr.p, 3) * 100) || '%', '' ORDER BY pr.c)
      FROM probs pr JOIN {LAB} lb ON lb.c = pr.c WHERE pr.case_id = d.case_id)
  || {NL} || {NL} || 'Positive Contributing Factors:'
  || coalesce((SELECT string_agg({NL} || '  - ' || p.feature || '=' || coalesce(p.value, 'None') || ': +'
      || printf('%.3f', p.contribution) || {NL} || '    Reason: ' || p.explanation, '' ORDER BY p.k)
      FROM pos p WHERE p.case_id = d.case_id AND p.k <= 5), '')
  || coalesce({NL} || {NL} || 'Negative Contributing Factors:' || (SELECT string_agg({NL} || '  - ' || n.feature || '='
      || coalesce(n.value, 'None') || ': ' || printf('%.3f', n.contribution) || {NL} || '    Reason: ' || n.explanation,
      '' ORDER BY n.k) FROM neg n WHERE n.case_id = d.case_id AND n.k <= 3), '')
  || coalesce({NL} || {NL} || 'Key Text Tokens:' || (SELECT string_agg({NL} || '  - "' || t.token || '": '
      || (CASE WHEN t.contribution > 0 THEN '+' ELSE '' END) || printf('%.3f', t.contribution), '' ORDER BY t.rank)
      FROM toks_top t WHERE t.case_id = d.case_id AND t.rank <= 5), '')
  || {NL} || {NL} || 'Semantic Theme Contributions:'
  || coalesce((SELECT string_agg({NL} || '  - ' || g.grp || ': ' || (CASE WHEN round(g.contribution, 3) > 0 THEN '+' ELSE '' END)
      || printf('%.3f', round(g.contribution, 3)), '' ORDER BY g.go) FROM gsum g
      WHERE g.case_id = d.case_id AND abs(round(g.contribution, 3)) > 0.01), '') AS context
  FROM doc d)"""

FACT = f"""
fact AS (SELECT d.case_id, regexp_replace(
  'Factors contributing to ' || d.priority || ' priority:' || {NL}
  || coalesce((SELECT string_agg('• ' || {title('p.feature')} || ': ' || coalesce(p.value, 'None') || ' (+'
       || printf('%.2f', p.contribution) || ')' || {NL} || '  → ' || p.explanation, {NL} ORDER BY p.k)
       FROM pos p WHERE p.case_id = d.case_id AND p.k <= 4), '')
  || {NL} || {NL}
  || (CASE WHEN EXISTS (SELECT 1 FROM neg n WHERE n.case_id = d.case_id) THEN {NL} || 'Counterbalancing factors:' ELSE '' END)
  || {NL}
  || coalesce((SELECT string_agg('• ' || {title('n.feature')} || ': ' || coalesce(n.value, 'None') || ' ('
       || printf('%.2f', n.contribution) || ')' || {NL} || '  → ' || n.explanation, {NL} ORDER BY n.k)
       FROM neg n WHERE n.case_id = d.case_id AND n.k <= 2), ''),
  '^\\s+|\\s+$', '', 'g') AS factor_list FROM doc d)"""


def _prompt_sql() -> str:
    pre, post = EXPLANATION_PROMPT_TEMPLATE.split("{context}")
    a, rest = SUMMARY_PROMPT_TEMPLATE.split("{case_id}")
    b, rest = rest.split("{priority}")
    c, e = rest.split("{factors}")
    return f"""
SELECT d.case_id, {q(pre)} || x.context || {q(post)} AS explanation_prompt,
  {q(a)} || CAST(d.case_id AS VARCHAR) || {q(b)} || d.priority || {q(c)}
  || coalesce((SELECT string_agg('- ' || p.feature || '=' || coalesce(p.value, 'None') || ': ' || p.explanation, {NL} ORDER BY p.k)
     FROM pos p WHERE p.case_id = d.case_id AND p.k <= 3), '') || {q(e)} AS summary_prompt
FROM doc d JOIN ctx x ON x.case_id = d.case_id"""


def _grounding_sql() -> str:
    spec = ", ".join(f"CASE WHEN contains(low, {q(p)}) THEN {q(f'Speculative language detected: {chr(39)}{p}{chr(39)}')} END"
                     for p in SPECULATIVE_PHRASES)
    feats = "['case_type', 'category', 'channel']"
    return f"""
WITH generated_texts AS (SELECT conv_id AS case_id, turn, text AS generated_text,
 CASE conv_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Urgent' END AS priority
 FROM conversations WHERE role = 'assistant'),
g AS (SELECT case_id, turn, generated_text, priority, lower(coalesce(generated_text, '')) AS low FROM generated_texts),
w AS (SELECT case_id, turn, generated_text, priority, list_filter([{spec},
  CASE WHEN priority <> '' AND NOT contains(low, lower(priority)) THEN 'Generated text doesn''t mention predicted priority: ' || priority END,
  CASE WHEN contains(low, 'nd-') AND NOT contains(low, lower(CAST(case_id AS VARCHAR))) THEN 'Case ID mentioned but doesn''t match source data' END,
  CASE WHEN NOT len(list_filter({feats}, lambda f: contains(low, replace(f, '_', ' ')))) > 0 THEN 'No source features mentioned in explanation' END],
  lambda x: x IS NOT NULL) AS warnings FROM g)"""


ORACLE["shap_linear_frozen"] = frozen_sql(
    "SELECT case_id, explained_class, string_agg(CAST(CAST(phi * 1024 AS BIGINT) AS VARCHAR), ',' ORDER BY idx) AS phi_1024ths FROM phi GROUP BY ALL")
ORACLE["shap_additivity"] = frozen_sql(
    "SELECT case_id, explained_class, round(base_value, 6) AS base_value, round(margin, 6) AS margin, "
    "round(phi_sum + base_value, 6) AS reconstructed FROM base")
ORACLE["shap_rollup"] = frozen_sql(
    "SELECT case_id, CAST(rank AS INTEGER) AS rank, feature, value, round(contribution, 9) AS contribution FROM tab")
ORACLE["shap_text_groups"] = frozen_sql(
    "SELECT case_id, grp AS \"group\", round(contribution, 9) AS contribution FROM gsum "
    "UNION ALL SELECT case_id, '(uncategorized)', round(contribution, 9) FROM unc")
ORACLE["dominant_theme"] = frozen_sql("""
SELECT pc.case_id, t.grp AS theme, round(coalesce(t.contribution, 0.0E0), 9) AS value FROM pred pc LEFT JOIN (
  SELECT * FROM (SELECT case_id, grp, contribution, row_number() OVER (PARTITION BY case_id ORDER BY contribution DESC, go ASC) AS r
  FROM gsum WHERE contribution > 0) z WHERE r = 1) t ON t.case_id = pc.case_id""")
ORACLE["top_features"] = frozen_sql("""
SELECT case_id, CAST(rank AS INTEGER) AS rank, feature, round(contribution, 9) AS contribution FROM (
  SELECT case_id, name AS feature, phi AS contribution, row_number() OVER (PARTITION BY case_id ORDER BY abs(phi) DESC, idx ASC) AS rank
  FROM phi) t WHERE rank <= 10""")
ORACLE["top_tokens"] = frozen_sql(
    "SELECT case_id, CAST(rank AS INTEGER) AS rank, token, round(contribution, 9) AS contribution FROM toks_top")
ORACLE["global_importance_frozen"] = frozen_sql("""
SELECT s.name AS feature, round(avg(r.v), 9) AS importance FROM (
  SELECT x.case_id, x.idx, sum(abs(w.w * (x.x - mu.mu))) / 4 AS v FROM xv x JOIN bg ON bg.case_id = x.case_id
  JOIN wt w ON w.idx = x.idx JOIN mu ON mu.idx = x.idx GROUP BY x.case_id, x.idx) r JOIN slots s ON s.idx = r.idx
GROUP BY s.name""")
ORACLE["narrative"] = frozen_sql("SELECT case_id, narrative FROM narr", NARR)
ORACLE["summary_line"] = frozen_sql("SELECT case_id, summary FROM narr", NARR)
ORACLE["prompt_context"] = frozen_sql("SELECT case_id, context FROM ctx", CTX)
ORACLE["factor_list"] = frozen_sql("SELECT case_id, factor_list FROM fact", FACT)
ORACLE["prompts"] = frozen_sql(_prompt_sql(), CTX)
ORACLE["explained_prediction"] = frozen_sql("""
SELECT d.case_id, d.priority, d.confidence,
  (SELECT CAST(count(*) AS INTEGER) FROM pos p WHERE p.case_id = d.case_id) AS n_positive,
  (SELECT CAST(count(*) AS INTEGER) FROM neg n WHERE n.case_id = d.case_id) AS n_negative,
  coalesce((SELECT string_agg(p.feature || '|' || printf('%.3f', p.contribution) || '|' || p.explanation, ';' ORDER BY p.k)
     FROM pos p WHERE p.case_id = d.case_id), '') AS positive_text
FROM doc d""")

ORACLE["tenure_tier_explained"] = _cte(("cases",), f"""
tv AS ({' UNION ALL '.join(f"SELECT case_id, '{s}' AS feature, " + (f'CAST({s} AS VARCHAR)' if s == 'customer_tenure_months' else s) + " AS value FROM cases" for s in TAB)})""", f"""
SELECT case_id, feature, value, {explanation_expr('feature', 'value')} AS explanation FROM tv""")

ORACLE["keyword_groups"] = _cte(("cases",), f"kw AS {KW}", """
SELECT c.case_id, k.grp AS "group", string_agg(k.keyword, ',' ORDER BY k.ko) AS keywords
FROM cases c JOIN kw k ON regexp_matches(lower(coalesce(c.case_summary, '')),
        '(^|[^\\p{L}\\p{N}_])' || lower(k.keyword) || '($|[^\\p{L}\\p{N}_])')
GROUP BY c.case_id, k.grp""")

ORACLE["token_groups"] = _cte(("cases",), f"""
tok AS (SELECT case_id, regexp_extract_all(lower(coalesce(case_summary, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM cases),
grams AS (SELECT case_id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM tok),
per_doc AS (SELECT case_id, term, count(*) AS c FROM (SELECT case_id, unnest(g) AS term FROM grams) u GROUP BY case_id, term),
st AS (SELECT term, sum(c) AS tf, count(*) AS df FROM per_doc GROUP BY term),
vocab AS (SELECT term FROM st WHERE df >= 2 ORDER BY tf DESC, term ASC LIMIT 500),
kw AS {KW}""", """
SELECT DISTINCT v.term, k.grp AS "group" FROM vocab v JOIN kw k ON contains(lower(v.term), lower(k.keyword))""")

ORACLE["grounding_check"] = _grounding_sql() + """
SELECT case_id, turn, len(warnings) = 0 AS is_valid, CAST(len(warnings) AS INTEGER) AS n_warnings,
  array_to_string(warnings, ' | ') AS warnings FROM w"""
ORACLE["resolve_text"] = _grounding_sql() + """
SELECT case_id, turn, CASE WHEN generated_text IS NOT NULL AND len(warnings) = 0 THEN 'llm' ELSE 'template' END AS source,
  CASE WHEN generated_text IS NOT NULL AND len(warnings) = 0 THEN generated_text
       ELSE 'Classified as ' || priority || ' priority based on overall case characteristics.' END AS explanation,
  CAST(len(warnings) AS INTEGER) AS n_warnings FROM w"""


ORACLE["tfidf_vocab"] = _cte(("cases",), f"""
tok AS (SELECT case_id, regexp_extract_all(lower(coalesce(case_summary, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM cases),
grams AS (SELECT case_id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM tok),
per_doc AS (SELECT case_id, term, count(*) AS c FROM (SELECT case_id, unnest(g) AS term FROM grams) u GROUP BY case_id, term),
st AS (SELECT term, CAST(sum(c) AS BIGINT) AS tf, count(*) AS df FROM per_doc GROUP BY term),
nd AS (SELECT count(*) AS n FROM cases)""", """
SELECT term, tf, df, round(ln(CAST(1 + nd.n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1, 9) AS idf
FROM (SELECT * FROM st WHERE df >= 2 ORDER BY tf DESC, term ASC LIMIT 500) v, nd""")

ORACLE["tfidf_weights"] = _cte(("cases",), f"""
tok AS (SELECT case_id, regexp_extract_all(lower(coalesce(case_summary, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM cases),
grams AS (SELECT case_id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM tok),
per_doc AS (SELECT case_id, term, count(*) AS c FROM (SELECT case_id, unnest(g) AS term FROM grams) u GROUP BY case_id, term),
st AS (SELECT term, sum(c) AS tf, count(*) AS df FROM per_doc GROUP BY term),
nd AS (SELECT count(*) AS n FROM cases),
vocab AS (SELECT term, df FROM st WHERE df >= 2 ORDER BY tf DESC, term ASC LIMIT 500),
w AS (SELECT p.case_id, p.term, p.c * (ln(CAST(1 + nd.n AS DOUBLE) / CAST(1 + v.df AS DOUBLE)) + 1) AS raw
      FROM per_doc p JOIN vocab v ON v.term = p.term, nd),
nrm AS (SELECT case_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY case_id)""", """
SELECT w.case_id, w.term, round(w.raw / nrm.norm, 9) AS weight FROM w JOIN nrm ON nrm.case_id = w.case_id""")

ORACLE["export_roundtrip"] = _cte(("case_facts",), "", """
SELECT case_id, status, case_type, category, priority, sla_target_hours, escalated FROM case_facts""")

ORACLE["head_cases"] = _cte(("cases",), "", """
SELECT case_id, channel, case_type, plan_tier FROM cases ORDER BY case_id LIMIT 10""")
ORACLE["probs_long"] = _cte(("predictions_fixture",), "", """
SELECT case_id, 'Low' AS class, prob_Low AS probability FROM predictions_fixture
UNION ALL SELECT case_id, 'Medium', prob_Medium FROM predictions_fixture
UNION ALL SELECT case_id, 'High', prob_High FROM predictions_fixture
UNION ALL SELECT case_id, 'Urgent', prob_Urgent FROM predictions_fixture""")

ORACLE["explanation_card_fields"] = frozen_sql("""
SELECT d.case_id, d.priority, printf('%.0f', d.confidence * 100) || '%' AS confidence_pct,
  coalesce((SELECT string_agg(p.feature, ',' ORDER BY p.k) FROM pos p WHERE p.case_id = d.case_id AND p.k <= 3), '') AS top_positive,
  coalesce((SELECT string_agg(n.feature, ',' ORDER BY n.k) FROM neg n WHERE n.case_id = d.case_id AND n.k <= 2), '') AS top_negative,
  coalesce((SELECT string_agg(x.t, ',' ORDER BY x.o) FROM (
      SELECT printf('%.3f', p.contribution) AS t, p.k AS o FROM pos p WHERE p.case_id = d.case_id AND p.k <= 3
      UNION ALL SELECT printf('%.3f', n.contribution), 10 + n.k FROM neg n WHERE n.case_id = d.case_id AND n.k <= 2) x), '') AS impacts,
  (SELECT round(pr.p, 3) FROM probs pr WHERE pr.case_id = d.case_id AND pr.c = 3) AS prob_urgent,
  CAST((SELECT count(*) FROM toks_top t WHERE t.case_id = d.case_id) AS INTEGER) AS n_tokens
FROM doc d""")

# E9 end to end: split -> training rows -> vocabulary, imputed categories,
# quantile bins -> slot order (text, channel, case_type, category, plan_tier, bins).
_CATS = ["channel", "case_type", "category", "plan_tier"]


def _feature_names_sql() -> str:
    from .oracle import _split_sql
    longv = " UNION ALL ".join(f"SELECT case_id, '{c}' AS source_col, {i + 1} AS so, {c} AS v FROM tr"
                               for i, c in enumerate(_CATS))
    return _cte(("cases",), _split_sql() + f""",
tr AS (SELECT c.* FROM cases c JOIN split s ON s.case_id = c.case_id WHERE s.split = 'train'),
tk AS (SELECT case_id, regexp_extract_all(lower(coalesce(case_summary, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM tr),
grams AS (SELECT case_id, t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS g FROM tk),
per_doc AS (SELECT case_id, term, count(*) AS c FROM (SELECT case_id, unnest(g) AS term FROM grams) u GROUP BY case_id, term),
st AS (SELECT term, sum(c) AS tf, count(*) AS df FROM per_doc GROUP BY term),
vocab AS (SELECT term FROM st WHERE df >= 2 ORDER BY tf DESC, term ASC LIMIT 500),
longv AS ({longv}),
modes AS (SELECT source_col, v AS mode_v FROM (
  SELECT source_col, v, row_number() OVER (PARTITION BY source_col ORDER BY count(*) DESC, v ASC) AS rn
  FROM longv WHERE v IS NOT NULL GROUP BY source_col, v) t WHERE rn = 1),
cats AS (SELECT DISTINCT l.source_col, l.so, coalesce(l.v, m.mode_v) AS v FROM longv l JOIN modes m ON m.source_col = l.source_col),
""" + _tenure_edges_cte("tr").strip() + """,
names0 AS (
  SELECT 0 AS bo, 'text' AS block, 'case_summary' AS source_col, term AS name, term AS sk FROM vocab
  UNION ALL SELECT so, 'cat', source_col, source_col || '_' || v, v FROM cats
  UNION ALL SELECT 9, 'tenure', 'customer_tenure_months', 'customer_tenure_months_' || CAST(k AS VARCHAR) || '.0',
    lpad(CAST(k AS VARCHAR), 4, '0') FROM (SELECT unnest(range(0, (SELECT count(*) + 1 FROM inner_e))) AS k) r)""", """
SELECT CAST(row_number() OVER (ORDER BY bo, sk) - 1 AS INTEGER) AS idx, block, source_col, name FROM names0""")


ORACLE["feature_names"] = _feature_names_sql()


_GRAMS = """
tok AS (SELECT case_id, regexp_extract_all(lower(coalesce(case_summary, '')), '[\\p{L}\\p{N}_]{2,}') AS t FROM cases),
per_doc AS (SELECT case_id, term, count(*) AS c FROM (
  SELECT case_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM tok) u GROUP BY case_id, term),
st AS (SELECT term, count(*) AS df FROM per_doc GROUP BY term HAVING count(*) >= 2),
dict AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS idx FROM st)"""

ORACLE["tfidf_unlimited"] = _cte(("cases",), _GRAMS + """,
nd AS (SELECT count(*) AS n FROM cases),
w AS (SELECT p.case_id, d.idx, p.c * (ln(CAST(1 + nd.n AS DOUBLE) / CAST(1 + d.df AS DOUBLE)) + 1) AS raw FROM per_doc p JOIN dict d ON d.term = p.term, nd),
nrm AS (SELECT case_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY case_id)""", """
SELECT w.case_id, count(*) AS n_terms, CAST(sum(idx) AS BIGINT) AS sum_idx, max(idx) AS max_idx,
  round(sum(raw / norm), 6) AS sum_weight, round(max(raw / norm), 6) AS max_weight FROM w JOIN nrm ON nrm.case_id = w.case_id GROUP BY w.case_id""")

_COLS = ["channel", "case_type", "category", "plan_tier"]
_LONG = " UNION ALL ".join(f"SELECT case_id, {i} AS o, '{c}' AS col, {c} AS v FROM cases" for i, c in enumerate(_COLS))
_VALUES = "vals AS (SELECT col, v, row_number() OVER (ORDER BY o, v) - 1 AS idx FROM (SELECT DISTINCT o, col, v FROM longv WHERE v IS NOT NULL) d)"
ORACLE["onehot_long"] = _cte(("cases",), f"""
longv AS ({_LONG}), {_VALUES},
modes AS (SELECT col, v AS m FROM (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY count(*) DESC, v) AS r
  FROM longv WHERE v IS NOT NULL GROUP BY col, v) t WHERE r = 1)""", """
SELECT l.case_id, l.col, x.v AS value, x.idx, 1.0E0 AS x FROM longv l JOIN modes m ON m.col = l.col JOIN vals x ON x.col = l.col AND x.v = coalesce(l.v, m.m)""")

_SOURCES = ["case_summary", *TAB]
ORACLE["shap_sparse_frozen"] = _cte(("cases",), _tenure_edges_cte() + f""",
{_GRAMS.strip()},
longv AS ({_LONG}), {_VALUES},
nt AS (SELECT (SELECT count(*) FROM dict) AS terms, (SELECT count(*) FROM vals) AS cats),
bin AS (SELECT case_id, (SELECT count(*) FROM inner_e WHERE inner_e.edge <= customer_tenure_months) AS b FROM cases WHERE customer_tenure_months IS NOT NULL),
nz AS (SELECT p.case_id, d.idx, p.term AS name, 'case_summary' AS source FROM per_doc p JOIN dict d ON d.term = p.term
  UNION ALL SELECT l.case_id, x.idx + nt.terms, l.col || '_' || l.v, l.col FROM longv l JOIN vals x ON x.col = l.col AND x.v = l.v, nt
  UNION ALL SELECT case_id, b + nt.terms + nt.cats, 'customer_tenure_months_' || b || '.0', 'customer_tenure_months' FROM bin, nt),
bg AS (SELECT case_id FROM cases ORDER BY {HASH.format(k='case_id')}, case_id LIMIT 64),
cls AS (SELECT unnest(range(0, 4)) AS c),
sums AS (SELECT case_id, source, c, sum((((length(name) * 7 + 3 * c + idx) % 11) - 5) / 16.0E0) AS s FROM nz, cls GROUP BY ALL),
zero AS (SELECT source, c, sum((((length(name) * 7 + 3 * c + idx) % 11) - 5) / 16.0E0) / 64 AS z FROM nz JOIN bg ON bg.case_id = nz.case_id, cls GROUP BY ALL),
marg AS (SELECT k.case_id, cls.c, (cls.c - 1.5E0) / 8.0E0 + coalesce(sum(s.s), 0) AS m FROM cases k CROSS JOIN cls
  LEFT JOIN sums s ON s.case_id = k.case_id AND s.c = cls.c GROUP BY k.case_id, cls.c),
pred AS (SELECT case_id, c, m FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY m DESC, c) AS r FROM marg) t WHERE r = 1)""", """
SELECT p.case_id, CAST(p.c AS INTEGER) AS explained_class, p.m AS margin,
  (p.c - 1.5E0) / 8.0E0 + coalesce((SELECT sum(z) FROM zero WHERE zero.c = p.c), 0) AS base_value, """ + ", ".join(
    f"coalesce((SELECT s FROM sums WHERE sums.case_id = p.case_id AND sums.c = p.c AND source = '{s}'), 0) - "
    f"coalesce((SELECT z FROM zero WHERE zero.c = p.c AND source = '{s}'), 0) AS {s}" for s in _SOURCES) + " FROM pred p")

_DEFAULT = _values([(g, k, i) for i, (g, k) in enumerate((g, k) for g, ks in SEMANTIC_GROUPS.items() for k in ks)], ["grp", "keyword", "ko"])
ORACLE["keyword_groups_default"] = f"""
WITH kw AS {_DEFAULT},
t AS (SELECT conv_id AS case_id, turn, lower(coalesce(text, '')) AS low FROM conversations WHERE role = 'assistant')
SELECT t.case_id, t.turn, k.grp AS "group", string_agg(k.keyword, ',' ORDER BY k.ko) AS keywords
FROM t JOIN kw k ON contains(t.low, lower(k.keyword)) AND regexp_matches(t.low, '(^|[^\\p{{L}}\\p{{N}}_])' || lower(k.keyword) || '($|[^\\p{{L}}\\p{{N}}_])')
GROUP BY t.case_id, t.turn, k.grp"""
