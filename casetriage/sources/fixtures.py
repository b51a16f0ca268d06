"""Case-shaped views over the generated test tables.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB, so
an operator under test and its SQL oracle start from identical input.  The
views are input adapters only; every operator works on any DataFrame with
the same columns (e.g. the cleaned case extracts in production).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare
from .readers import spread

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Dirty, multi-version case rows (one key per customer, many versions).
RAW_CASES = """
SELECT concat('C-', lpad(CAST(o_custkey AS STRING), 6, '0')) AS case_id,
 CAST(month(o_orderdate) AS INT) AS file_seq, o_orderkey AS row_seq,
 CASE WHEN o_orderkey % 11 = 0 THEN 'not a date' ELSE CAST(o_orderdate AS STRING) END AS created_at,
 CASE o_orderkey % 3 WHEN 0 THEN concat('  ', lower(substr(o_orderpriority, 3)), ' ') ELSE substr(o_orderpriority, 3) END AS priority,
 CASE o_orderkey % 4 WHEN 0 THEN ' Email ' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'webchat' ELSE 'Mobile_App' END AS channel,
 CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE CAST(o_orderkey % 120 AS STRING) END AS customer_tenure_months,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE '25-34' END AS age_band,
 CASE o_orderkey % 8 WHEN 0 THEN ' M' WHEN 1 THEN 'male' WHEN 2 THEN 'F ' WHEN 3 THEN 'FEMALE' WHEN 4 THEN 'nb'
   WHEN 5 THEN 'Non-Binary' WHEN 6 THEN 'prefer not to say' END AS gender
FROM orders
"""

# Clean case facts for KPIs, value counts and correlations.
CASE_FACTS = """
SELECT o.o_orderkey AS case_id, o.o_orderdate AS created_at,
 CASE o.o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'pending' END AS status,
 CASE o.o_orderstatus WHEN 'O' THEN 'incident' WHEN 'F' THEN 'service_request' ELSE 'question' END AS case_type,
 lower(c.c_mktsegment) AS category,
 CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' WHEN '5-LOW' THEN 'Low' END AS priority,
 x.n_lines AS first_response_time_hours, x.qty AS resolution_time_hours,
 CASE o.o_orderpriority WHEN '1-URGENT' THEN 50.0E0 WHEN '2-HIGH' THEN 100.0E0 ELSE 150.0E0 END AS sla_target_hours,
 coalesce(x.n_ret, 0) > 2 AS escalated,
 CASE WHEN o.o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o.o_orderkey % 5 + 1 AS STRING) END AS csat_score
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty,
   sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret FROM lineitem GROUP BY l_orderkey) x ON x.l_orderkey = o.o_orderkey
"""

# Text + tabular + label cases (features, models, explanations).
CASES = """
SELECT d.doc_id AS case_id, lower(trim(d.text)) AS case_summary, o.o_orderdate AS created_at,
 CASE o.o_orderkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'webchat' ELSE 'mobile_app' END AS channel,
 CASE o.o_orderstatus WHEN 'O' THEN 'incident' WHEN 'F' THEN 'service_request' ELSE 'question' END AS case_type,
 lower(d.source) AS category,
 CASE c.c_mktsegment WHEN 'MACHINERY' THEN 'enterprise' WHEN 'BUILDING' THEN 'pro' WHEN 'AUTOMOBILE' THEN 'standard' WHEN 'HOUSEHOLD' THEN 'free' END AS plan_tier,
 CAST(floor(abs(c.c_acctbal) / 100) AS DOUBLE) AS customer_tenure_months,
 CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'Urgent' WHEN l.toxic = 1 THEN 'High' WHEN l.quality = 0 THEN 'Medium' WHEN l.quality = 1 THEN 'Low' END AS priority
FROM documents d LEFT JOIN orders o ON o.o_orderkey = d.doc_id
LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN labels l ON l.doc_id = d.doc_id
"""

# Scored predictions without a model: every fifth case is off by one class.
PREDICTIONS_FIXTURE = """
SELECT case_id, actual_priority, predicted_priority, confidence,
 CASE WHEN predicted_priority = 0 THEN confidence ELSE (1.0E0 - confidence) / 3.0E0 END AS prob_Low,
 CASE WHEN predicted_priority = 1 THEN confidence ELSE (1.0E0 - confidence) / 3.0E0 END AS prob_Medium,
 CASE WHEN predicted_priority = 2 THEN confidence ELSE (1.0E0 - confidence) / 3.0E0 END AS prob_High,
 CASE WHEN predicted_priority = 3 THEN confidence ELSE (1.0E0 - confidence) / 3.0E0 END AS prob_Urgent
FROM (
 SELECT case_id, actual_priority,
  (actual_priority + CASE WHEN case_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS predicted_priority,
  (case_id % 700 + 300) / 1000.0E0 AS confidence
 FROM (SELECT case_id, CASE priority WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Urgent' THEN 3 END AS actual_priority
       FROM case_facts WHERE priority IS NOT NULL) a
) b
"""

# Three "models" = three differently shifted copies of the fixture.
MODEL_PREDICTIONS = """
SELECT 'Logistic Regression' AS model, case_id, actual_priority,
 (actual_priority + CASE WHEN case_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS predicted_priority FROM predictions_fixture
UNION ALL
SELECT 'Decision Tree' AS model, case_id, actual_priority,
 (actual_priority + CASE WHEN case_id % 3 = 0 THEN 1 ELSE 0 END) % 4 AS predicted_priority FROM predictions_fixture
UNION ALL
SELECT 'Random Forest' AS model, case_id, actual_priority,
 (actual_priority + CASE WHEN case_id % 7 = 0 THEN 3 ELSE 0 END) % 4 AS predicted_priority FROM predictions_fixture
"""

# Generated assistant turns play the role of model-written explanations.
GENERATED_TEXTS = """
SELECT conv_id AS case_id, turn, text AS generated_text,
 CASE conv_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' ELSE 'Urgent' END AS priority
FROM conversations WHERE role = 'assistant'
"""

VIEWS = {
    "raw_cases": (RAW_CASES, ("orders",)),
    "case_facts": (CASE_FACTS, ("orders", "customer", "lineitem")),
    "cases": (CASES, ("documents", "orders", "customer", "labels")),
    "predictions_fixture": (PREDICTIONS_FIXTURE, ("case_facts",)),
    "model_predictions": (MODEL_PREDICTIONS, ("predictions_fixture",)),
    "generated_texts": (GENERATED_TEXTS, ("conversations",)),
}


# Spark joins in the order of the text: the long texts would be shuffled and sorted once by the order and again by its customer.
# Orders meet their customers first (narrow rows), then the texts are shuffled once, by doc_id.
SPARK_JOINS = {"cases": [(
    "LEFT JOIN orders o ON o.o_orderkey = d.doc_id\nLEFT JOIN customer c ON c.c_custkey = o.o_custkey",
    "LEFT JOIN (orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey) ON o.o_orderkey = d.doc_id")]}


def spark_sql(name: str) -> str:
    """The view's text for Spark: the same rows, with joins in an order that moves less."""
    sql = VIEWS[name][0]
    for old, new in SPARK_JOINS.get(name, []):
        if old not in sql:
            raise ValueError(f"the joins of {name} have changed")
        sql = sql.replace(old, new)
    return sql


def _deps(name: str, seen: list[str]) -> list[str]:
    for d in VIEWS.get(name, ("", ()))[1]:
        if d in VIEWS:
            _deps(d, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named views (and their deps)."""
    order: list[str] = []
    for n in names:
        _deps(n, order)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][0].strip()})" for n in order)
    return f"WITH {ctes}\n{sql.strip()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table of the test data as a DataFrame."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Tables whose rows carry long text (tokenising and n-grams per row are
# CPU-bound) and the key they are spread on when the scan is under-split.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id"}


def register_tables(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        df = table(spark, sf_dir, n)
        if n in TEXT_TABLES:
            df = spread(spark, df, TEXT_TABLES[n])
        df.createOrReplaceTempView(n)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a fixture view (registering the base tables it reads)."""
    prepare(spark)
    order = _deps(name, [])
    base = sorted({d for v in order for d in VIEWS[v][1] if d not in VIEWS})
    register_tables(spark, sf_dir, base)
    df = None
    for v in order:
        df = spark.sql(spark_sql(v))
        df.createOrReplaceTempView(v)
    return df
