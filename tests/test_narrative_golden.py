"""One hand-built explanation rendered by every text operator, compared with
strings written out by hand from the reference's template rules."""

from pyspark.sql import functions as F

from casetriage.operators.explain import narrative as N

DOC_SCHEMA = ("case_id string, priority string, confidence double, probabilities map<string,double>, "
              "positive array<struct<feature:string,value:string,contribution:double,explanation:string>>, "
              "negative array<struct<feature:string,value:string,contribution:double,explanation:string>>, "
              "top_tokens array<struct<token:string,contribution:double>>, semantic_groups map<string,double>")


def _doc(spark):
    row = ("ND-2025-000007", "Urgent", 0.625,
           {"Low": 0.05, "Medium": 0.125, "High": 0.2, "Urgent": 0.625},
           [("case_type", "incident", 0.145, "Incidents typically require faster response times"),
            ("channel", "phone", 0.125, "Phone contact typically signals higher urgency"),
            ("customer_tenure_months", "30.0", 0.02, "Long-tenured customers are high-value relationships")],
           [("plan_tier", "free", -0.0004, "Free tier has lowest support priority")],
           [("outage", 0.31234), ("down", -0.0015)],
           {"urgency_keywords": 0.311, "financial_keywords": 0.0, "account_keywords": -0.02,
            "technical_keywords": 0.06})
    df = spark.createDataFrame([row], DOC_SCHEMA)
    # maps keep declared order only when built in order (as the pipeline does)
    ordered = {"probabilities": ["Low", "Medium", "High", "Urgent"],
               "semantic_groups": ["urgency_keywords", "financial_keywords", "account_keywords",
                                   "technical_keywords"]}
    for col, keys in ordered.items():
        df = df.withColumn(col, F.map_from_arrays(F.array(*[F.lit(k) for k in keys]),
                                                  F.array(*[F.col(col)[k] for k in keys])))
    return N.with_number_text(df)


def test_template_texts(spark):
    r = _doc(spark).select(N.narrate().alias("n"), N.summarise().alias("s"), N.factor_list().alias("f"),
                           N.prompt_context().alias("c")).first()
    assert r.n == ("This case has been classified as **Urgent** priority with 62% confidence. "
                   "The main contributing factors are: case type (incident), channel (phone), "
                   "customer tenure months (30.0). Incidents typically require faster response times. "
                   "The case text shows urgency keywords patterns.")
    assert r.s == "Classified as Urgent priority primarily due to case type (incident)."
    assert r.f == ("Factors contributing to Urgent priority:\n"
                   "• Case Type: incident (+0.14)\n  → Incidents typically require faster response times\n"
                   "• Channel: phone (+0.12)\n  → Phone contact typically signals higher urgency\n"
                   "• Customer Tenure Months: 30.0 (+0.02)\n  → Long-tenured customers are high-value relationships\n"
                   "\n\nCounterbalancing factors:\n"
                   "• Plan Tier: free (-0.00)\n  → Free tier has lowest support priority")
    assert r.c == ("Case ID: ND-2025-000007\nPredicted Priority: Urgent\nConfidence: 62.5%\n\n"
                   "Class Probabilities:\n  - Low: 5.0%\n  - Medium: 12.5%\n  - High: 20.0%\n  - Urgent: 62.5%\n\n"
                   "Positive Contributing Factors:\n"
                   "  - case_type=incident: +0.145\n    Reason: Incidents typically require faster response times\n"
                   "  - channel=phone: +0.125\n    Reason: Phone contact typically signals higher urgency\n"
                   "  - customer_tenure_months=30.0: +0.020\n    Reason: Long-tenured customers are high-value relationships\n\n"
                   "Negative Contributing Factors:\n"
                   "  - plan_tier=free: -0.000\n    Reason: Free tier has lowest support priority\n\n"
                   "Key Text Tokens:\n  - \"outage\": +0.312\n  - \"down\": -0.002\n\n"
                   "Semantic Theme Contributions:\n  - urgency_keywords: +0.311\n  - account_keywords: -0.020\n"
                   "  - technical_keywords: +0.060")


def test_no_factor_fallbacks(spark):
    d = _doc(spark).withColumn("positive", F.array().cast(
        "array<struct<feature:string,value:string,contribution:double,explanation:string>>"))
    r = d.select(N.narrate().alias("n"), N.summarise().alias("s")).first()
    assert r.s == "Classified as Urgent priority based on overall case characteristics."
    assert r.n == ("This case has been classified as **Urgent** priority with 62% confidence. "
                   "The case text shows urgency keywords patterns.")
