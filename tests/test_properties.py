"""Properties of the model-backed operators (SURVEY §5 (3))."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from casetriage.operators import cleaning as C
from casetriage.operators import features as FE
from casetriage.operators import splits as SP
from casetriage.plans import flagship as FL
from casetriage.sources.fixtures import view

from conftest import SF_SMALL


def test_lr_probabilities_and_linear_shap_additivity(spark):
    from casetriage.plans.explain import explain_batch_lr
    e = explain_batch_lr(spark, SF_SMALL)
    rows = e.select("probs", "phi", "base_value", "margin", "explained_class", "confidence").collect()
    assert rows
    for r in rows:
        assert abs(sum(r.probs) - 1.0) < 1e-9
        assert abs(sum(r.phi) + r.base_value - r.margin) < 1e-6   # Shapley additivity
        assert r.explained_class == max(range(4), key=lambda k: r.probs[k])


def test_onehot_rows_and_tfidf_norms(spark):
    t = FL.fit_triage(spark, SF_SMALL, "lr")
    x = t.space.transform(t.data).select(vector_to_array("features").alias("x")).collect()
    text = t.space.slots(block="text")
    for src in ["channel", "case_type", "category", "plan_tier", "customer_tenure_months"]:
        slots = t.space.slots(source_col=src)
        assert slots
        for r in x:
            assert sum(r.x[i] for i in slots) in (0.0, 1.0)
    for r in x:
        n2 = sum(r.x[i] ** 2 for i in text)
        assert n2 == 0.0 or abs(n2 - 1.0) < 1e-9


def test_unknown_category_is_all_zeros(spark):
    t = FL.fit_triage(spark, SF_SMALL, "lr")
    one = t.data.limit(1).withColumn("channel", F.lit("carrier_pigeon"))
    x = t.space.transform(one).select(vector_to_array("features").alias("x")).first().x
    assert sum(x[i] for i in t.space.slots(source_col="channel")) == 0.0


def test_split_partitions_input_and_keeps_ratio(spark):
    lab = view(spark, SF_SMALL, "cases").filter("priority IS NOT NULL").withColumn(
        "priority_encoded", F.expr("CASE priority WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 "
                                   "WHEN 'High' THEN 2 ELSE 3 END"))
    s = SP.stratified_split(lab)
    assert s.count() == lab.count()
    assert s.select("case_id").distinct().count() == lab.count()
    counts = {r[0]: r[1] for r in lab.groupBy("priority_encoded").count().collect()}
    quotas = SP.largest_remainder_quotas(counts, 0.2)
    got = {r[0]: r[1] for r in s.filter("split = 'test'").groupBy("priority_encoded").count().collect()}
    assert {k: got.get(k, 0) for k in counts} == quotas
    folds = SP.stratified_folds(lab, k=3).groupBy("priority_encoded", "fold").count().collect()
    per = {}
    for r in folds:
        per.setdefault(r.priority_encoded, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per.values())


def test_rank_within_class_is_exact(spark):
    lab = view(spark, SF_SMALL, "raw_cases").select("case_id", "row_seq", "channel")
    ranked = SP.rank_within_class(lab, "channel", "row_seq").collect()
    by = {}
    for r in ranked:
        by.setdefault(r.channel, []).append(r.class_rank)
    for v in by.values():
        assert sorted(v) == list(range(1, len(v) + 1))


def test_keep_last_is_idempotent_and_latest(spark):
    raw = view(spark, SF_SMALL, "raw_cases")
    once = C.dedup_latest(raw)
    twice = C.dedup_latest(once)
    assert once.count() == twice.count() == raw.select("case_id").distinct().count()
    best = raw.groupBy("case_id").agg(F.max(F.struct("file_seq", "row_seq")).alias("m"))
    j = once.join(best, "case_id")
    assert j.filter((F.col("file_seq") != F.col("m.file_seq")) | (F.col("row_seq") != F.col("m.row_seq"))).count() == 0


def test_stream_equals_batch(spark):
    import __spark_entry__ as E
    from casetriage.plans.explain import lr_explainer
    from casetriage.streaming.scoring import score_batch
    stream = E.queries()["stream_scored"](spark, SF_SMALL)
    t, ex, slots = lr_explainer(spark, SF_SMALL)
    new = view(spark, SF_SMALL, "cases").filter("priority IS NULL").select(*FL.FEATURE_COLS)
    batch = score_batch(new.withColumn("version", F.lit(2)), t.space, t.model, ex, slots)
    cols = ["case_id", "predicted_priority", "confidence", "narrative"]
    a = sorted(tuple(r) for r in stream.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert a == b and len(a) == new.count()


def test_tfidf_idf_is_smoothed_plus_one(spark):
    cases = view(spark, SF_SMALL, "cases")
    tm = FE.fit_text(cases, max_features=50)
    import math
    stats = {r.term: r.df for r in FE.term_stats(cases).collect()}
    for term, idf in zip(tm.vocabulary, tm.idf):
        assert abs(idf - (math.log((1 + tm.n_docs) / (1 + stats[term])) + 1)) < 1e-12
    assert tm.vocabulary == sorted(tm.vocabulary)
