"""Narrative, grounding and keyword operators on hand-made rows."""

from pyspark.sql import functions as F

from casetriage.operators.explain import narrative as N
from casetriage.operators.explain.vocab import extract_keywords, token_groups


def test_grounding_rules(spark):
    df = spark.createDataFrame([
        ("It seems the case is Urgent because of channel.", "Urgent", "ND-1"),
        ("Priority High due to case type incident; see nd-9.", "High", "ND-1"),
        ("Nothing relevant here.", "Low", "ND-1")], "t string, p string, c string")
    feats = F.array(F.lit("case_type"), F.lit("channel"))
    r = df.select(N.check_grounding(F.col("t"), F.col("p"), F.col("c"), feats).alias("v")).collect()
    assert r[0].v.warnings == ["Speculative language detected: 'it seems'"]
    assert r[1].v.warnings == ["Case ID mentioned but doesn't match source data"]
    assert set(r[2].v.warnings) == {"Generated text doesn't mention predicted priority: Low",
                                    "No source features mentioned in explanation"}
    res = df.select(N.resolve_text(F.col("t"), N.check_grounding(F.col("t"), F.col("p"), F.col("c"), feats),
                                   F.lit("template"), "strict").alias("r")).collect()
    assert [x.r.source for x in res] == ["template", "template", "template"]


def test_keywords_whole_word_and_token_groups(spark):
    df = spark.createDataFrame([("The API is DOWN, login failed",), ("download",)], "t string")
    m = df.select(extract_keywords("t").alias("m")).collect()
    assert m[0].m == {"urgency_keywords": ["down", "failed"], "account_keywords": ["login"],
                      "technical_keywords": ["api"]}
    assert m[1].m == {}
    vocab = spark.createDataFrame([("download",), ("api error",)], "term string")
    pairs = {(r.term, r.group) for r in token_groups(vocab).collect()}
    assert pairs == {("download", "urgency_keywords"), ("api error", "technical_keywords")}
