"""Golden numbers of the reference (results files) reproduced by our
operators from the 16 confusion counts and the class totals."""

from pyspark.sql import functions as F

from casetriage.operators import evaluation as E
from casetriage.operators.splits import largest_remainder_quotas

# actual x predicted, Low..Urgent (reference LR test predictions)
GOLDEN_CM = [[50, 29, 1, 1], [24, 99, 22, 1], [0, 11, 48, 15], [1, 1, 12, 26]]


def _golden_rows(spark):
    rows = [(a, p) for a in range(4) for p in range(4) for _ in range(GOLDEN_CM[a][p])]
    return spark.createDataFrame(rows, "actual_priority int, predicted_priority int")


def test_confusion_matrix_roundtrip(spark):
    cm = {(r.actual, r.predicted): r.n for r in E.confusion_matrix(_golden_rows(spark)).collect()}
    assert all(cm[(a, p)] == GOLDEN_CM[a][p] for a in range(4) for p in range(4))


def test_classification_report_matches_reference(spark):
    rep = {r["class"]: r for r in E.classification_report(_golden_rows(spark), dp=3).collect()}
    expect = {"Low": (0.667, 0.617, 0.641, 81), "Medium": (0.707, 0.678, 0.692, 146),
              "High": (0.578, 0.649, 0.611, 74), "Urgent": (0.605, 0.65, 0.627, 40)}
    for k, (p, r, f, s) in expect.items():
        got = rep[k]
        assert abs(got.precision - p) <= 5e-4 and abs(got.recall - r) <= 5e-4
        assert abs(got.f1 - f) <= 5e-4 and got.support == s


def test_summary_matches_reference(spark):
    s = E.summary_metrics(_golden_rows(spark), dp=3).first()
    assert (s.accuracy, s.macro_f1, s.weighted_f1, s.urgent_recall, s.urgent_f1) == \
        (0.654, 0.643, 0.655, 0.65, 0.627)


def test_model_selection_by_urgent_recall(spark):
    rows = [("Logistic Regression", 0.654, 0.643, 0.655, 0.65, 0.627),
            ("Decision Tree", 0.648, 0.605, 0.64, 0.4, 0.485),
            ("Random Forest", 0.669, 0.651, 0.67, 0.625, 0.588)]
    cmp = spark.createDataFrame(rows, "model string, accuracy double, macro_f1 double, "
                                      "weighted_f1 double, urgent_recall double, urgent_f1 double")
    assert E.select_model(cmp).first().model == "Logistic Regression"
    assert E.metrics_long(cmp).count() == 9


def test_split_quotas_reproduce_reference_class_counts():
    q = largest_remainder_quotas({0: 402, 1: 729, 2: 370, 3: 202}, 0.2)
    assert q == {0: 81, 1: 146, 2: 74, 3: 40}
    assert sum(q.values()) == 341


def test_split_expected_counts_sf001(spark):
    """FIXTURES 2.3: test 60/10/8/2 of 299/49/42/9 labelled rows."""
    import __spark_entry__ as ENTRY
    from conftest import SF_MID
    bal = ENTRY.queries()["class_balance"](spark, SF_MID)
    got = {(r.split, r.priority_encoded): r["count"] for r in bal.collect()}
    assert [got[("test", k)] for k in range(4)] == [60, 10, 8, 2]
    assert [got[("train", k)] for k in range(4)] == [239, 39, 34, 7]
    assert F is not None
