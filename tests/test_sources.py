"""Hand-made monthly CSV files: ragged rows, quoted newlines, keep-last
across months, glob order, lineage, form rows."""

import csv
import os
import tempfile

from pyspark.sql import functions as F

from casetriage.operators import cleaning as C
from casetriage.sources import readers as RD

COLS = ["case_id", "snapshot_at", "created_at", "case_summary", "channel", "case_type", "category",
        "subcategory", "plan_tier", "customer_tenure_months", "priority", "status", "region_uk",
        "sentiment", "tags", "assigned_team", "escalation_team", "resolution_code", "csat_score",
        "escalated", "gender", "age_band", "first_response_time_hours"]


def _row(cid, summary, gender="M", priority="High"):
    r = {c: f"{c}-{cid}" for c in COLS}
    r.update(case_id=cid, case_summary=summary, gender=gender, priority=priority, age_band="25-34",
             channel=" Email ", customer_tenure_months="12", created_at="2025-01-05 10:00:00")
    return [r[c] for c in COLS]


def _write(path, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(COLS)
        w.writerows(rows)


def _files():
    d = tempfile.mkdtemp(prefix="ct-src-")
    jan = [_row("ND-1", "printer broken\nurgent please"), _row("ND-2", "login failed")]
    short = _row("ND-3", "short row")
    del short[20]  # gender missing: everything after shifts left
    feb = [_row("ND-1", "printer still broken", priority="Urgent"), short]
    _write(os.path.join(d, "Q1-Jan.csv"), jan)
    _write(os.path.join(d, "Q1-Feb.CSV"), feb)
    return d


def test_ordered_load_repair_and_keep_last(spark):
    d = _files()
    paths = [os.path.join(d, "Q1-Jan.csv"), os.path.join(d, "Q1-Feb.CSV")]
    df = RD.read_monthly(spark, paths)
    rows = {(r.case_id, r.file_seq): r for r in df.collect()}
    assert len(rows) == 4
    assert rows[("ND-1", 1)].case_summary == "printer broken\nurgent please"   # quoted newline
    r3 = rows[("ND-3", 2)]
    assert r3.was_repaired and r3.gender == "" and r3.age_band == "25-34"
    assert r3.first_response_time_hours == "first_response_time_hours-ND-3"
    latest = {r.case_id: r for r in C.dedup_latest(df).collect()}
    assert latest["ND-1"].priority == "Urgent" and latest["ND-1"].file_seq == 2
    clean = C.clean_cases(df)
    assert {r.case_id for r in clean.collect()} == {"ND-1", "ND-2", "ND-3"}
    assert {r.channel for r in clean.collect()} == {"email"}


def test_files_with_other_headers_stack_by_name(spark):
    """Each file by its own header; equal base names in two folders; short and long rows are named."""
    d = tempfile.mkdtemp(prefix="ct-months-")
    texts = {"2024/Q1 Jan+.csv": "case_id,a,b\nC1,1,2\n", "2025/Q1 Jan+.csv": "case_id,b,a,extra\nC2,20,10,x\nC1,5,6,y\n",
             "2025/bad.csv": "case_id,a,b\nC3,1\nC4\nC5,1,2,3\nC6,7,8\n"}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
    df = RD.read_monthly(spark, [os.path.join(d, n) for n in texts], repair_at=1)
    got = {(r.case_id, r.file_seq): (r.a, r.b, r.extra, r.record_status) for r in df.collect()}
    assert got == {("C1", 1): ("1", "2", None, "ok"), ("C2", 2): ("10", "20", "x", "ok"), ("C1", 2): ("6", "5", "y", "ok"),
                   ("C3", 3): ("", "1", None, "repaired"), ("C4", 3): (None, None, None, "short"),
                   ("C5", 3): ("1", "2", None, "long"), ("C6", 3): ("7", "8", None, "ok")}
    assert {r.record_text for r in df.where("record_status in ('short', 'long')").collect()} == {"C4", "C5,1,2,3"}
    assert {r.source_file for r in RD.with_source_file(df).collect()} == {"Q1 Jan+.csv", "bad.csv"}
    assert {r.a for r in C.dedup_latest(df).where("case_id = 'C1'").collect()} == {"6"}
    narrow = RD.read_monthly(spark, [os.path.join(d, "2024/Q1 Jan+.csv")])
    assert {"was_repaired", "record_status"} <= set(narrow.columns) and RD.CORRUPT not in narrow.columns


def test_glob_lineage_and_errors(spark):
    d = _files()
    g = RD.read_glob(spark, d)
    # name order: Q1-Feb.CSV before Q1-Jan.csv
    assert {r.source_file: r.file_seq for r in RD.with_source_file(g).collect()} == \
        {"Q1-Feb.CSV": 1, "Q1-Jan.csv": 2}
    empty = tempfile.mkdtemp(prefix="ct-empty-")
    try:
        RD.read_glob(spark, empty)
        raise AssertionError("expected FileNotFoundError")
    except FileNotFoundError:
        pass


def test_form_rows_and_validation(spark):
    df = RD.cases_from_rows(spark, [
        {"case_id": "NEW-1", "case_summary": " Site DOWN ", "channel": "phone", "case_type": "incident",
         "category": "technical_support", "plan_tier": "pro", "customer_tenure_months": 7},
        {"case_id": "NEW-2", "case_summary": "", "channel": "fax", "case_type": "incident",
         "category": "nonsense", "plan_tier": "gold", "customer_tenure_months": 999}])
    v = {r.case_id: r for r in C.validate_cases(df).collect()}
    assert v["NEW-1"].is_valid and v["NEW-1"].reasons == []
    assert not v["NEW-2"].is_valid
    assert set(v["NEW-2"].reasons) == {"invalid channel", "invalid category", "invalid plan_tier",
                                       "tenure out of range", "empty summary"}


def test_write_and_export(spark):
    d = tempfile.mkdtemp(prefix="ct-out-")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    RD.export_predictions(df, df.select("id"), d)
    back = RD.read_cases(spark, os.path.join(d, "predictions"), "csv")
    assert back.count() == 5 and set(back.columns) == {"id", "x"}


def test_union_months_by_name(spark):
    a = spark.createDataFrame([("ND-1", "x")], "case_id string, gender string")
    b = spark.createDataFrame([("ND-2",)], "case_id string")
    u = C.union_months([a, b])
    assert {(r.case_id, r.gender) for r in u.collect()} == {("ND-1", "x"), ("ND-2", None)}
