"""J2 in stream state: re-sends, old versions, replayed triggers and restarts."""
import pytest
from pyspark.sql import functions as F

from casetriage.operators.cleaning import dedup_latest
from casetriage.streaming import scoring as S

SCHEMA = "case_id string, version int, t string"


@pytest.fixture
def stream(spark, tmp_path, monkeypatch):
    """run(): the stream over all files that are there, with the scoring left out."""
    monkeypatch.setattr(S, "score_batch", lambda df, *a: df)
    base = str(tmp_path)

    def send(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        schema = spark.createDataFrame([], SCHEMA).schema
        S.score_stream(spark, f"{base}/in", schema, None, None, None, None, f"{base}/out", f"{base}/ck", max_files_per_trigger=1, stateful=True)
        return sorted((tuple(r) for r in S.latest_state(spark, f"{base}/ck").collect()), key=str)
    return send, run, base


def test_state_is_the_latest_version_through_resends_and_restarts(spark, stream):
    send, run, base = stream
    send([("a", 1, "a1"), ("b", 5, "b5"), (None, 1, "n1"), ("c", None, "c-")])
    send([("a", 3, "a3"), ("a", 2, "a2"), ("b", 4, "b4")])
    assert run() == sorted([("a", 3, "a3"), ("b", 5, "b5"), (None, 1, "n1"), ("c", None, "c-")], key=str)
    send([("a", 3, "a3 again"), ("b", 1, "b1"), ("c", 0, "c0")])  # a tie, an old version, a version after none
    want = sorted([("a", 3, "a3 again"), ("b", 5, "b5"), (None, 1, "n1"), ("c", 0, "c0")], key=str)
    assert run() == want and run() == want  # restarts, the second without new files
    epochs = dedup_latest(spark.read.parquet(f"{base}/out"), "case_id", ("version", "epoch")).select("case_id", "version", "t")
    assert sorted((tuple(r) for r in epochs.collect()), key=str) == want


def test_a_lost_commit_is_replayed(stream):
    import os
    send, run, base = stream
    send([("a", 1, "a1")])
    send([("a", 2, "a2"), ("b", 1, "b1")])
    want = run()
    last = max(int(f) for f in os.listdir(f"{base}/ck/commits") if f.isdigit())
    os.remove(f"{base}/ck/commits/{last}")  # as if the driver had died before the epoch was done
    for f in (f"{base}/ck/commits/.{last}.crc",):
        if os.path.exists(f):
            os.remove(f)
    assert run() == want == [("a", 2, "a2"), ("b", 1, "b1")]


def test_a_case_sent_many_times_is_combined_before_the_shuffle(spark, stream):
    send, run, base = stream
    spark.range(20000).select(F.lit("hot").alias("case_id"), F.col("id").cast("int").alias("version"),
                              F.concat(F.lit("t"), "id").alias("t")).coalesce(1).write.parquet(f"{base}/in")
    assert run() == [("hot", 19999, "t19999")]


def test_reading_the_state_has_no_shuffle(spark, stream):
    send, run, base = stream
    send([("a", 1, "a1")])
    run()
    assert "Exchange" not in S.latest_state(spark, f"{base}/ck")._jdf.queryExecution().executedPlan().toString()


def test_resent_cases_are_joined_by_all_tasks(spark):
    """One task writes the re-sent cases; what is before it, their joins and filters, has tasks of its own."""
    from casetriage.plans.queries import _resent
    out = _resent(spark.range(800, numPartitions=4).select(F.col("id").alias("case_id"), F.lit("email").alias("channel")))
    assert out.rdd.getNumPartitions() == 1 and out.count() == 800 and out.select("version").distinct().collect() == [(2,)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Coalesce" not in plan
