"""Continuous scoring of newly arriving cases (J1) with latest-version-wins
for re-sent cases (J2).

Source: a folder of case files read as a stream with an explicit schema.
Each micro-batch is cleaned and validated (B13, B21), scored by the fitted
feature pipeline + classifier, explained (linear Shapley values, template
narrative), de-duplicated to the latest version per case, and written to
``<out>/epoch=<id>`` with overwrite -- a replayed epoch rewrites its own
folder, so the sink is idempotent under task / executor loss.  Readers take
the latest version per case with ``latest_scores`` (an aggregation with
map-side combine, never a rewrite of the whole target).

With ``stateful=True`` the stream itself keeps the latest version of every
case in its keyed state; the epoch folders then are a log of changes, and
``latest_state`` reads the state as a table without looking at any epoch.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import cleaning as C
from ..operators import models as M
from ..operators.explain import document as D
from ..operators.explain import narrative as N

# The state holds a row for every case ever seen: on disk, not in the executors' heap.
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT_COLS = ["case_id", "version", "is_valid", "reasons", "predicted_priority", "priority",
            "confidence", "narrative", "summary", "document"]


def score_batch(df: DataFrame, space, model, explainer, slots, version: str = "version") -> DataFrame:
    """The per-batch plan (also usable on a static DataFrame).

    One branch for valid and invalid rows: every pipeline stage keeps
    invalid values (unknown category, unparsable tenure), so all rows are
    scored and the model outputs are nulled where validation failed.  A
    union of two filtered branches would read the batch twice and lose the
    input partitioning the keep-latest aggregation can reuse."""
    from ..plans.explain import explain_frame
    from ..functions.scalar import VALID_OPTIONS
    from ..plans.flagship import normalise_cases
    # the categories in use are the deployment's: accept those the model was fitted on
    known = space.tabular.categories.get("category") if space.tabular else None
    options = {**VALID_OPTIONS, "category": known} if known else VALID_OPTIONS
    d = C.validate_cases(normalise_cases(df), options)
    scored = M.score(model, d, space)
    e = explain_frame(scored, explainer, slots, features="features", pred_col="predicted_priority",
                      probs=vector_to_array(F.col("probability")))
    e = N.with_number_text(e)
    ok = F.col("is_valid")
    return e.select(
        "case_id", version, "is_valid", F.array_join("reasons", "; ").alias("reasons"),
        F.when(ok, F.col("predicted_priority")).alias("predicted_priority"),
        F.when(ok, F.col("priority")).alias("priority"),
        F.when(ok, F.col("confidence")).alias("confidence"),
        F.when(ok, N.narrate()).alias("narrative"), F.when(ok, N.summarise()).alias("summary"),
        F.when(ok, F.to_json(D.to_document(), {"ignoreNullFields": "false"})).alias("document"))


def keep_latest(rows: DataFrame, key: str = "case_id", version: str = "version") -> DataFrame:
    """J2 in the stream: the latest version of every key as streaming state.

    A streaming aggregation, so the versions of a case that is re-sent many
    times are combined in every input task before the shuffle.  Of equal
    versions the later micro-batch wins; its timestamp is logged with the
    offsets, so a replayed batch decides alike.  Versions older than the one
    kept change nothing; a null version is older than any other."""
    seen = rows.withColumn("_seen", F.current_timestamp())
    latest = F.max_by(F.struct(*rows.columns), F.struct(version, "_seen"))
    return seen.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")


def score_stream(spark: SparkSession, in_dir: str, schema: StructType, space, model, explainer,
                 slots, out_dir: str, checkpoint: str, version: str = "version",
                 max_files_per_trigger: int = 100, fmt: str = "parquet", stateful: bool = False):
    """Start the stream (trigger availableNow: process what is there,
    then stop) and wait for it.  Returns the finished StreamingQuery.

    ``stateful`` keeps the latest version of every case in the stream's state
    (read with ``latest_state``); a checkpoint belongs to one of the two modes."""
    src = (spark.readStream.format(fmt).schema(schema)
           .option("maxFilesPerTrigger", max_files_per_trigger).load(in_dir))
    cores = spark.sparkContext.defaultParallelism
    if max_files_per_trigger < cores:
        # A trigger admits fewer files than there are cores, so scoring would
        # run in a few tasks: spread the batch round-robin (bounded by the
        # trigger size; not by case, so a case re-sent many times cannot
        # pile up in one task; the sink's keep-latest still combines
        # map-side before its shuffle).
        src = src.repartition(cores * 2)
    out = score_batch(src, space, model, explainer, slots, version)

    if stateful:
        out = keep_latest(out, version=version)

    def sink(batch: DataFrame, epoch_id: int) -> None:
        latest = batch if stateful else C.dedup_latest(batch, "case_id", (version,))  # J2 inside the batch
        latest.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/epoch={epoch_id}")

    before = spark.conf.get(STATE_PROVIDER)
    try:
        if stateful:
            spark.conf.set(STATE_PROVIDER, ROCKSDB)
        q = (out.writeStream.outputMode("update" if stateful else "append").foreachBatch(sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    q.awaitTermination()
    return q


def latest_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """J2 from the state of a ``stateful`` stream: one row per case, its latest
    version as of the last finished micro-batch.  No epoch is read and nothing
    is aggregated or shuffled."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("value.valueWithExtremumOrdering.*")


def latest_scores(spark: SparkSession, out_dir: str, version: str = "version") -> DataFrame:
    """J2 on read: one row per case, the latest version (later epoch wins
    ties)."""
    d = spark.read.parquet(out_dir)
    return C.dedup_latest(d, "case_id", (version, "epoch")).drop("epoch")
