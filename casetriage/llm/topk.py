"""Exact top-k search by a three-phase uniform threshold.

A score is the sum of the partial inner products of LISTS column blocks, each
a local score list.  (1) Every task gathers the best entries of each of its
lists, resolved to whole scores; the k-th best of all is a safe cutoff.  (2)
The cutoff goes out to all tasks: an entry that reaches it has a share of
cutoff / LISTS in one list at least, so the lists yield just such entries.
(3) Their remaining partial scores are added where the rows lie, and those at
the cutoff or above are ranked.  Queries go in blocks against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Column blocks of a vector; query vectors of a block; cells of a score matrix in a task.
LISTS, QUERY_BLOCK, CELLS = 2, 4096, 1 << 21
#: Scores saturate here, as a long holds no more; larger components than that can't be told apart.
LARGEST = 1 << 62


def quantised(vec: str, scale: int) -> Column:
    return F.expr(f"transform({vec}, x -> cast(floor(least(greatest(cast(x as double) * {scale}, -{LARGEST}D), {LARGEST}D)) as bigint))")


def _usable(vec: str) -> Column:
    return F.expr(f"{vec} is not null and forall({vec}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as (rows, width) integers; shorter vectors end in zeros."""
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = flat
    return out


def _products(q: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
    """Local scores of every list: partial inner products of all queries and rows, exact."""
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (q, x))
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
    kind = np.float64 if top < 2**53 else np.int64 if top < LARGEST else object  # Python's own numbers beyond 64 bits
    return [(q[:, b].astype(kind) @ x[:, b].T.astype(kind)) for b in np.array_split(np.arange(width), LISTS)]


def _whole(parts: list[np.ndarray]) -> np.ndarray:
    total = sum(parts)
    return np.clip(total, -LARGEST, LARGEST).astype(np.int64) if total.dtype == object else total.astype(np.int64)


def _rows_of(batches, width, step):
    """(ids, matrix) of at most ``step`` rows of (cid, v) batches."""
    for batch in batches:
        for lo in range(0, len(batch), step):
            part = batch.slice(lo, step)
            yield part.column(0).to_numpy(), _matrix(part.column(1), width)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Order of the k best, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def _search_block(classes: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(q, cid, score): the k best classes of every row of ``queries``, ties to the smaller cid, perhaps with more."""
    spark = classes.sparkSession
    n_q, width = queries.shape
    step = max(1, CELLS // max(n_q, 1))
    shared = spark.sparkContext.broadcast(queries)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((n_q, 0), 0, np.int64)
        for _, x in _rows_of(batches, width, step):
            lists = _products(shared.value, x)
            whole = _whole(lists)
            cols = []
            for part in lists:
                m = min(k, part.shape[1])
                cols.append(np.argpartition(-part.astype(float), m - 1, axis=1)[:, :m])  # any entries make a safe cutoff
            at = np.sort(np.concatenate(cols, axis=1), axis=1)
            again = np.zeros(at.shape, bool)
            again[:, 1:] = at[:, 1:] == at[:, :-1]
            got = np.where(again, np.iinfo(np.int64).min, np.take_along_axis(whole, at, 1))
            held = np.concatenate([held, got], axis=1)
            held = -np.sort(-held, axis=1)[:, :k]
        row, col = np.nonzero(held > np.iinfo(np.int64).min)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(held[row, col])], names=["q", "score"])

    lists = classes.select("cid", "v").mapInArrow(first, "q long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    kth = lists.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("q").agg(
        F.count("*").alias("n"), F.min("score").alias("kth")).toPandas()
    lowest = np.iinfo(np.int64).min
    cutoff = np.full(n_q, lowest)
    full = kth[kth["n"] >= k]
    cutoff[full["q"].to_numpy()] = full["kth"].to_numpy()
    cut = spark.sparkContext.broadcast(cutoff)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = cut.value
        share = np.where(limit > lowest, limit / LISTS, -np.inf)[:, None]
        for ids, x in _rows_of(batches, width, step):
            lists = _products(shared.value, x)
            passing = np.asarray(lists[0] >= share, bool)
            for part in lists[1:]:
                passing |= np.asarray(part >= share, bool)
            row, col = np.nonzero(passing)
            score = _whole([part[row, col] for part in lists])
            keep = score >= limit[row]
            row, col, score = row[keep], col[keep], score[keep]
            # a query needs no more than k of one piece of rows
            order = np.lexsort((ids[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            start = np.searchsorted(row, row)
            keep = np.arange(len(row)) - start < k
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(row[keep]), pa.array(ids[col[keep]]), pa.array(score[keep])], names=["q", "cid", "score"])

    return classes.select("cid", "v").mapInArrow(second, "q long, cid long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The ``k`` rows of highest integer inner product with each query row, of all other rows.

    Components become floor(scale * x); ``queries`` is a condition on
    ``vec_id``.  Returns (query_id, rank, vec_id, score), ties to the smaller
    id; fewer rows where there are fewer candidates.  Vectors that are null or
    hold null, NaN or infinite components, and rows without id, take no part;
    an empty vector scores 0; a shorter vector counts as ending in zeros;
    scores beyond 2**62 saturate there; equal rows count once.  Equal vectors are
    searched once and share their lists.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"))
            .where(F.col("vec_id").isNotNull() & _usable("e")).select("vec_id", quantised("e", scale).alias("v")).distinct())
    rows = written(spark, rows, "vectors")
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("cid"))
    classes = written(spark, classes.repartition(2 * spark.sparkContext.defaultParallelism, "cid"), "vector-classes")
    # a query's list needs the k + 1 smallest ids of a class at most (its own may be among them)
    order = Window.partitionBy("v").orderBy("vec_id")
    members = (rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
               .join(classes, "v").select("cid", "vec_id"))
    asked = written(spark, rows.where(queries).join(classes, "v").select(F.col("vec_id").alias("query_id"), "cid"), "queries")
    vecs = written(spark, asked.select("cid").distinct().join(classes, "cid"), "query-classes")
    blocks = -(-vecs.count() // QUERY_BLOCK)
    found = []
    for b in range(blocks):
        got = vecs.where(F.pmod(F.xxhash64("cid"), F.lit(blocks)) == b).orderBy("cid").toPandas()
        if not len(got):
            continue
        width = max(len(v) for v in got["v"])
        matrix = np.zeros((len(got), width), np.int64)
        for i, v in enumerate(got["v"]):
            matrix[i, :len(v)] = v
        at = spark.createDataFrame([(i, int(c)) for i, c in enumerate(got["cid"])], "q long, qcid long")
        found.append(written(spark, _search_block(classes, matrix, k + 1).join(F.broadcast(at), "q").select("qcid", "cid", "score"), "found"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    whole = found[0]
    for more in found[1:]:
        whole = whole.union(more)
    best = Window.partitionBy("qcid").orderBy(F.desc("score"), "cid")
    whole = whole.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    listed = asked.join(whole, asked["cid"] == whole["qcid"]).select("query_id", whole["cid"], "score")
    listed = listed.join(members, "cid").where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
