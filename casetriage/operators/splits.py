"""Reproducible stratified splits, folds and class weights.

The reference draws a numpy permutation; here the order inside a class is
``md5(seed || '-' || key)``, reproducible in any engine.  Per-class quotas
follow the largest-remainder rule, so the test share is exactly
``ceil(test_frac * n)`` rows with each class represented proportionally.

Scale: ranking rows inside a class with ``row_number() OVER (PARTITION BY
label)`` would send a whole class (a third of the data or more) to one task.
Instead the hash order is cut into 65,536 buckets by its first four hex
digits; a tiny (label, bucket) histogram gives every bucket its starting
offset, and rows are ranked only inside their (label, bucket), which holds
~1/65,536 of a class.  The result is the exact global rank.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_small

BUCKET_HEX_DIGITS = 4


def hash_order(key_col: str, seed: int = 42):
    """Uniform, engine-independent order key: md5 of 'seed-key' (hex)."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key_col).cast("string")))


def rank_within_class(df: DataFrame, label: str, key: str, seed: int = 42,
                      rank_col: str = "class_rank") -> DataFrame:
    """Exact 1-based rank of every row inside its class by hash order,
    without a per-class window (see module doc)."""
    h = "_h"
    b = "_bucket"
    keyed = df.withColumn(h, hash_order(key, seed)).withColumn(
        b, F.substring(F.col(h), 1, BUCKET_HEX_DIGITS))
    hist = keyed.groupBy(label, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(label, b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # the histogram is bounded by (#classes x 16^4) rows whatever the data size
    n_labels = keyed.select(label).distinct().count()
    joined = join_small(keyed, offsets, [label, b], "inner",
                        small_rows=n_labels * 16 ** BUCKET_HEX_DIGITS)
    inner = Window.partitionBy(label, b).orderBy(h, key)
    return (joined.withColumn(rank_col, F.col("_off") + F.row_number().over(inner))
            .drop("_off", b, h))


def largest_remainder_quotas(counts: dict, test_frac: float) -> dict:
    """Per-class test quotas: floor shares of ceil(frac*n), the leftover rows
    to the largest fractional parts (ties: lower label first); a class with
    at least two rows always keeps one row for training."""
    n = sum(counts.values())
    n_test = math.ceil(test_frac * n - 1e-9)
    exact = {k: v * n_test / n for k, v in counts.items()}
    q = {k: math.floor(x) for k, x in exact.items()}
    left = n_test - sum(q.values())
    for k in sorted(counts, key=lambda k: (-(exact[k] - q[k]), k))[:left]:
        q[k] += 1
    return {k: (min(v, counts[k] - 1) if counts[k] >= 2 else v) for k, v in q.items()}


def stratified_split(df: DataFrame, label: str = "priority_encoded", key: str = "case_id",
                     test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` in {'train', 'test'}.

    A row is in the test share iff its (hash, key) is at or below its
    class's cut point, the quota-th row of the class in hash order.  The cut
    points come from small jobs over the (label, hash) projection: per-class
    counts, the (label, bucket) histogram (at most #classes x 16^4 rows)
    locates the bucket holding each cut, and a rank over that one bucket per
    class (~1/65,536 of the class) gives the exact row.  The split itself is
    a row-local comparison, so no case row is shuffled."""
    h, b = "_h", "_bucket"
    keyed = df.withColumn(h, hash_order(key, seed))
    narrow = keyed.select(label, key, h, F.substring(F.col(h), 1, BUCKET_HEX_DIGITS).alias(b))
    counts = {r[0]: r[1] for r in narrow.groupBy(label).count().collect()}  # one row per class
    quotas = {k: v for k, v in largest_remainder_quotas(counts, test_frac).items() if v > 0}
    if not quotas:
        return keyed.withColumn("split", F.lit("train")).drop(h)
    qmap = F.create_map(*[x for k, v in sorted(quotas.items()) for x in (F.lit(k), F.lit(v))])
    hist = narrow.filter(qmap[F.col(label)].isNotNull()).groupBy(label, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    off = hist.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cuts = off.filter((F.col("_off") < qmap[F.col(label)]) & (F.col("_off") + F.col("_n") >= qmap[F.col(label)])) \
        .select(label, b, (qmap[F.col(label)] - F.col("_off")).alias("_need")).collect()  # one row per class
    in_cut = None
    for r in cuts:
        c = (F.col(label) == F.lit(r[0])) & (F.col(b) == F.lit(r[1]))
        in_cut = c if in_cut is None else in_cut | c
    need = F.create_map(*[x for r in cuts for x in (F.lit(r[0]), F.lit(r[2]))])
    inner = Window.partitionBy(label).orderBy(h, key)
    thr = (narrow.filter(in_cut).withColumn("_r", F.row_number().over(inner))
           .filter(F.col("_r") == need[F.col(label)]).select(label, h, key).collect())  # one row per class
    th = F.create_map(*[x for r in thr for x in (F.lit(r[0]), F.lit(r[1]))])
    tk = F.create_map(*[x for r in thr for x in (F.lit(r[0]), F.lit(r[2]))])
    cut_h, cut_k = th[F.col(label)], tk[F.col(label)]
    is_test = (F.col(h) < cut_h) | ((F.col(h) == cut_h) & (F.col(key) <= cut_k))
    return keyed.withColumn("split", F.when(is_test, "test").otherwise("train")).drop(h)


def stratified_folds(df: DataFrame, k: int = 5, label: str = "priority_encoded",
                     key: str = "case_id", seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """fold = (rank inside class - 1) mod k, so every fold holds each
    class in proportion (±1 row)."""
    ranked = rank_within_class(df, label, key, seed)
    return ranked.withColumn(fold_col, ((F.col("class_rank") - 1) % k).cast("int")).drop("class_rank")


def class_weights(df: DataFrame, label: str = "priority_encoded") -> DataFrame:
    """Balanced weights n / (k * count_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    everything = Window.partitionBy()  # over the per-class table: one row per class
    return counts.select(label, "n_c", (F.sum("n_c").over(everything)
                                        / (F.count(F.lit(1)).over(everything) * F.col("n_c"))
                                        ).alias("weight"))


def with_class_weights(df: DataFrame, label: str = "priority_encoded",
                       weight_col: str = "weight") -> DataFrame:
    """E11 applied: attach the weight of each row's class (the weight table
    has one row per class)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label, "left")
