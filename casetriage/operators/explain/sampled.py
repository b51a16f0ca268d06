"""Model-agnostic sampled Shapley values (I3) over source features.

For every case and permutation p (p < n_perm) one background row z is
chosen by hash; the case's source features are switched from z to x in the
permutation's order, giving len(sources)+1 synthetic rows.  All synthetic
rows go through the model in one ``transform``; the change in the explained
class's probability at each step is that feature's marginal contribution,
and phi is its mean over the permutations (Strumbelj & Kononenko 2014).
By construction sum(phi) = f(x) - base, base = mean f(z).

With a feature space, cases and background rows are featurised once and a
synthetic row only picks, source by source, the block of the one or the
other; without one, ``predict`` gets the sources themselves.

Cost is a constant n_perm * (k+1) rows per case (no pairing of cases); the
background is a bounded sample, broadcast only below a proven row count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..features import FeatureSpace
from ..joins import join_small
from ..reshape import explode_array

SOURCES = ["case_summary", "channel", "case_type", "category", "plan_tier", "customer_tenure_months"]


def shap_sampled(cases: DataFrame, background: DataFrame, predict: Callable[[DataFrame], DataFrame],
                 n_perm: int = 8, seed: int = 42, key: str = "case_id",
                 pred_col: str = "predicted_priority", sources: list[str] = SOURCES,
                 max_background: int | None = None, space: FeatureSpace | None = None) -> DataFrame:
    """Returns (key, feature, phi, base_value, fx) rows; ``background`` is a
    sample whose size the caller chose.  With ``space``, ``predict`` gets its feature vector."""
    k = len(sources)
    n_bg = background.count()
    if n_bg == 0 or max_background is not None and n_bg > max_background:
        raise ValueError(f"background must hold 1..{max_background} rows, has {n_bg}")
    bg = background.select(*sources).withColumn("_h", F.md5(F.to_json(F.struct(*sources))))
    bg = bg.withColumn("_z", F.row_number().over(Window.orderBy("_h", *sources)) - 1).drop("_h")
    x = cases.select(key, F.col(pred_col).cast("int").alias("_c"), *sources)
    cols, kept = list(sources), [None] * k
    if space is not None:
        bg, x = space.blocks(bg), space.blocks(x)
        cols = [space.block_cols[s] for s in sources]
        kept = [x.schema[c].metadata for c in cols]  # the assembler takes the blocks' lengths from it
    bgz = bg.select("_z", *[F.col(c).alias(f"_z_{c}") for c in cols])
    x = x.select(key, "_c", *cols)
    perms = explode_array(x, x.columns, F.sequence(F.lit(0), F.lit(n_perm - 1)), "_p")
    seed_s = F.lit(str(seed))
    perms = perms.withColumn(
        "_z", F.pmod(F.xxhash64(seed_s, F.col(key).cast("string"), F.col("_p")), F.lit(n_bg)))
    perms = join_small(perms, bgz, "_z", "inner", small_rows=n_bg)
    # position of every source in this permutation (rank of its hash)
    hs = [F.xxhash64(seed_s, F.col(key).cast("string"), F.col("_p"), F.lit(s)) for s in sources]
    perms = perms.withColumn("_hs", F.array(*hs))
    def smaller_than(i):
        return lambda h: h < F.col("_hs")[i]
    for i, s in enumerate(sources):
        perms = perms.withColumn(f"_r{i}", F.size(F.filter("_hs", smaller_than(i))))
    steps = explode_array(perms, perms.columns, F.sequence(F.lit(0), F.lit(k)), "_s")
    synth = steps.select(key, "_c", "_p", "_s", *[
        F.when(F.col(f"_r{i}") < F.col("_s"), F.col(c)).otherwise(F.col(f"_z_{c}")).alias(c, metadata=kept[i])
        for i, c in enumerate(cols)],
        F.array(*[F.col(f"_r{i}") for i in range(k)]).alias("_ranks"))
    scored = predict(space.assemble(synth) if space is not None else synth)
    out = scored.select(key, "_c", "_p", "_s", "_ranks",
                        vector_to_array(F.col("probability"))[F.col("_c")].alias("_o"))
    # one small group per (case, permutation): k+1 outputs in step order
    g = (out.groupBy(key, "_p").agg(
        F.array_sort(F.collect_list(F.struct("_s", "_o"))).alias("_os"), F.first("_ranks").alias("_ranks")))
    names = F.lit(sources)
    deltas = g.select(key, F.col("_os")[0]["_o"].alias("_base"), F.col("_os")[k]["_o"].alias("_fx"),
                      F.transform(F.sequence(F.lit(1), F.lit(k)), lambda st: F.struct(
                          names[F.array_position("_ranks", st - 1) - 1].alias("feature"),
                          (F.col("_os")[st]["_o"] - F.col("_os")[st - 1]["_o"]).alias("delta"))).alias("_d"))
    long = explode_array(deltas, [key, "_base", "_fx"], "_d", "_e").select(key, "_base", "_fx", "_e.*")
    return (long.groupBy(key, "feature").agg(F.avg("delta").alias("phi"),
                                             F.avg("_base").alias("base_value"), F.first("_fx").alias("fx")))
