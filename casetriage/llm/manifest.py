"""Merkle manifest of a table, its upper levels by butterfly exchange.

Rows are leaves of one tree a value of ``tree_col``; the roots of those trees
are the leaves of one last tree.  A tree is dealt out in aligned blocks of
FANOUT**LOCAL leaves, and each block hashes its own subtree.  Above, blocks
stand for partitions: in round r, the FANOUT blocks at the same place of
FANOUT neighbouring subtrees swap their subtrees' roots, so each of them
hashes the common parent itself.  After the last round every block holds the
root and its own proof, without a pass back down.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, written

FANOUT = 8
#: Levels that one block hashes by itself: 512 leaves.
LOCAL = 3
ABC, abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of the values one after another: ``-`` for null, else byte count, a colon and the value as text."""
    parts = []
    for c in columns:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(spark: SparkSession, leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``pos``, the place of a row in its ``tree`` by ``order`` (nulls first), and ``size``, the rows of the tree.

    Rows are dealt in ranges of (tree, order); places follow from the counts of
    each range, so no tree has to be sorted in one task.  Rows equal in all
    of these may go to different ranges.
    """
    # a last key that spreads rows that are equal in all others over the ranges
    ranged = leaves.withColumn("_r", F.rand(11)).repartitionByRange("tree", *order, "_r").sortWithinPartitions("tree", *order, "_r")
    ranged = ranged.drop("_r").withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = written(spark, ranged, "ranged-leaves")
    counts = ranged.groupBy("tree", "_p").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    by = Window.partitionBy("tree")  # at most one row a range
    counts = counts.select("tree", "_p", (F.sum("_n").over(by.orderBy("_p")) - F.col("_n") - F.col("_first")).alias("_add"),
                           F.sum("_n").over(by).alias("size"))
    return ranged.join(counts, ["tree", "_p"]).withColumn("pos", F.col("_i") + F.col("_add")).drop("_p", "_i", "_first", "_n", "_add")


def _levels(nodes: list[str], least: int) -> list[list[str]]:
    """The levels of a tree above its leaves included, ``least`` of them at least, until one node is left."""
    out = [nodes]
    while len(out[-1]) > 1 or len(out) <= least:
        last = out[-1]
        out.append([_h("".join(last[i:i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def climbed(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Butterfly exchange over ``nodes(tree, pos, size, node)``: pos counts the ``size`` nodes of a tree.

    Returns (tree, pos, size, root, before, after): the tree's root, and for
    each level the node's siblings before and after it, as texts of joined digests.  Each round
    is one shuffle of narrow rows: a node is at place ``pos % span`` of its
    subtree, and gives the subtree's root to that place in the FANOUT subtrees
    of its run.  A last subtree has fewer nodes than places; each of them serves
    the places that are equal to its own modulo their number.
    """
    none = F.array().cast("array<string>")
    state = nodes.select("tree", "pos", "size", "node", none.alias("before"), none.alias("after"))
    most = nodes.agg(F.max("size")).first()[0] or 1
    span = 1
    while span < most:
        part = F.floor(F.col("pos") / span)  # number of the node's subtree
        held = F.least(F.lit(span), F.col("size") - part * span)  # its nodes
        place = F.col("pos") % span
        run = F.floor(part / FANOUT)
        grows = F.col("size") > span
        widest = F.least(F.lit(span), F.col("size") - run * FANOUT * span)  # places that any subtree of the run has
        sent = state.where(grows).select(
            "tree", run.alias("run"), (part % FANOUT).cast("int").alias("child"), "node",
            F.explode(F.sequence(place, F.greatest(widest - 1, place), held)).alias("place"))
        met = sent.groupBy("tree", "run", "place").agg(F.array_sort(F.collect_list(F.struct("child", "node"))).alias("met"))  # at most FANOUT
        state = state.withColumns({"run": run, "place": place, "child": (part % FANOUT).cast("int")}).join(met, ["tree", "run", "place"], "left")
        digests = F.transform("met", lambda x: x["node"])
        state = state.withColumns({
            "before": F.when(grows, F.concat("before", F.array(F.concat_ws("", F.slice(digests, F.lit(1), F.col("child")))))).otherwise(F.col("before")),
            "after": F.when(grows, F.concat("after", F.array(F.concat_ws("", F.slice(digests, F.col("child") + 2, F.lit(FANOUT)))))).otherwise(F.col("after")),
            "node": F.when(grows, F.sha2(F.concat_ws("", digests).cast("binary"), 256)).otherwise(F.col("node"))})
        state = state.select("tree", "pos", "size", "node", "before", "after")
        state = written(spark, state, "merkle-round")
        span *= FANOUT
    return state.withColumnRenamed("node", "root")


def merkle_manifest(docs: DataFrame, columns: list[str], id_col: str, tree_col: str, changed: dict[str, Column],
                    where: Column, local: int = LOCAL) -> DataFrame:
    """Leaves, roots and proofs of all rows, and the check of rows that were changed afterwards.

    ``columns`` are hashed in this order.  Rows of one ``tree_col`` value ascend
    by id, a null id first, equal ids by leaf; trees are ordered with null
    first, then bytewise.  ``changed`` replaces columns in the rows ``where``
    holds, and only the leaf is taken anew from them.

    Returns (doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified), one row per row of ``docs``: the proof is the SHA-256 of all
    siblings from the leaf to the root, ``folded_root`` the hash of the leaf (that
    of the changed row, if it was changed) up along those siblings.  An
    empty table gives an empty one; equal rows are leaves of their own;
    other columns take no part.
    """
    spark = docs.sparkSession
    now = [F.when(where, changed[c]).otherwise(F.col(c)) if c in changed else F.col(c) for c in columns]
    tree = F.when(F.col(tree_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("doc_id"), leaf_hash([F.col(c) for c in columns]).alias("leaf"),
                         F.when(where, leaf_hash(now)).alias("changed"))
    per = FANOUT ** local
    leaves = placed(spark, leaves, ["doc_id", "leaf"]).withColumn("block", F.floor(F.col("pos") / per))
    leaves = written(spark, leaves, "placed-leaves")
    keys = ["tree", "block"]

    def block_root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        top = _levels(rows["leaf"].tolist(), local if rows["size"].iat[0] > per else 0)[-1][0]
        return pd.DataFrame({"tree": rows["tree"].iat[0], "pos": rows["block"].iat[0], "node": [top],
                             "size": -(-rows["size"].iat[0] // per)})

    blocks = leaves.select("tree", "block", "pos", "leaf", "size").groupBy(keys).applyInPandas(
        block_root, "tree string, pos long, node string, size long")
    blocks = climbed(spark, written(spark, blocks, "block-roots"))

    subroots = blocks.where("pos = 0").select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("node"),
                                               F.col("size").alias("blocks"))
    subroots = written(spark, placed(spark, subroots, ["of"]), "subroots")
    upper = climbed(spark, subroots).select("pos", "root", F.col("before").alias("b2"), F.col("after").alias("a2"))
    upper = upper.join(subroots.select("pos", F.col("of").alias("tree"), F.col("node").alias("subroot"), "blocks"), "pos").drop("pos")
    blocks = join_hot(blocks.drop("root"), upper, ["tree"], "blocks", blocks.count())
    blocks = blocks.select("tree", F.col("pos").alias("block"), "subroot", "root",
                           F.concat("before", "b2").alias("before"), F.concat("after", "a2").alias("after"))

    def proofs(rows: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = _levels(rows["leaf"].tolist(), local if rows["size"].iat[0] > per else 0)
        upper = list(zip(top["before"].iat[0], top["after"].iat[0]))
        proof, folded = [], []
        for i, (leaf, other) in enumerate(zip(rows["leaf"], rows["changed"])):
            path = []
            for level in levels[:-1]:
                lo = i - i % FANOUT
                path.append(("".join(level[lo:i]), "".join(level[i + 1:lo + FANOUT])))
                i //= FANOUT
            path += upper
            node = other if isinstance(other, str) else leaf
            for before, after in path:
                node = _h(before + node + after)
            proof.append(_h("".join(b + a for b, a in path)))
            folded.append(node)
        out = rows[["doc_id", "leaf"]].copy()
        out["subroot"], out["root"] = top["subroot"].iat[0], top["root"].iat[0]
        out["proof_sha256"], out["folded_root"] = proof, folded
        return out

    kind = leaves.schema["doc_id"].dataType.simpleString()
    cols = "leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    out = leaves.groupBy(keys).cogroup(blocks.groupBy(keys)).applyInPandas(proofs, f"doc_id {kind}, {cols}")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
