"""Sharding of documents by best-fit-decreasing packing of groups of equal texts.

Groups of equal texts are never divided.  Groups above a fixed share of a
shard are items of their own (their number is bounded by the number of
shards); all smaller groups fall by hash into a fixed number of bundles for
each shard.  So the packing itself handles a bounded list, whatever the input.
"""

from __future__ import annotations

from heapq import heapify, heapreplace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Groups above 1/LARGE of a shard are packed alone; smaller ones in BUNDLES bundles a shard.
LARGE, BUNDLES = 64, 256
#: Rows numbered by one task, about.
SLOT_ROWS = 20_000
#: Bytes a row costs beyond its text.
ROW_BYTES = 8


class BinTree:
    """Balanced (AVL) tree of bins ordered by (free space, bin)."""

    __slots__ = ("key", "left", "right", "height")

    def __init__(self, key, left=None, right=None):
        self.key, self.left, self.right = key, left, right
        self.height = 1 + max(left.height if left else 0, right.height if right else 0)

    @staticmethod
    def _joined(key, left, right):
        lh, rh = left.height if left else 0, right.height if right else 0
        if lh > rh + 1:
            if (left.left.height if left.left else 0) >= (left.right.height if left.right else 0):
                return BinTree(left.key, left.left, BinTree(key, left.right, right))
            mid = left.right
            return BinTree(mid.key, BinTree(left.key, left.left, mid.left), BinTree(key, mid.right, right))
        if rh > lh + 1:
            if (right.right.height if right.right else 0) >= (right.left.height if right.left else 0):
                return BinTree(right.key, BinTree(key, left, right.left), right.right)
            mid = right.left
            return BinTree(mid.key, BinTree(key, left, mid.left), BinTree(right.key, mid.right, right.right))
        return BinTree(key, left, right)

    @staticmethod
    def put(node, key):
        if node is None:
            return BinTree(key)
        if key < node.key:
            return BinTree._joined(node.key, BinTree.put(node.left, key), node.right)
        return BinTree._joined(node.key, node.left, BinTree.put(node.right, key))

    @staticmethod
    def without(node, key):
        if key < node.key:
            return BinTree._joined(node.key, BinTree.without(node.left, key), node.right)
        if key > node.key:
            return BinTree._joined(node.key, node.left, BinTree.without(node.right, key))
        if node.left is None or node.right is None:
            return node.left or node.right
        low = node.right
        while low.left:
            low = low.left
        return BinTree._joined(low.key, node.left, BinTree.without(node.right, low.key))

    @staticmethod
    def tightest(node, size):
        """The smallest key with free space of ``size`` or more."""
        found = None
        while node:
            if node.key[0] >= size:
                found, node = node.key, node.left
            else:
                node = node.right
        return found


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int, most: int | None = None) -> dict | None:
    """item -> bin: by falling size, each into the bin with the least space that holds it, else into a new one.

    An item above the capacity gets a bin of its own.  None if it takes more than ``most`` bins.
    """
    tree, out, bins = None, {}, 0
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        key = BinTree.tightest(tree, size)
        if key is None:
            key, bins = (max(capacity, size), bins), bins + 1
            if most is not None and bins > most:
                return None
        else:
            tree = BinTree.without(tree, key)
        out[item] = key[1]
        tree = BinTree.put(tree, (key[0] - size, key[1]))
    return out


def least_full_first(items: list[tuple[int, object]], bins: int) -> dict:
    """item -> bin: by falling size, each into the bin that holds least."""
    loads, out = [(0, i) for i in range(bins)], {}
    heapify(loads)
    for size, item in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        held, out[item] = loads[0]
        heapreplace(loads, (held + size, out[item]))
    return out


def packed(items: list[tuple[int, object]], bins: int) -> dict:
    """Packing into at most ``bins`` bins of near equal size.

    Best fit with the smallest fixed capacity found by bisection, where an
    item above the capacity has a bin alone and the others share the rest; or,
    if items are so large that best fit leaves bins emptier, least full first.
    """
    def loads(place: dict) -> list[int]:
        out = [0] * bins
        for size, item in items:
            out[place[item]] += size
        return out

    best, even = _best_fit_of_smallest(items, bins), least_full_first(items, bins)
    b, e = loads(best), loads(even)
    return even if 100 * min(e) > 102 * min(b) and max(e) <= max(b) else best


def _best_fit_of_smallest(items: list[tuple[int, object]], bins: int) -> dict:
    total = sum(s for s, _ in items)
    # what the bins need at least: the mean that is left beside items above it, each alone
    rest, left = total, bins
    for size in sorted((s for s, _ in items), reverse=True):
        if left == 1 or size * left <= rest:
            break
        rest, left = rest - size, left - 1
    low, high, best = max(-(-rest // left), 1), max(total, 1), None
    while best is None or high - low > max(1, low // 2000):
        mid = low if best is None and high > low else (low + high) // 2
        got = best_fit_decreasing(items, mid, bins)
        if got is not None:
            best, high = got, mid
            if mid == low:
                break
        else:
            low = mid + 1
            best = best if best is not None else best_fit_decreasing(items, high, bins)
    return best


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every document; equal texts share a shard.

    With ``shards`` their bytes are as near equal as whole groups allow: a
    group above the mean of the others has a shard alone, and the rest is
    spread evenly over the other shards.  With ``capacity`` (bytes) the number
    of shards is what best fit takes.  Returns (doc_id, size, text_crc32,
    shard, slot), one row per row of ``docs``.  size is the text's UTF-8 bytes plus 8; a null text has none, and
    the crc32 of no bytes (it is one group with empty texts).  Slots run from 0
    without gaps; null ids come first, equal rows in any order.  A group above
    the capacity has a shard alone.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"))
    rows = written(spark, rows, "shard-rows")
    group = ["th", "text_crc32", "size"]
    groups = written(spark, rows.groupBy(*group).agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    bins = shards or max(1, -(-total // capacity))
    limit = max(1, total // (bins * LARGE))
    bundle = F.pmod(F.xxhash64(*group), F.lit(bins * BUNDLES))
    large = groups.where(F.col("bytes") > limit)
    small = groups.where(F.col("bytes") <= limit)
    items = [(r.bytes, ("group", r.th, r.text_crc32, r["size"])) for r in large.collect()]  # under bins * LARGE rows
    items += [(r.bytes, ("bundle", r.u)) for r in small.groupBy(bundle.alias("u")).agg(F.sum("bytes").alias("bytes")).collect()]
    place = packed(items, bins) if shards else best_fit_decreasing(items, capacity)
    alone = spark.createDataFrame([(*k[1:], b) for k, b in place.items() if k[0] == "group"],
                                  "th long, text_crc32 long, size long, shard_a int")
    bundles = spark.createDataFrame([(k[1], b) for k, b in place.items() if k[0] == "bundle"], "u long, shard_b int")
    dealt = (rows.withColumn("u", bundle).join(F.broadcast(alone), group, "left").join(F.broadcast(bundles), "u", "left")
             .select("doc_id", "size", "text_crc32", "th", F.coalesce("shard_a", "shard_b").alias("shard")))

    # slots: rows of a shard lie in pieces by id hash, so that no task numbers a whole shard
    pieces = max(64, -(-rows.count() // (bins * SLOT_ROWS)))
    dealt = written(spark, dealt.withColumn("piece", F.pmod(F.xxhash64("doc_id", "th"), F.lit(pieces))), "shard-dealt")
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "th")
    return dealt.join(starts, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(inside) - 1).alias("slot"))


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents of a plan as Parquet files by shard; ids must be unique."""
    shard = plan.select(F.col("doc_id").alias(id_col), "shard", "slot")
    (docs.join(shard, id_col).repartition("shard", F.expr(f"slot div {SLOT_ROWS}")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
