"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is cut into windows of up to 13 words.  A window can only
occur where all its shingles occur, so the rarest of them (by its count over
all documents) is a necessary prefix: documents join on it, positions that
leave no room for the window go, and the words of the rest are compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 13, 4
#: Bits of the bitmap of shingle hashes in front of the joins; a fixed size, a full one only lets more through.
BITMAP_BITS = 1 << 21

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def word_array(text: str) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, NO_WORD), "")


def _grams(df: DataFrame, size: int) -> DataFrame:
    """One row per position of a ``size``-word shingle in ``w``: pos and its hash h; other columns stay."""
    zipped = F.arrays_zip(*[(F.col("w") if j == 0 else F.slice("w", j + 1, F.greatest(F.size("w"), F.lit(1)))).alias(f"w{j}")
                            for j in range(size)])
    rows = df.select("*", F.posexplode(zipped).alias("pos", "g")).where(F.col("pos") <= F.size("w") - size)
    return rows.withColumn("h", F.xxhash64(F.lit(size), *[F.col(f"g.w{j}" if size > 1 else "g.w0") for j in range(size)])).drop("g")


def _bitmap(hashes: DataFrame) -> Column:
    """Scalar subquery: the bitmap of the column h as an array of longs."""
    at = F.expr(f"h & {BITMAP_BITS - 1}")
    cells = (hashes.groupBy(F.shiftright(at, 6).cast("int").alias("c"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("m")))
    whole = cells.agg(F.map_from_entries(F.collect_list(F.struct("c", "m"))).alias("held"))
    return whole.select(F.transform(F.sequence(F.lit(0), F.lit(BITMAP_BITS // 64 - 1)),
                                    lambda i: F.coalesce(F.element_at("held", i), F.lit(0).cast("long")))).scalar()


def _in_bitmap(df: DataFrame, hashes: DataFrame) -> DataFrame:
    cell = F.element_at(_bitmap(hashes), (F.shiftright(F.expr(f"h & {BITMAP_BITS - 1}"), 6) + 1).cast("int"))
    return (df.withColumn("cell", cell)
            .where(F.expr("shiftrightunsigned(cell, cast(h & 63 as int)) & 1 = 1")).drop("cell"))


def windows(bench: DataFrame, window: int) -> DataFrame:
    """(item_id, wid, words): the distinct windows of every item."""
    w = bench.select("item_id", word_array("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = w.select("item_id", "w", F.explode(starts).alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("words"))
    return cut.select("item_id", F.xxhash64("words").alias("wid"), "words").distinct()


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE, share: tuple[int, int] = (1, 20)) -> DataFrame:
    """Which benchmark items' windows occur in each document, and how many words they cover.

    Returns (doc_id, n_words, n_hit, n_items, items, contaminated), one row per
    row of ``docs``: a document is contaminated when the hit words are at least
    ``share`` of its words, and one or more.  Null texts have no words; items
    without words have no window, and items of fewer words than a window are
    one; an item without id counts for the hit words only; repeated rows and
    items count as one text.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    bench = bench.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    win = written(spark, windows(bench, window), "windows")
    texts = win.select("wid", F.col("words").alias("w")).distinct()
    tokens = docs.select("doc_id", "th", word_array("text").alias("w"))
    hits = []
    # one size for items of `shingle` words or more; shorter items have their own (at most `shingle` sizes)
    sizes = [r.g for r in texts.select(F.least(F.size("w"), F.lit(shingle)).alias("g")).distinct().collect()]
    for size in sorted(sizes):
        own = texts.where(F.least(F.size("w"), F.lit(shingle)) == size)
        grams = written(spark, _grams(own, size), "window-shingles")
        known = grams.select("h").distinct()
        counts = _in_bitmap(_grams(tokens, size).select("h"), known).groupBy("h").agg(F.count("*").alias("c"))
        ranked = grams.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
        # windows whose rarest shingle never occurs need no join
        prefix = (ranked.groupBy("wid").agg(F.min_by(F.struct("h", "pos", "c", "w"), F.struct("c", "h", "pos")).alias("p"))
                  .where("p.c > 0").select("wid", "p.h", F.col("p.pos").alias("off"), F.col("p.w").alias("words")))
        prefix = written(spark, prefix, "window-prefixes")
        back = window - size
        found = _in_bitmap(_grams(tokens, size), prefix.select("h").distinct()).select(
            "doc_id", "th", "h", "pos", F.size("w").alias("n"), F.greatest(F.col("pos") - back, F.lit(0)).alias("lo"),
            F.slice("w", F.greatest(F.col("pos") - back, F.lit(0)) + 1, F.lit(2 * window - size)).alias("near"))
        at = found.join(prefix, "h").withColumn("start", F.col("pos") - F.col("off")).withColumn("len", F.size("words"))
        at = at.where("start >= 0 and start + len <= n")
        at = at.where(F.slice("near", F.col("start") - F.col("lo") + 1, F.col("len")) == F.col("words"))
        hits.append(at.select("doc_id", "th", "wid", "start", "len"))
    base = docs.select("doc_id", "th", F.regexp_count("text", F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    base = base.withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long")))
    if not hits:
        none = F.lit(0).cast("long")
        return base.select("doc_id", "n_words", none.alias("n_hit"), none.alias("n_items"),
                           F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    hits = written(spark, reduce(DataFrame.union, hits).distinct(), "window-hits")

    spans = hits.select("doc_id", "th", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = (Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.select("doc_id", "th", "end", F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start"))).alias("from"))
    n_hit = fresh.groupBy("doc_id", "th").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("n_hit"))
    named = (hits.select("doc_id", "th", "wid").distinct().join(win.select("wid", "item_id").distinct(), "wid")
             .groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    got = n_hit.join(named.withColumnRenamed("doc_id", "d2").withColumnRenamed("th", "t2"),
                     F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("th").eqNullSafe(F.col("t2")), "left").select(
        F.col("doc_id").alias("d1"), F.col("th").alias("t1"), "n_hit", "items")
    num, den = share
    out = base.join(got, F.col("doc_id").eqNullSafe(F.col("d1")) & F.col("th").eqNullSafe(F.col("t1")), "left")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                     F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * den >= F.col("n_words") * num)).alias("contaminated"))
