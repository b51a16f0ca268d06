"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits differ in at most one
bit of one of their 32-bit halves.  Each fingerprint is indexed under every
half with every single bit of it left out (64 variants), so such a pair meets
in at least one variant; an equality join by variant finds it, and the whole
fingerprints verify it.  A variant that very many fingerprints share is joined
by the same rule on the bits it leaves open, twice if need be: 16-bit halves
of the other half, then 8-bit halves of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE_BYTES, join_hot, text_slices, utf8_parts, written
from .components import connected_components

#: Bits in which linked fingerprints may differ; the two halves of a cut allow one bit each.
DISTANCE = 2
#: Fingerprints of one variant that are compared with each other; a variant of more is cut again.
#: The last cut leaves 11 bits open, so it never has more than 2,048.
MEMBERS = 4096
SEED = 42


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in pieces of about PIECE_BYTES, cut between words."""
    lo = 0
    while lo < len(text):
        hi = min(lo + PIECE_BYTES, len(text))
        while hi < len(text) and not text[hi:hi + 1].isspace():
            hi += 1
        yield text[lo:hi].split()
        lo = hi


def shingle_bits(text: bytes, words: int) -> tuple[np.ndarray, int]:
    """(how many shingles have each of the 64 bits, number of shingles) of one text, repeats counted."""
    total, n, rest, whole = np.zeros(64, np.int64), 0, [], True
    for more in _word_lists(text.lower()):
        run = rest + more
        if len(run) >= words:
            joined = b" ".join(run)
            ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
            starts = np.r_[0, ends[:-1] + 1]
            h = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1:].tolist())]
            bits = np.unpackbits(np.array(h, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total += bits.sum(axis=0, dtype=np.int64)
            n, whole = n + len(h), False
            rest = run[len(run) - words + 1:]
        else:
            rest = run
    if whole and rest:
        h = xxhash.xxh64_intdigest(b" ".join(rest), SEED)
        return np.unpackbits(np.array([h], dtype=">u8").view(np.uint8)).astype(np.int64), 1
    return total, n


def fingerprint_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of every row of ``docs(doc_id, text)``; the fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                raw, off = utf8_parts(part.column(1))
                data, off = raw.tobytes(), off.tolist()
                majority = np.zeros((hi - lo, 64), dtype=np.uint8)
                for i in range(hi - lo):
                    bits, n = shingle_bits(data[off[i]:off[i + 1]], words)
                    majority[i] = 2 * bits > n
                fp = np.packbits(majority, axis=1).view(">i8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, fp long")


def _field(value: Column | str, shift: Column, width: int) -> Column:
    """``width`` bits of a number from bit ``shift`` on."""
    return F.call_function("shiftrightunsigned", value, shift.cast("int")).bitwiseAND(F.lit((1 << width) - 1))


def _without(value: Column, bit: Column) -> Column:
    """The number with one bit left out (set to zero)."""
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))


def _variants(rows: DataFrame, of: Column, width: int) -> DataFrame:
    """One row for each half of the ``width`` bits ``of`` and each of its bits: ``v`` numbers them, ``left`` is the rest of the half."""
    half = width // 2
    rows = rows.withColumn("open", of).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    place = F.floor(F.col("v") / half) * half
    return rows.withColumn("left", _without(_field("open", place, half), F.col("v") % half))


def _other(of: Column, v: Column, width: int) -> Column:
    """The half that variant ``v`` of ``width`` bits leaves open."""
    half = width // 2
    return _field(of, half - F.floor(v / half) * half, half)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, sub, fp) sorted by (key, sub) to links (a, b): of every variant a forest that joins what its members' distances join."""
    def forest(fp: np.ndarray, a: list, b: list) -> None:
        left, queue = fp, []
        while len(left):
            if queue:
                x = queue.pop()
            else:
                x, left = left[0], left[1:]
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                found = left[near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue.extend(found)
                left = left[~near]

    def closed(key, sub, fp):
        edge = np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]), True] if len(key) else np.array([True])
        first = np.flatnonzero(edge)
        size = np.diff(first)
        two = first[:-1][size == 2]
        x, y = fp[two], fp[two + 1]
        ok = np.bitwise_count(x ^ y) <= DISTANCE
        a, b = [x[ok]], [y[ok]]
        for j in np.flatnonzero(size > 2):
            forest(fp[first[j]:first[j + 1]], a, b)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        cols = [np.concatenate(c) for c in zip(held, cols)]
        if not len(cols[0]):
            continue
        rest = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(rest[-1]) + 1 if len(rest) else 0
        if cut:
            yield closed(*(c[:cut] for c in cols))
        held = [c[cut:] for c in cols]
    yield closed(*held)


def fingerprint_links(spark: SparkSession, fps: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(a, b): fingerprints of ``fps(fp)``, all different, at two or fewer bits; a forest of every variant's links."""
    first = _variants(fps, F.col("fp"), 64)
    level = first.select((F.call_function("shiftleft", F.col("v").cast("long"), F.lit(32)).bitwiseOR(F.col("left"))).alias("key"),
                         F.lit(0).cast("long").alias("sub"), "fp", _other(F.col("fp"), F.col("v"), 64).alias("open"))
    links, width = None, 32
    while True:
        rows = level
        large = None
        if width > 8:  # the groups of the third cut can't be large
            large = written(spark, rows.groupBy("key", "sub").count().where(F.col("count") > members).select("key", "sub"), "large-variants")
            if large.isEmpty():
                large = None
        if large is not None:
            rows = rows.join(large, ["key", "sub"], "left_anti")
        found = rows.select("key", "sub", "fp").repartition("key", "sub").sortWithinPartitions("key", "sub")
        found = written(spark, found.mapInArrow(_links, "a long, b long"), "fingerprint-links")
        links = found if links is None else links.union(found)
        if large is None:
            return links
        cut = _variants(level.join(large, ["key", "sub"], "left_semi"), F.col("open"), width)
        code = F.col("v").cast("long") * (1 << (width // 2)) + F.col("left")
        level = cut.select("key", (F.col("sub") * (1 << (width // 2 + 5)) + code).alias("sub"), "fp",
                           _other(F.col("open"), F.col("v"), width).alias("open"))
        width //= 2


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       members: int = MEMBERS) -> DataFrame:
    """Fingerprints of texts and the components of those within two bits of each other.

    Returns (doc_id, fingerprint, component_id), one row per row of ``docs``.
    The fingerprint (16 hexadecimal digits) has a bit set where over half of
    the text's ``words``-word shingles, repeats included, have it set in
    their XXH64.  A text of fewer words is one shingle; a null or blank one
    has the fingerprint zero and links like any other.  component_id is the
    smallest id reachable by links, the own included; null ids take part, but
    are never the smallest.  Copies and repeated rows share a fingerprint, which is
    one node however many rows have it.  Other columns are not looked at.
    ``members`` bounds what one variant compares at once, never the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = written(spark, fingerprint_table(docs, words), "fingerprints")
    nodes = written(spark, table.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "fingerprint-nodes")
    comp = connected_components(spark, fingerprint_links(spark, nodes.select("fp"), members))
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = written(spark, named.join(low, "root").select("fp", "component_id", "rows"), "fingerprint-roots")
    out = join_hot(table, named, ["fp"], "rows", table.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
