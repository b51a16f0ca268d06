"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

The feature domain (64-bit shingle hashes) is cut into n1 partitions of n2
cells.  Two sets of one size band whose Jaccard similarity reaches the
threshold differ in at most k features, so at least one partition has at most
one difference, and with that all but one of its cells agree.  The signatures
of a set are, for every partition, the contents of its cells but one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, long_lists, mix, shingle_hashes, small_batches, text_slices, word_hashes, written
from .components import connected_components

#: Cells of a first-level partition; a signature leaves out one of them.
CELLS = 3
#: Ratio of the largest to the smallest set size of a band.
BAND = 1.3
#: 64-bit words of the parity sketch that bounds the difference of two sets from below.
SKETCH = 8
#: Members of a signature group that are compared with each other at a time.
BLOCK = 1024
#: Rows of alike groups that go to one task, about.
DEAL_ROWS = 1 << 16
#: Names of sets, groups or pairs that a task remembers, so as not to repeat them.
SEEN = 100_000
#: Rounds in which groups are compared with their member of most links, before all that is left apart is; a second one found few links more.
HUB_ROUNDS = 1
#: Rows of one signature group held in a task's memory; larger groups go on in pieces with the same leader.
RUN_ROWS = 1 << 19


@dataclass(frozen=True)
class Band:
    """Pairs whose smaller set has ``low``..``high`` features and differ in at most ``diff``."""
    low: int
    high: int
    diff: int
    parts: int
    spare: int


def _band(low: int, num: int, den: int) -> Band:
    high = max(low, int(low * BAND))
    diff = (high + high * den // num) * (den - num) // (num + den)
    base, parts = diff // 2 + 1, diff // 2 + 1
    for _ in range(6):  # spare partitions, so that empty cells rarely leave no signature with content
        lam = low / (CELLS * parts)
        p = min(1.0, CELLS * math.exp(-(CELLS - 1) * lam))
        parts = base + min(base, math.ceil(p * parts + 3 * math.sqrt(p * parts)))
    return Band(low, high, diff, parts, parts - base)


def bands_of(size: int, num: int, den: int, cache: dict) -> list[tuple[int, Band]]:
    """The bands in which a set of ``size`` features can be the smaller or the larger of a pair."""
    if size not in cache:
        bands = cache.setdefault("bands", [_band(1, num, den)])
        while bands[-1].high < size:
            bands.append(_band(bands[-1].high + 1, num, den))
        # without differences only equal sets pair, and those share one node already
        cache[size] = [(i, b) for i, b in enumerate(bands)
                       if b.diff and b.low <= size and size * num <= b.high * den]
    return cache[size]


def signatures(u: np.ndarray, num: int, den: int, cache: dict) -> np.ndarray:
    """PartEnum signatures of one set of distinct 64-bit features."""
    out = []
    inner = mix(u)
    for i, b in bands_of(len(u), num, den, cache):
        m = b.parts * CELLS
        cell = (u % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, dtype=np.uint64)
        np.add.at(total, cell, inner)
        count = np.bincount(cell, minlength=m).reshape(b.parts, CELLS)
        total = total.reshape(b.parts, CELLS)
        left = total.sum(axis=1, keepdims=True) - total
        held = count.sum(axis=1, keepdims=True) - count
        place = np.arange(m, dtype=np.uint64).reshape(b.parts, CELLS) + np.uint64((i + 1) << 32)
        sig = mix(left + mix(place))
        # With at most `spare` partitions that have an empty signature, a partner also shares one
        # with content, as `spare` + 1 partitions agree; only other sets need the empty ones.
        empty = held == 0
        if empty.any(axis=1).sum() > b.spare:
            out.append(sig.ravel())
        else:
            out.append(sig[~empty])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_key(u: np.ndarray) -> np.uint64:
    return mix(mix(u).sum(keepdims=True) + np.uint64(len(u)))[0] if len(u) else np.uint64(0)


def _sets(batches, words: int):
    """(first column, keys, sets) for runs of rows of (id, text) batches."""
    for batch in batches:
        for lo, hi in text_slices(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            hashes, at, _ = word_hashes(part.column(1))
            sets = shingle_hashes(hashes, at, words)
            yield part.column(0), np.array([set_key(u) for u in sets], dtype=np.uint64), sets


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(np.uint64).view(np.int64))


def set_table(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, n, sketch): one narrow row per row of ``docs(doc_id, text)``; equal sets have equal keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, sets in _sets(batches, words):
            sketch = np.zeros((len(sets), SKETCH), dtype=np.uint64)
            for i, u in enumerate(sets):
                if len(u):
                    odd = np.bincount((u >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) & 1
                    sketch[i] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
            cols = [ids, _long(keys), pa.array([len(u) for u in sets], pa.int64())]
            cols += [_long(sketch[:, j]) for j in range(SKETCH)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "n"] + [f"x{j}" for j in range(SKETCH)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(frugal(run), f"doc_id {kind}, key long, n long, " + ", ".join(f"x{j} long" for j in range(SKETCH)))


def signature_table(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(sig, key) of every set; a set that a task meets again emits nothing new."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = {}, set()
        for _, keys, sets in _sets(batches, words):
            got, owner = [], []
            for key, u in zip(keys, sets):
                if len(u) and key not in seen:
                    seen.add(key)
                    s = signatures(u, num, den, cache)
                    got.append(s)
                    owner.append(np.full(len(s), key))
            if len(seen) > SEEN:
                seen.clear()
            if got:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(got)), _long(np.concatenate(owner))], names=["sig", "key"])
    return docs.mapInArrow(frugal(run), "sig long, key long")


def _shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, key) to (gid, leader, key) of the signatures that several sets share.

    Groups with the same members count once in a task.  A group above
    RUN_ROWS goes out in pieces under its signature, each led by its first member.
    """
    sig, key, seen, open_sig = np.zeros(0, np.int64), np.zeros(0, np.int64), set(), None

    def rows(gid, leader, member):
        return pa.RecordBatch.from_arrays([pa.array(gid), pa.array(leader), pa.array(member)], names=["gid", "leader", "key"])

    def closed(s, k):
        nonlocal open_sig
        if not len(s):
            return None
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        members = np.add.reduceat(mix(k.view(np.uint64)), first) + size.astype(np.uint64)
        gid = mix(members).view(np.int64)
        gid = np.where(s[first] == open_sig, s[first], gid) if open_sig is not None else gid
        keep = np.zeros(len(first), dtype=bool)
        many = np.flatnonzero(size > 1)
        for j, g in zip(many, gid[many].tolist()):
            if g not in seen:
                seen.add(g)
                keep[j] = True
        if len(seen) > SEEN:
            seen.clear()
        open_sig = None
        if not keep.any():
            return None
        row = np.repeat(keep, size)
        return rows(np.repeat(gid[keep], size[keep]), np.repeat(k[first[keep]], size[keep]), k[row])

    for batch in batches:
        s = np.concatenate([sig, batch.column(0).to_numpy()])
        k = np.concatenate([key, batch.column(1).to_numpy()])
        new = np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])] if len(s) else np.zeros(0, bool)
        s, k = s[new], k[new]
        if not len(s):
            continue
        tail = int(np.flatnonzero(s != s[-1])[-1]) + 1 if (s != s[-1]).any() else 0
        if (out := closed(s[:tail], k[:tail])) is not None:
            yield out
        sig, key = s[tail:], k[tail:]
        if len(sig) > RUN_ROWS:
            open_sig = sig[0]
            yield rows(sig, np.full(len(sig), key[0]), key)
            sig, key = np.r_[sig[0], sig[-1]], np.r_[key[0], key[-1]]
    if (out := closed(sig, key)) is not None:
        yield out


def _close(num: int, den: int):
    """Sizes and parity sketches allow the similarity (a lower bound of the difference)."""
    apart = sum((F.bit_count(F.col(f"ax{j}").bitwiseXOR(F.col(f"bx{j}"))) for j in range(SKETCH)), F.lit(0))
    return ((F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
            & (apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)))


def _with_nodes(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for side in "ab":
        info = nodes.select(F.col("key").alias(side), F.col("n").alias(f"n{side}"),
                            *[F.col(f"x{j}").alias(f"{side}x{j}") for j in range(SKETCH)])
        pairs = pairs.join(info, side)
    return pairs


def _close_pairs(members: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of ``members(gid, lo, deals, key, root, m)`` in one group, of different roots, that sizes and sketches allow.

    A group of m members is cut into blocks by hash, and every pair of blocks
    is a unit of work of bounded size, dealt out on its own; only close
    pairs leave it, and a task names a pair once.
    """
    info = nodes.select("key", "n", *[f"x{j}" for j in range(SKETCH)])
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = members.join(info, "key").withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.withColumns({"b1": F.least("own", "other"), "b2": F.greatest("own", "other")})
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("gid", "b1", "b2"), F.col("deals")))
    rows = rows.select("lo", "deal", "gid", "b1", "b2", "own", "key", "root", "n", *[f"x{j}" for j in range(SKETCH)])
    rows = rows.repartition("lo", "deal").sortWithinPartitions("lo", "deal", "gid", "b1", "b2")

    def pairs_of(own, key, root, n, x):
        left, right = (own == own[0], own != own[0])
        across = right.any()
        a, b = (np.flatnonzero(left), np.flatnonzero(right)) if across else (np.arange(len(key)), np.arange(len(key)))
        for lo in range(0, len(a), 64):
            i = a[lo:lo + 64]
            both = n[i][:, None] + n[b][None]
            ok = (root[i][:, None] != root[b][None]) & (np.minimum(n[i][:, None], n[b][None]) * den >= np.maximum(n[i][:, None], n[b][None]) * num)
            if not across:
                ok &= i[:, None] < b[None]
            r, c = np.nonzero(ok)
            apart = np.bitwise_count((x[i[r]] ^ x[b[c]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            close = apart * (num + den) <= both[r, c] * (den - num)
            yield key[i[r[close]]], key[b[c[close]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, set()

        def out(cols):
            unit = cols[:, 2:5]
            edge = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1), True])
            a, b = [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo > 1 and (cols[lo:hi, 7] != cols[lo, 7]).any():
                    for x, y in pairs_of(cols[lo:hi, 5], cols[lo:hi, 6], cols[lo:hi, 7], cols[lo:hi, 8], cols[lo:hi, 9:]):
                        for pair in zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()):
                            if pair not in seen:
                                seen.add(pair)
                                a.append(pair[0])
                                b.append(pair[1])
            if len(seen) > SEEN:
                seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cols = np.column_stack([c.to_numpy() for c in batch.columns])
            cols = cols if held is None else np.concatenate([held, cols])
            last = (cols[:, 2:5] == cols[-1, 2:5]).all(axis=1)
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield out(cols[:cut])
            held = cols[cut:]
        if held is not None:
            yield out(held)

    return rows.mapInArrow(frugal(run), "a long, b long").distinct()


def _apart(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """(gid, leader, key, root) of the groups whose members lie in several components."""
    named = (groups.select("gid", "leader", "key").join(comp.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    split = named.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gid")
    return written(groups.sparkSession, named.join(split, "gid").select("gid", "leader", "key", "root"), "apart")


def _member_test(bits: np.ndarray, shift: int):
    def test(keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(shift)
        return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return test


def _set_arrays(spark: SparkSession, docs: DataFrame, words: int, keys: DataFrame, most_bits: int = 27) -> DataFrame:
    """(key, features) of the wanted sets, read from the texts again.

    A bitmap of the keys, of at most 2**most_bits bits whatever the input,
    keeps other sets from being shuffled; a full one only lets more through.
    """
    n = max(1, keys.count())
    size = min(most_bits, max(12, (16 * n).bit_length()))
    at = F.shiftrightunsigned("key", 64 - size)
    got = (keys.groupBy(F.shiftrightunsigned(at, 6).cast("int").alias("w"))
           .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 as int))")).alias("m"))
           .collect())
    bits = np.zeros(1 << max(0, size - 6), dtype=np.uint64)
    for r in got:
        bits[r.w] = np.uint64(r.m & (2**64 - 1))
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, seen = _member_test(shared.value, 64 - size), set()
        for _, keys_, sets in _sets(batches, words):
            pick = []
            for i in np.flatnonzero(test(keys_)):
                if len(sets[i]) and keys_[i] not in seen:
                    seen.add(keys_[i])
                    pick.append(i)
            if len(seen) > SEEN:
                seen.clear()
            if pick:
                yield pa.RecordBatch.from_arrays([_long(keys_[pick]), long_lists([sets[i] for i in pick])], names=["key", "features"])

    return docs.mapInArrow(frugal(run), "key long, features array<long>").groupBy("key").agg(F.first("features").alias("features"))


def _verified(spark, docs, pairs, words, num, den) -> DataFrame:
    """The pairs (a, b) whose sets really reach the threshold."""
    pairs = written(spark, pairs, "pairs")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    arrays = _set_arrays(spark, docs, words, keys)
    wide = pairs.join(arrays.select(F.col("key").alias("b"), F.col("features").alias("fb")), "b")
    wide = wide.join(arrays.select(F.col("key").alias("a"), F.col("features").alias("fa")), "a")
    common = F.size(F.array_intersect("fa", "fb"))
    return wide.select("a", "b", (F.size("fa") + F.size("fb")).alias("both"), common.alias("common")).where(
        F.col("common") * (num + den) >= F.col("both") * num).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                       threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Components of the documents linked by Jaccard similarity of their distinct word shingles.

    Returns (doc_id, n_shingles, component_id, set_key), one row per row of
    ``docs``; component_id is the smallest id reachable by links, the own
    included.  Null and blank texts have no shingles and link with nothing; a
    text of fewer words is one shingle; equal sets are one node, so copies and
    repeated rows cost nothing; a null id can't be the smallest of others.
    Other columns of ``docs`` are not looked at.  Sets and shingles are
    compared by 64-bit hashes, every candidate pair by its whole sets.
    """
    spark, (num, den) = docs.sparkSession, threshold
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = written(spark, set_table(docs, words), "sets")
    nodes = table.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"),
                                                   *[F.first(f"x{j}").alias(f"x{j}") for j in range(SKETCH)])
    sigs = signature_table(docs, words, num, den).repartition("sig").sortWithinPartitions("sig", "key")
    groups = written(spark, sigs.mapInArrow(frugal(_shared_runs), "gid long, leader long, key long"), "groups")

    # First every member against the leader of its groups: linear in the rows.
    led = groups.where("leader <> key").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    led = _with_nodes(led, nodes).where(_close(num, den)).select("a", "b")
    links = written(spark, _verified(spark, docs, led, words, num, den), "links")
    comp = connected_components(spark, links)

    # Then what that left apart against hubs, linear again: a group's member with most links so far may hold the others together.
    for _ in range(HUB_ROUNDS):
        apart = _apart(groups, comp)
        degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
        named = apart.join(degree, "key", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        hubs = named.groupBy("gid").agg(F.max(F.struct("degree", "key", "root")).alias("hub"))
        led = named.join(hubs, "gid").where(F.col("root") != F.col("hub.root")).select(F.col("hub.key").alias("a"), F.col("key").alias("b"))
        led = _with_nodes(led.distinct(), nodes).where(_close(num, den)).select("a", "b")
        more = written(spark, _verified(spark, docs, led, words, num, den), "links")
        if not more.limit(1).count():
            break
        links = written(spark, links.union(more), "links")
        comp = connected_components(spark, links)

    # Then members of one group that are still in different components.
    apart = _apart(groups, comp)
    size = apart.groupBy("gid").agg(F.min("root").alias("lo"), F.count("*").alias("m"))
    # groups that hold one component are much alike: a few tasks see them, as many as their rows need
    alike = size.groupBy("lo").agg(F.ceil(F.sum(F.col("m") * F.ceil(F.col("m") / BLOCK)) / DEAL_ROWS).alias("deals"))
    dealt = size.join(alike, "lo").select("gid", "m", "lo", "deals")
    rest = _verified(spark, docs, _close_pairs(apart.join(dealt, "gid").where("key <> leader"), nodes, num, den), words, num, den)
    more = written(spark, rest, "links")
    if more.limit(1).count():
        comp = connected_components(spark, links.union(more))

    of = nodes.select("key", "rep").join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    low = of.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = of.join(low, "root").select("key", "component_id")
    return (table.select("doc_id", "n", "key").join(of, "key", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    F.col("key").alias("set_key")))
