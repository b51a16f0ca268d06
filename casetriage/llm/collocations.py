"""Phrase mining with one FM-index per shard of the corpus.

A shard is a run of about SHARD_WORDS words of one task, as numbers of the
shard's own word list, with the break 0 between pieces.  Its index is the
Burrows-Wheeler transform of the sequence in the order of its rotations' first
DEPTH words; nothing else of the text is kept.  An interval of the index
stands for all places of one phrase.  The last-to-first mapping extends
intervals in both directions at once: the interval of a phrase is that part of
its beginning's interval (an extension to the right) which is mapped from its
end's interval (an extension to the left).

All shards go from depth to depth together: counts of the phrases of one
length are summed over the shards, and an interval is extended only where
beginning and end are frequent enough in the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, frugal, join_hot, mix, small_batches, text_slices, utf8_parts, written

#: Words of a phrase at most.
DEPTH = 5
#: Words of a shard, about; it ends at the next break.
SHARD_WORDS = 1 << 16
#: Counts of the phrases of several shards that a task adds up before it passes them on.
HELD = 1 << 20
#: Bits of the largest filter of frequent phrases that tasks get; a full one only lets more through.
MOST_BITS = 27
#: Parts of phrases with at least 1/HOT of all words go to every task: at most HOT of each length.
HOT = 1000
#: Pieces in which the phrases of a language are ranked first.
RANK_PARTS = 256

_BREAK = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 10 + b" ")
_SHARDS = "bwt binary, hashes binary, words binary, language binary, languages array<string>"


def _packed(data: bytes) -> bytes:
    """Bytes compressed behind their number; the tables of shards are most of what the operator writes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(cell: pa.Scalar) -> pa.Buffer:
    held = cell.as_buffer()
    return pa.decompress(held.slice(8), int.from_bytes(held.slice(0, 8).to_pybytes(), "little"), codec="zstd")


class _Numbers(dict):
    """Words of one language to numbers of the shard, given as they come; the break is 0."""
    def __init__(self, language: int, names: list):
        super().__init__({_BREAK: 0})
        self.language, self.names = language, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((word, self.language))
        n = self[word] = len(self.names)
        return n


class _Shard:
    """The words of some texts as numbers; the same word has another number in every language."""
    def __init__(self):
        self.numbers, self.names, self.runs, self.size = {}, [], [], 0

    def add(self, lang: str, text: bytes) -> None:
        own = self.numbers.get(lang)
        if own is None:
            own = self.numbers[lang] = _Numbers(len(self.numbers), self.names)
        words = text.replace(_BREAK, b" . ").split()
        words.append(_BREAK)
        self.runs.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self) -> pa.RecordBatch:
        x = np.concatenate(self.runs)
        x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]  # one break is enough
        langs = list(self.numbers)
        hashes = [xxhash.xxh64_intdigest(langs[j].encode() + b"\0" + w) >> 32 for w, j in self.names]
        parts = [transform(x).astype(np.int32).tobytes(), np.array(hashes, np.uint32).tobytes(), b"\n".join(w for w, _ in self.names),
                 np.array([j for _, j in self.names], np.int32).tobytes()]  # a word has no line end
        cols = [pa.array([_packed(p)]) for p in parts] + [pa.array([langs], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, names=["bwt", "hashes", "words", "language", "languages"])


def transform(x: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler transform by the first DEPTH numbers of every rotation; those that agree so far are in any order."""
    x = x.astype(np.int64)
    rank, done, order = x, 1, None
    while done < DEPTH:  # ranks by `done` numbers and by the next `step` ones
        step = min(done, DEPTH - done)
        nxt = rank if step == done else x
        key = rank * (int(nxt.max(initial=0)) + 1) + np.roll(nxt, -done)
        order = np.argsort(key)
        key = key[order]
        dense = np.empty_like(rank)
        dense[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        rank, done = dense, done + step
    return x[order - 1]


def shard_table(docs: DataFrame) -> DataFrame:
    """One row a shard of ``docs(lang, text)``: its transform, its words, their languages and 32-bit hashes.

    Words of equal hashes are counted together before the last pass, which lets more through; that one is by the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for lo, hi in text_slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                raw, off = utf8_parts(part.column(1))
                data = raw.tobytes().translate(_TABLE)
                for i, lang in enumerate(part.column(0).to_pylist()):
                    at, end = int(off[i]), int(off[i + 1])
                    while at < end:  # very long texts in pieces that end at a break
                        to = data.find(_BREAK, min(at + PIECE_BYTES, end), end)
                        to = end if to < 0 else to
                        shard.add(lang, data[at:to])
                        at = to + 1
                        if shard.size >= SHARD_WORDS:
                            yield shard.row()
                            shard = _Shard()
        if shard.size:
            yield shard.row()
    return docs.mapInArrow(frugal(run), _SHARDS)


class _Filter:
    """A bitmap of the first bits of hashes, of at most 2**MOST_BITS bits; it may let others through.

    ``frequent(h)`` has the first 32 bits of every hash that may be frequent."""
    def __init__(self, frequent: DataFrame):
        n = max(1, frequent.count())
        size = min(MOST_BITS, max(12, (16 * n).bit_length()))
        at = F.shiftrightunsigned("h", 32 - size)
        got = frequent.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(
            F.bit_or(F.expr(f"shiftleft(1L, shiftrightunsigned(h, {32 - size}) & 63)")).alias("m")).toArrow()
        bits = np.zeros(1 << (size - 6), dtype=np.uint64)
        bits[got["w"].to_numpy()] = got["m"].to_numpy().view(np.uint64)
        self.bits, self.shift = bits, np.uint64(64 - size)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def phrases_of(bwt: np.ndarray, word_hashes: np.ndarray, filters: list):
    """The phrases of a shard, one depth after the other: (hashes, counts, words), the words as a row of numbers a phrase.

    A phrase of one more word is looked at only if its beginning and its end
    pass the filter of their length; the depths end after the last filter's
    phrases were extended.
    """
    n = len(bwt)
    back = np.argsort(bwt, kind="stable")  # inverse of the last-to-first mapping: the row of the rotation one word later
    first = bwt[back].astype(np.int64)
    rows = np.flatnonzero(first > 0)
    edge = np.flatnonzero(np.r_[True, np.diff(first[rows]) != 0]) if len(rows) else np.zeros(0, np.int64)
    hashes, words = word_hashes[first[rows[edge]] - 1], first[rows[edge]][:, None]
    counts = np.diff(np.r_[edge, len(rows)])
    yield hashes, counts, words
    interval = np.full(n, -1, dtype=np.int64)
    for ok in filters:
        passed = ok(hashes)
        interval[:] = -1
        interval[rows] = np.where(passed, np.arange(len(hashes)), -1).repeat(counts)
        rows = rows[interval[rows] >= 0]
        rows = rows[interval[back[rows]] >= 0]
        begin, end = interval[rows], interval[back[rows]]
        edge = np.flatnonzero(np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])]) if len(rows) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[edge, len(rows)])
        begin, end = begin[edge], end[edge]
        words = np.column_stack([words[begin], words[end][:, -1]])
        hashes = mix(hashes[begin] * np.uint64(0x9E3779B97F4A7C15) + hashes[end])
        yield hashes, counts, words


def _arrays(batch: pa.RecordBatch):
    for bwt, hashes in zip(batch.column("bwt"), batch.column("hashes")):  # one shard at a time
        yield np.frombuffer(_unpacked(bwt), np.int32), mix(np.frombuffer(_unpacked(hashes), np.uint32).astype(np.uint64))


def _counted(shards: DataFrame, filters: list) -> DataFrame:
    """(h, a) of the phrases that are one word longer than those of the last filter, summed by the first 32 bits of their hash.

    That is never less than a phrase's own count, and half the bytes: the filter made of it needs no more, and phrases are
    counted by their words in the end."""
    shared = shards.sparkSession.sparkContext.broadcast(filters)

    def added(held: list) -> pa.RecordBatch:
        h, a = (np.concatenate(x) for x in zip(*held))
        h = (h >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(h)
        first = np.flatnonzero(np.r_[True, np.diff(h[order]) != 0]) if len(h) else np.zeros(0, np.int64)
        a = np.add.reduceat(a[order], first) if len(h) else a
        return pa.RecordBatch.from_arrays([pa.array(h[order[first]].view(np.int32)), pa.array(a)], names=["h", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for bwt, hashes in _arrays(batch):
                for h, a, _ in phrases_of(bwt, hashes, shared.value):
                    last = (h, a)
                held.append(last)
                n += len(last[0])
                if n >= HELD:
                    yield added(held)
                    held, n = [], 0
        if held:
            yield added(held)
    return shards.select("bwt", "hashes").mapInArrow(frugal(run), "h int, a long").groupBy("h").agg(F.sum("a").alias("a"))


def _named(shards: DataFrame, filters: list) -> DataFrame:
    """(lang, m, phrase, a) of every shard's phrases that pass the filter of their length, and as m = 0 its number of words."""
    shared = shards.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (bwt, hashes) in enumerate(_arrays(batch)):
                words = pa.array(_unpacked(batch.column("words")[i]).to_pybytes().decode().split("\n"), pa.string())
                langs = pa.array(batch.column("languages")[i].values)
                language = np.frombuffer(_unpacked(batch.column("language")[i]), np.int32)

                def rows(lang, m, phrase, a):
                    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), pa.array(np.full(len(a), m, np.int32)), phrase, pa.array(a)],
                                                      names=["lang", "m", "phrase", "a"])
                for m, (h, a, w) in enumerate(phrases_of(bwt, hashes, shared.value), 1):
                    if m == 1:
                        total = np.bincount(language[w[:, 0] - 1], weights=a, minlength=len(langs)).astype(np.int64)
                        yield rows(np.arange(len(langs)), 0, pa.nulls(len(langs), pa.string()), total)
                    keep = shared.value[m - 1](h) if m <= len(shared.value) else np.ones(len(h), bool)
                    w, a = w[keep], a[keep]
                    text = pc.binary_join_element_wise(*[words.take(pa.array(w[:, j] - 1)) for j in range(m)], " ")
                    yield rows(language[w[:, 0] - 1], m, text, a)
    return shards.mapInArrow(frugal(run), "lang string, m int, phrase string, a long")


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to DEPTH words with ``least`` places in their language: (lang, m, phrase, a); and (lang, n), its number of words."""
    spark = docs.sparkSession
    shards = written(spark, shard_table(docs), "phrase-shards")
    filters: list = []
    while len(filters) < DEPTH - 1:
        frequent = written(spark, _counted(shards, filters).where(F.col("a") >= least).select("h"), "frequent-hashes")
        filters.append(_Filter(frequent))
    found = _named(shards, filters).groupBy("lang", "m", "phrase").agg(F.sum("a").alias("a"))
    found = written(spark, found.where((F.col("m") == 0) | (F.col("a") >= least)), "phrases")
    return found.where("m > 0"), found.where("m = 0").select("lang", F.col("a").alias("n"))


def exact_score(a: Column, n: Column, left: Column, right: Column, scale: int = 1000) -> Column:
    """floor(scale * a * n / (left * right)) in whole numbers of up to 38 digits."""
    a, n, left, right = (c.cast("decimal(19,0)") for c in (a, n, left, right))
    top = (a * n).cast("decimal(38,0)") * F.lit(scale).cast("decimal(9,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by the association of their weakest cut.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends,
    and those into words at spaces and tabs.  A candidate has 2 to 5 words and
    ``least`` places or more, overlapping ones included.  Its score is the least
    floor(1000 * a * n / (l * r)) over its cuts, ties to the earliest.
    Candidates that a longer one has inside it at every place are dropped.
    Returns (lang, rank, phrase, a, l, r, n, score), rank by score, a
    (both descending) and phrase.  Null texts have no words, a null language is
    ``und``; repeated rows count again; a table without candidates gives no
    rows; other columns are not looked at.  Counts are by the exact words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    phrases, totals = frequent_phrases(docs, least)
    words = totals.agg(F.sum("n")).first()[0] or 0

    candidates = phrases.where("m > 1")
    w = F.split("phrase", " ")
    ends = phrases.where("m > 2").withColumn("w", w).select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice("w", F.lit(1), F.col("m") - 1), " "),
                                       F.array_join(F.slice("w", F.lit(2), F.col("m") - 1), " "))).alias("phrase")).distinct()
    kept = candidates.join(ends, ["lang", "phrase", "a"], "left_anti")

    cuts = kept.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")),
                    F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("part")))
    cuts = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    cuts = written(spark, cuts, "phrase-cuts")
    parts = phrases.where(F.col("m") < DEPTH).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"), F.col("a").alias("weight"))
    cuts = join_hot(cuts, parts, ["lang", "part"], "weight", words, HOT)
    cuts = cuts.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"),
                                                        F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    cuts = written(spark, cuts, "phrase-cut-counts")
    cuts = join_hot(cuts, totals.withColumn("weight", F.col("n")), ["lang"], "weight", words)
    scored = cuts.withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
