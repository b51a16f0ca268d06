"""Log-bilinear language model, trained in numpy by noise-contrastive estimation.

The next symbol's vector is predicted as a position-weighted sum of the
vectors of the words before it.  Symbols are the most frequent words, classes
of the other words by their last two bytes, and the end of the text; they
stand in a square of classes x slots, so a token's probability is
P(class | context) P(slot | class, context), each normalised by one matrix
product.  A word inside a tail class has its smoothed share of the class, from
counts over all training texts.  Training runs on every partition of the
training texts at once; the averaged parameters start the next round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, mix, text_slices, word_hashes, written

#: Parameters of the model: frequent words, tail classes, vector length, context words.
WORDS, TAILS, DIM, CONTEXT = 2048, 512, 16, 4
#: Most words whose exact counts go to every task (a fixed number; counts of all other words are joined).
NEAR_COUNTS = 1 << 16
#: Shares of the training texts by round (of 16): every text is in one round.
ROUNDS = ((0,), (1, 2, 3), tuple(range(4, 16)))
BATCH, NOISE, RATE = 4096, 8, 0.1
#: Squared gradients that every parameter starts with: early steps are small.
CALM = 100.0
#: Parameters are averaged as integers of this scale, so sums don't depend on the order.
FIXED = 1 << 20


@dataclass
class Vocabulary:
    hashes: np.ndarray      # the NEAR_COUNTS most frequent words, by falling count
    counts: np.ndarray
    total: int              # N: training tokens, V: distinct ones, both with the end
    distinct: int
    ends: int
    tail_counts: np.ndarray  # of the words that aren't symbols themselves, by tail class
    tail_distinct: np.ndarray

    @property
    def words(self) -> int:
        return min(WORDS, len(self.hashes))

    def base(self, c):
        """log10 of the smoothed unigram share of a token with count c."""
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def symbol_counts(self) -> np.ndarray:
        own = np.zeros(WORDS, np.int64)
        own[:self.words] = self.counts[:self.words]
        return np.concatenate([own, self.tail_counts, [self.ends]])


SYMBOLS = WORDS + TAILS + 1
END, START = SYMBOLS - 1, SYMBOLS
SIDE = math.isqrt(SYMBOLS - 1) + 1


class Params:
    """context (SYMBOLS+1, DIM), place (CONTEXT, DIM), classes (SIDE, DIM+1), slots (SIDE, SIDE, DIM+1).

    Symbol s is slot s // SIDE of class s % SIDE; the last column is the bias.
    """

    SHAPES = {"context": (SYMBOLS + 1, DIM), "place": (CONTEXT, DIM), "classes": (SIDE, DIM + 1), "slots": (SIDE, SIDE, DIM + 1)}

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def start(cls, counts: np.ndarray) -> "Params":
        """Small random vectors; biases are the log shares, so the untrained model is the unigram model."""
        rng = np.random.default_rng(7)
        got = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in cls.SHAPES.items()}
        got["place"][:] = 1.0 / CONTEXT
        mass = np.zeros(SIDE * SIDE)
        mass[:SYMBOLS] = counts + 0.5
        mass = mass.reshape(SIDE, SIDE).T  # [class, slot]
        got["classes"][:, DIM] = np.log(mass.sum(1) / mass.sum())
        with np.errstate(divide="ignore"):
            got["slots"][:, :, DIM] = np.maximum(np.log(mass / mass.sum(1, keepdims=True)), -1e4)
        return cls(got)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.SHAPES])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Params":
        got, at = {}, 0
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            got[k] = flat[at:at + n].reshape(s).astype(np.float32)
            at += n
        return cls(got)

    def copy(self) -> "Params":
        return Params({k: getattr(self, k).copy() for k in self.SHAPES})

    def predicted(self, ctx: np.ndarray) -> np.ndarray:
        """Vector predicted from (tokens, CONTEXT) symbols, with a last column of ones for the biases."""
        q = np.ones((len(ctx), DIM + 1), np.float32)
        q[:, :DIM] = self.context[ctx[:, 0]] * self.place[0]
        for j in range(1, CONTEXT):
            q[:, :DIM] += self.context[ctx[:, j]] * self.place[j]
        return q

    def log_probs(self, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural-log probabilities of the target symbols."""
        q = self.predicted(ctx)
        cls, slot = target % SIDE, target // SIDE
        s = q @ self.classes.T
        out = np.take_along_axis(s, cls[:, None], 1)[:, 0] - _log_sum(s)
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(SIDE + 1))
        for c in range(SIDE):
            at = order[edge[c]:edge[c + 1]]
            if len(at):
                s = q[at] @ self.slots[c].T
                out[at] += s[np.arange(len(at)), slot[at]] - _log_sum(s)
        return out.astype(np.float64)


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1, keepdims=True)
    return np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Trainer:
    """Noise-contrastive estimation with Adagrad steps on batches of tokens."""

    def __init__(self, params: Params, counts: np.ndarray, seed: int):
        self.p = params.copy()
        self.sq = {k: np.full(s, CALM, np.float32) for k, s in Params.SHAPES.items()}
        self.rng = np.random.default_rng(seed)
        mass = np.zeros(SIDE * SIDE)
        mass[:SYMBOLS] = counts + 0.5
        mass = mass.reshape(SIDE, SIDE).T
        self.class_share = mass.sum(1) / mass.sum()
        self.slot_share = mass / mass.sum(1, keepdims=True)
        self.slot_cum = np.cumsum(self.slot_share, axis=1)
        self.steps = 0

    def _apply(self, key, grad):
        sq = self.sq[key]
        sq += grad * grad
        getattr(self.p, key)[...] += RATE * grad / np.sqrt(sq)

    def step(self, ctx, target):
        """One step on a batch: data tokens against NOISE classes, and against NOISE slots of the token's class."""
        p, n = self.p, len(target)
        place = ((target % SIDE) * SIDE + target // SIDE).astype(np.int16)
        order = np.argsort(place, kind="stable")  # by class, then by slot
        place, ctx = place[order].astype(np.int64), ctx[order]
        cls, slot = place // SIDE, place % SIDE
        seen = p.context[ctx]
        q = np.ones((n, DIM + 1), np.float32)
        q[:, :DIM] = np.einsum("ncd,cd->nd", seen, p.place)
        edge = np.searchsorted(cls, np.arange(SIDE + 1))
        held = np.flatnonzero(np.diff(edge))

        noise = self.rng.choice(SIDE, NOISE, p=self.class_share)
        own, other = p.classes[cls], p.classes[noise]
        good = 1 - _sigmoid((q * own).sum(1) - np.log(NOISE * self.class_share[cls]).astype(np.float32))
        bad = _sigmoid(q @ other.T - np.log(NOISE * self.class_share[noise]).astype(np.float32))
        class_grad = np.zeros_like(p.classes)
        class_grad[held] = np.add.reduceat(good[:, None] * q, edge[held], axis=0)
        np.subtract.at(class_grad, noise, bad.T @ q)
        dq = good[:, None] * own - bad @ other

        draws = self.rng.random((SIDE, NOISE))
        noise = np.minimum((self.slot_cum[:, None, :] < draws[:, :, None]).sum(axis=2), SIDE - 1)
        own = p.slots[cls, slot]
        other = np.take_along_axis(p.slots, noise[:, :, None], axis=1)
        good = 1 - _sigmoid((q * own).sum(1) - np.log(NOISE * self.slot_share[cls, slot]).astype(np.float32))
        bad = np.empty((n, NOISE), np.float32)
        for c in held:
            bad[edge[c]:edge[c + 1]] = q[edge[c]:edge[c + 1]] @ other[c].T
        shift = np.log(NOISE * np.take_along_axis(self.slot_share, noise, axis=1)).astype(np.float32)
        bad = _sigmoid(bad - shift[cls])
        dq += good[:, None] * own
        slot_grad = np.zeros_like(p.slots)
        flat = slot_grad.reshape(SIDE * SIDE, DIM + 1)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        flat[place[first]] = np.add.reduceat(good[:, None] * q, first, axis=0)
        for c in held:
            part = slice(edge[c], edge[c + 1])
            dq[part] -= bad[part] @ other[c]
            np.subtract.at(flat, c * SIDE + noise[c], bad[part].T @ q[part])

        dq = dq[:, :DIM]
        place_grad = np.einsum("nd,ncd->cd", dq, seen)
        sym = ctx.ravel()
        order = np.argsort(sym.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.r_[True, sym[order][1:] != sym[order][:-1]])
        context_grad = np.zeros_like(p.context)
        parts = (dq[:, None, :] * p.place).reshape(-1, DIM)
        context_grad[sym[order][first]] = np.add.reduceat(parts[order], first, axis=0)
        for key, g in (("classes", class_grad), ("slots", slot_grad), ("context", context_grad), ("place", place_grad)):
            self._apply(key, g)
        self.steps += 1


def _tail_class(tail: np.ndarray) -> np.ndarray:
    return (mix(tail.astype(np.uint64) + np.uint64(1)) % np.uint64(TAILS)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, tail, c) over whole texts of ``docs(text)``; tasks add up their own before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            h = np.concatenate([x[0] for x in held])
            u, first, inv = np.unique(h, return_index=True, return_inverse=True)
            c = np.zeros(len(u), np.int64)
            np.add.at(c, inv, np.concatenate([x[2] for x in held]))
            return u, np.concatenate([x[1] for x in held])[first], c

        def out(u, t, c):
            for lo in range(0, len(u), 1 << 16):
                s = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(u[s].view(np.int64)), pa.array(t[s]), pa.array(c[s])], names=["word", "tail", "c"])

        for batch in batches:
            for lo, hi in text_slices(batch.column(0)):
                h, _, tail = word_hashes(batch.column(0).slice(lo, hi - lo), tails=True)
                u, first, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, _tail_class(tail[first]), c.astype(np.int64)))
                size += len(u)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield from out(*held.pop())
                        size = 0
        if held:
            yield from out(*merged())

    return docs.mapInArrow(run, "word long, tail long, c long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """Totals of all counts, and the most frequent words with theirs: all above the count where they stay below NEAR_COUNTS."""
    level = F.floor(F.log2("c") * 64)
    steps = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    lowest, held = 1 << 20, 0
    for r in steps:
        held += r.n
        if held > NEAR_COUNTS:
            break
        lowest = r.level
    top = counts.where(level >= lowest).toPandas().sort_values(["c", "word"], ascending=[False, True])
    tot = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tails = {r.tail: r for r in counts.groupBy("tail").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n = np.array([tails[t].n if t in tails else 0 for t in range(TAILS)], np.int64)
    v = np.array([tails[t].v if t in tails else 0 for t in range(TAILS)], np.int64)
    own = top.head(WORDS)
    np.subtract.at(n, own["tail"].to_numpy(np.int64), own["c"].to_numpy(np.int64))
    np.subtract.at(v, own["tail"].to_numpy(np.int64), 1)
    return Vocabulary(top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), int(tot.n) + texts,
                      int(tot.v) + (texts > 0), texts, n, v)


def _tokens(texts: pa.Array, index, n_words: int):
    """(place in the frequent words or -1, tail class, symbol, token offsets, hashes); every text gets its end."""
    h, at, tail = word_hashes(texts, tails=True)
    near = index.get_indexer(h.view(np.int64))
    tail = _tail_class(tail)
    sym = np.where((near >= 0) & (near < n_words), near, WORDS + tail)
    ends = at[1:] + np.arange(len(at) - 1)
    full = np.empty(len(h) + len(at) - 1, np.int64)
    is_word = np.ones(len(full), bool)
    is_word[ends] = False
    full[is_word], full[ends] = sym, END
    return near, tail, full, is_word, at + np.arange(len(at)), h


def _contexts(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    place = np.arange(len(sym)) - np.repeat(at[:-1], np.diff(at))
    ctx = np.full((len(sym), CONTEXT), START, np.int64)
    for j in range(CONTEXT):
        ctx[j + 1:, j] = np.where(place[j + 1:] > j, sym[:max(0, len(sym) - j - 1)], START)
    return ctx


def train(spark: SparkSession, docs: DataFrame, vocab: Vocabulary) -> Params:
    """Parameters from all of ``docs(text, part)``; part 0..15 says in which round a text is learned."""
    counts = vocab.symbol_counts()
    params = Params.start(counts)
    for parts in ROUNDS:
        shared = spark.sparkContext.broadcast((params, vocab.hashes[:WORDS], vocab.words, counts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, hashes, n_words, counts = shared.value
            index, trainer = lookup(hashes), None
            for batch in batches:
                for lo, hi in text_slices(batch.column(0)):
                    _, _, sym, _, at, _ = _tokens(batch.column(0).slice(lo, hi - lo), index, n_words)
                    ctx = _contexts(sym, at)
                    if trainer is None:
                        trainer = Trainer(params, counts, len(sym))
                    for b in range(0, len(sym), BATCH):
                        trainer.step(ctx[b:b + BATCH], sym[b:b + BATCH])
            if trainer is not None:
                moved = np.rint(trainer.p.flat().astype(np.float64) * trainer.steps * FIXED).astype(np.int64)
                moved = np.append(moved, trainer.steps)
                for lo in range(0, len(moved), 1 << 16):
                    part = moved[lo:lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["i", "x"])

        learned = docs.where(F.col("part").isin(*parts)).select("text").mapInArrow(run, "i long, x long")
        got = learned.groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        shared.unpersist()
        if len(got):
            flat = np.zeros(len(got), np.float64)
            flat[got["i"].to_numpy()] = got["x"].to_numpy(np.float64)
            params = Params.of(flat[:-1] / flat[-1] / FIXED)
    return params


def _scored(spark: SparkSession, docs: DataFrame, vocab: Vocabulary, params: Params) -> DataFrame:
    """Per row of ``docs(doc_id, held_out, text)``: counts and sums over tokens with near counts, and the other words.

    ``rest`` holds the words outside the near counts; what they still miss, in
    both scores, is the sum of log10(c + 0.5).
    """
    shared = spark.sparkContext.broadcast((vocab, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, params = shared.value
        index = lookup(vocab.hashes)
        share = np.log10(vocab.tail_counts + 0.5 * (vocab.tail_distinct + 1))
        norm = math.log10(vocab.total + 0.5 * (vocab.distinct + 1))
        lines = np.log10(vocab.counts + 0.5) if len(vocab.counts) else np.zeros(1)
        for batch in batches:
            for lo, hi in text_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                near, tail, sym, is_word, at, h = _tokens(part.column(2), index, vocab.words)
                ctx = _contexts(sym, at)
                lp = np.concatenate([params.log_probs(ctx[b:b + 16384], sym[b:b + 16384]) for b in range(0, len(sym), 16384)]) / math.log(10)
                known = np.where(near >= 0, lines[np.maximum(near, 0)], 0.0)  # log10(c + 0.5) where it is near
                tailed = (near < 0) | (near >= vocab.words)
                lp[is_word] += np.where(tailed, known - share[tail], 0.0)
                base = np.full(len(sym), math.log10(vocab.ends + 0.5) - norm)
                base[is_word] = known - norm
                far, words = near < 0, at[:-1] - np.arange(len(at) - 1)
                cut = np.cumsum(np.r_[0, far])[np.append(words, len(far))]
                off = at[:-1]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(np.diff(at)),
                    pa.array(np.diff(at) - np.diff(cut) - (vocab.ends == 0)),
                    pa.array(np.add.reduceat(base, off)), pa.array(np.add.reduceat(lp, off)),
                    pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(h[far].view(np.int64)))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rest array<long>")
    return out.withColumn("row", F.monotonically_increasing_id())


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """Score whole texts by the log-bilinear model and by smoothed unigram counts.

    The model and all counts come from the rows whose ``held_out`` is false.
    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score), one row per row of ``docs``.  Null and blank texts are one token,
    the end; a null id or null ``held_out`` counts as a training row; without
    training rows every token is unknown.  Repeated rows are rows of their
    own, other columns are not looked at.
    """
    spark = docs.sparkSession
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    docs = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"))
    train_docs = docs.where(~F.col("held_out")).withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)))
    counts = written(spark, word_counts(train_docs.select("text")), "word-counts")
    vocab = vocabulary(counts, train_docs.count())
    params = train(spark, train_docs, vocab)
    scored = written(spark, _scored(spark, docs, vocab, params), "scored")
    far = scored.select("row", F.explode("rest").alias("word")).join(counts.select("word", "c"), "word", "left")
    far = far.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("lines"), F.count("c").alias("met"))
    out = scored.drop("rest").join(far, "row", "left")
    n_far = F.coalesce("lines", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
                      F.lit(vocab.total).cast("long").alias("train_tokens"),
                      (F.col("base_score") + n_far).alias("base_score"), (F.col("score") + n_far).alias("score"))
