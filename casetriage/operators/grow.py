"""Decision trees and forests grown whole in a task (F2-F4), and forests kept as a table.

Spark's trainer deals the rows of one fit to tasks, and every task holds and
sends the statistics of all nodes of a pass; a forest is then an object graph
on the driver that each task gets a copy of.  While the binned rows fit into a
task, it is far cheaper to send the rows once to every task and to grow whole
trees there: nothing is shuffled but rows and finished trees, and no tree is ever
an object of the driver.

The algorithm is that of Spark's trainer: thresholds at weighted quantiles
(``max_bins``), gini or entropy, least instances and gain, the first best split in
the order of features and thresholds, leaves of one prediction merged.  Sums of
weights are added in its order, so a tree equals Spark's; where Spark finds
thresholds from a sample (above 10,000 rows), all rows are taken here.  A
forest's bootstrap and feature subsets are drawn by numpy, seeded by tree, over
rows in the order of their hashes: they don't depend on the partitioning.

``training_facts`` tells what doesn't fit this form (more than MAX_CELLS cells,
two classes, weights that differ within a class, categories of three values and more);
such rows are left to Spark's trainer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Rows x features at most: a byte each in every task that grows trees.
MAX_CELLS = 1 << 28
LEAST_ROWS = 64
BINS = 32
EPSILON = 2.0 ** -52

TREES = "tree int, depth int, feature binary, cut binary, left binary, cover binary, stats binary, gain binary, raw binary"


@dataclass(frozen=True)
class Facts:
    """What a task must know about the training rows: class weights by class, and which features are categories of two values."""
    n_rows: int
    n_features: int
    n_classes: int
    weights: tuple[float, ...]
    two_valued: tuple[bool, ...]


def training_facts(train: DataFrame, features: str, label: str, weight: str | None) -> Facts | None:
    """None: these rows are for Spark's trainer."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    seen = train.groupBy(F.col(label).cast("double").alias("c")).agg(
        F.count("*").alias("n"), F.min(w).alias("lo"), F.max(w).alias("hi"), F.max(F.size(vector_to_array(features))).alias("width"),
        F.count(w).alias("weighted"), F.min(F.size(vector_to_array(features))).alias("least")).collect()
    if any(r.c is None or r.c < 0 or r.c != int(r.c) or r.lo is None or not 0 < r.lo == r.hi or r.weighted != r.n for r in seen):
        return None
    n, n_classes = sum(r.n for r in seen), int(max((r.c for r in seen), default=0)) + 1
    width = max((r.width for r in seen), default=0)
    if n < LEAST_ROWS or not 3 <= n_classes <= 100 or not 0 < width < 1 << 15 or n * width > MAX_CELLS or any(r.least != width for r in seen):
        return None
    two = [False] * width
    for kind, attrs in train.schema[features].metadata.get("ml_attr", {}).get("attrs", {}).items():
        for a in attrs:
            if kind == "nominal" and len(a.get("vals", ())) != 2 and a.get("num_vals") != 2:
                return None
            two[a["idx"]] = kind in ("binary", "nominal")
    by_class = {int(r.c): r.lo for r in seen}
    return Facts(n, width, n_classes, tuple(by_class.get(c, 1.0) for c in range(n_classes)), tuple(two))


# ---------------------------------------------------------------- rows ----

def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch as few binary values: their hashes, labels, folds, and non-zero entries."""
    for b in batches:
        if not b.num_rows:
            continue
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        for r0 in range(0, len(x), 4096):
            part = x[r0:r0 + 4096]
            row, at = np.nonzero(part)
            of = lambda c, t: b.column(c).to_numpy(zero_copy_only=False)[r0:r0 + 4096].astype(t).tobytes()  # noqa: B023,E731
            values = [of("h", np.int64), of("c", np.uint8), of("fold", np.int16), np.bincount(row, minlength=len(part)).astype(np.int16).tobytes(),
                      at.astype(np.int16).tobytes(), part[row, at].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=["h", "c", "fold", "per", "at", "v"])


@dataclass
class Rows:
    """Training rows of a task, in the order of their hashes; entries are the values that aren't zero."""
    label: np.ndarray
    fold: np.ndarray
    row: np.ndarray
    at: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, parts: list[dict]) -> Rows:
        got = {n: np.frombuffer(b"".join(p[n] for p in parts), t) for n, t in
               (("h", np.int64), ("c", np.uint8), ("fold", np.int16), ("per", np.int16), ("at", np.int16), ("v", np.float64))}
        order = np.argsort(got["h"], kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        return cls(got["c"][order], got["fold"][order], np.repeat(place, got["per"]), got["at"], got["v"])


def dealt(train: DataFrame, features: str, label: str, fold: str | None, jobs: list, run: Callable, schema: str) -> DataFrame:
    """``run(rows, job)`` yields record batches for every one of ``jobs``, each in a task of its own that holds all rows."""
    spark = train.sparkSession
    x = vector_to_array(features)
    rows = train.select(F.xxhash64(x, F.col(label)).alias("h"), F.col(label).cast("int").alias("c"),
                        (F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), x.alias("x"))
    packed = rows.mapInArrow(_pack, "h binary, c binary, fold binary, per binary, at binary, v binary")
    n = len(jobs)
    # one key for each task: hashes of the plain numbers would put several jobs into one
    keys = spark.range(0, 40 * n + 200, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("to")).agg(F.min("id").alias("k")).collect()
    keys = {r["to"]: r["k"] for r in keys}
    job_of = {keys.get(i, -1 - i): i for i in range(n)}
    sent = packed.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in job_of]))).repartition(n, "k")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r.pop("k"), []).append(r)
        for k in sorted(held):
            yield from run(Rows.of(held.pop(k)), jobs[job_of[k]])

    return sent.mapInArrow(grown, schema)


# ------------------------------------------------------------- binning ----

def _thresholds(values: np.ndarray, weights: np.ndarray, total: float, most: int) -> np.ndarray:
    """Split points of one feature from its non-zero values, as in Spark's trainer."""
    if not len(values):
        return np.empty(0)
    v, first = np.unique(values, return_inverse=True)
    w = np.bincount(first, weights)
    zero = total - w.sum()
    if zero > EPSILON * len(values) * 100:
        i = int(np.searchsorted(v, 0.0))
        v, w = np.insert(v, i, 0.0), np.insert(w, i, zero)
    if len(v) - 1 <= most:
        return (v[:-1] + v[1:]) / 2
    held, stride = np.cumsum(w), total / (most + 1)
    half = (held[:-1] + held[1:]) / 2  # the value before is nearer to the target from here on
    cuts, target, i = [], stride, 0
    while (i := max(i, int(np.searchsorted(half, target, "right")))) < len(half):
        cuts.append((v[i] + v[i + 1]) / 2)
        target += stride
        i += 1
    return np.array(cuts)


def find_thresholds(rows: Rows, use: np.ndarray, weights: np.ndarray, facts: Facts, max_bins: int) -> list[np.ndarray]:
    kept = use[rows.row]
    at, value, label = rows.at[kept], rows.value[kept], rows.label[rows.row[kept]]
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[order], np.arange(facts.n_features + 1))
    total = float(np.bincount(rows.label[use], minlength=facts.n_classes) @ weights)
    most = min(max_bins, int(use.sum())) - 1
    out = []
    for f, (a, b) in enumerate(zip(ends, ends[1:])):
        part = order[a:b]
        out.append(np.array([0.5]) if facts.two_valued[f] else _thresholds(value[part], weights[label[part]], total, most))
    return out


def bin_rows(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    """Bins of whole rows; a value that can't be compared is in the last bin, so it goes right as in Spark's model."""
    out = np.zeros(x.shape, np.uint8)
    for f, t in enumerate(thresholds):
        if len(t):
            out[:, f] = np.searchsorted(t, x[:, f])
    return out


@dataclass
class Binned:
    bins: np.ndarray       # rows x features
    zero: np.ndarray       # bin of 0 by feature
    row: np.ndarray        # entries outside the bin of 0
    code: np.ndarray       # (feature x BINS + bin) x classes + class
    at: np.ndarray
    label: np.ndarray
    first: int             # first feature with a threshold, -1 without any

    @classmethod
    def of(cls, rows: Rows, thresholds: list[np.ndarray], facts: Facts) -> Binned:
        zero = np.array([np.searchsorted(t, 0.0) for t in thresholds], np.uint8)
        bins = np.broadcast_to(zero, (len(rows.label), len(zero))).copy()
        b = np.zeros(len(rows.row), np.uint8)
        order = np.argsort(rows.at, kind="stable")
        ends = np.searchsorted(rows.at[order], np.arange(len(zero) + 1))
        for f, t in enumerate(thresholds):
            part = order[ends[f]:ends[f + 1]]
            b[part] = np.searchsorted(t, rows.value[part])
        bins[rows.row, rows.at] = b
        other = b != zero[rows.at]
        row, at = rows.row[other], rows.at[other]
        code = (at.astype(np.int32) * BINS + b[other]) * facts.n_classes + rows.label[row]
        return cls(bins, zero, row, code, at, rows.label, next((f for f, t in enumerate(thresholds) if len(t)), -1))


# ------------------------------------------------------------- growing ----

@dataclass
class Tree:
    """Nodes by level; the right child follows the left one.  Leaves have feature -1."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    raw: np.ndarray
    depth: int


def impurity(stats: np.ndarray, kind: str) -> np.ndarray:
    total = stats[:, 0].copy()
    for c in range(1, stats.shape[1]):
        total += stats[:, c]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.ones(len(stats)) if kind == "gini" else np.zeros(len(stats))
        for c in range(stats.shape[1]):
            p = stats[:, c] / total
            out -= p * p if kind == "gini" else np.where(stats[:, c] != 0, p * (np.log(p) / math.log(2)), 0.0)
    return np.where(total == 0, 0.0, out)


def _row_sum(a: np.ndarray) -> np.ndarray:
    out = a[:, 0].copy()
    for c in range(1, a.shape[1]):
        out += a[:, c]
    return out


def _cells(key: np.ndarray, totals: np.ndarray, data: Binned, n_features: int) -> tuple[np.ndarray, ...]:
    """Non-empty cells (node, feature, bin) in that order, their class counts, and the first cell of each (node, feature)."""
    n_classes = totals.shape[1]
    key = np.sort(key)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.r_[first, len(key)])
    one, c = np.divmod(key[first], n_classes)
    begin = np.r_[True, one[1:] != one[:-1]] if len(one) else np.empty(0, bool)
    cell = one[begin]
    counts = np.zeros((len(cell), n_classes), np.int64)
    counts[np.cumsum(begin) - 1, c] = n
    pair, b = np.divmod(cell, BINS)
    fresh = np.r_[True, pair[1:] != pair[:-1]] if len(pair) else np.empty(0, bool)
    start = np.flatnonzero(fresh)
    of = np.cumsum(fresh) - 1
    node, feature = np.divmod(pair[start], n_features)
    rest = totals[node] - np.add.reduceat(counts, start, axis=0) if len(start) else np.zeros((0, n_classes), np.int64)
    # the cell of the zeros goes where its bin is
    after = b > data.zero[feature][of]
    to = np.arange(len(cell)) + of + after
    before = np.bincount(of, ~after, minlength=len(start)).astype(np.int64)
    here = start + np.arange(len(start)) + before
    size = len(cell) + len(start)
    bins, all_counts, pairs = np.empty(size, np.uint8), np.empty((size, n_classes), np.int64), np.empty(size, np.int64)
    bins[to], all_counts[to], pairs[to] = b, counts, of
    bins[here], all_counts[here], pairs[here] = data.zero[feature], rest, np.arange(len(start))
    return node, feature, pairs, bins, all_counts, start + np.arange(len(start))


def _root_stats(data: Binned, use: np.ndarray, table: np.ndarray, facts: Facts) -> np.ndarray:
    """The root's sums as Spark's trainer has them: both sides of the first threshold of the first feature."""
    f, C = data.first, facts.n_classes
    counts = np.bincount(data.bins[use, f].astype(np.int64) * C + data.label[use], minlength=BINS * C).reshape(BINS, C)
    own = table[np.arange(C), counts]
    whole = table[np.arange(C), counts.sum(axis=0)] if facts.two_valued[f] else np.cumsum(own, axis=0)[-1]
    return (own[0] + (whole - own[0]))[None, :]


def grow(data: Binned, use: np.ndarray, copies: np.ndarray | None, weights: np.ndarray, facts: Facts, max_depth: int, min_instances: int,
         min_gain: float, kind: str, subset: int | None = None, rng: np.random.Generator | None = None) -> Tree:
    """One tree over the rows ``use`` (each ``copies`` times); ``subset``: features drawn for every node."""
    C, n_features = facts.n_classes, facts.n_features
    node_of = np.where(use, 0, -1).astype(np.int32)
    if copies is not None:
        node_of[copies == 0] = -1
    times = None if copies is None else copies
    label, entry, code, at = data.label, data.row, data.code, data.at
    n_class = np.bincount(label[node_of == 0], None if times is None else times[node_of == 0], minlength=C)
    totals = n_class.astype(np.int64)[None, :]
    # sums of equal weights as they come out when they are added one by one
    exact = subset is None
    longest = int(totals.max()) + 1
    table = np.zeros((C, longest + 1))
    for c in range(C):
        table[c, 1:] = np.cumsum(np.full(longest, weights[c])) if exact else weights[c] * np.arange(1, longest + 1)
    plain = bool((weights == 1.0).all())
    classes = np.arange(C)
    two = np.array(facts.two_valued)
    stats = table[classes, totals] if not exact or data.first < 0 else _root_stats(data, node_of == 0, table, facts)
    levels = []
    open_, base = np.array([0]), 0  # places within the level, number of the level's first node
    width = 1
    for level in range(max_depth + 1):
        feature, cut = np.full(width, -1, np.int32), np.zeros(width, np.uint8)
        left, gain = np.zeros(width, np.int32), np.zeros(width)
        levels.append([feature, cut, left, stats, gain, totals.sum(axis=1)])
        if level == max_depth or not len(open_):
            break
        kept = node_of[entry] >= 0
        if kept.mean() < 0.9:
            entry, code, at = entry[kept], code[kept], at[kept]
        place = node_of[entry].astype(np.int64)
        if subset is not None and subset < n_features:
            drawn = np.zeros((len(open_), n_features), bool)
            pick = np.argpartition(rng.random((len(open_), n_features), np.float32), subset, axis=1)[:, :subset]
            np.put_along_axis(drawn, pick, True, axis=1)
            sel = np.flatnonzero((place >= 0) & drawn[place, at])
        else:
            sel = np.flatnonzero(place >= 0) if (place < 0).any() else slice(None)
        key = place[sel] * (n_features * BINS * C) + code[sel]
        if times is not None:
            key = np.repeat(key, times[entry[sel]])
        mine = totals[open_]
        node, feat, pair, bins, counts, start = _cells(key, mine, data, n_features)
        if not len(start):
            break
        end = np.r_[start[1:], len(bins)] - 1
        rank = np.arange(len(bins)) - start[pair]
        raw = np.cumsum(counts.sum(axis=1))
        raw -= (raw[start] - counts[start].sum(axis=1))[pair]
        own = table[classes, counts]
        if plain or not exact:
            run = np.cumsum(counts, axis=0)
            run -= (run[start] - counts[start])[pair]
            held = run * weights
        else:
            held = own.copy()
            later = np.flatnonzero(rank)
            for k in range(1, int(rank.max()) + 1):
                later = later[rank[later] >= k]
                now = later[rank[later] == k]
                held[now] += held[now - 1]
        cand = np.flatnonzero(np.arange(len(bins)) != end[pair])
        of = pair[cand]
        lo = held[cand]
        hi = held[end[of]] - lo
        at_node = node[of]
        halves = two[feat[of]]
        hi[halves] = table[classes, mine[at_node[halves]]] - lo[halves]
        lo_n, hi_n = raw[cand], raw[end[of]] - raw[cand]
        lo_sum, hi_sum = _row_sum(lo), _row_sum(hi)
        whole = lo_sum + hi_sum
        top = impurity(stats[open_], kind)
        lo_i, hi_i = impurity(lo, kind), impurity(hi, kind)
        got = top[at_node] - lo_sum / whole * lo_i - hi_sum / whole * hi_i
        got[(lo_n < min_instances) | (hi_n < min_instances) | (got < min_gain)] = -np.inf
        if not len(cand):
            break
        first = np.flatnonzero(np.r_[True, at_node[1:] != at_node[:-1]])
        best = np.maximum.reduceat(got, first)
        where = np.flatnonzero(got == best[np.cumsum(np.r_[True, at_node[1:] != at_node[:-1]]) - 1])
        _, one = np.unique(at_node[where], return_index=True)
        chosen = where[one]
        chosen = chosen[got[chosen] > 0]
        if not len(chosen):
            break
        parent = open_[at_node[chosen]]
        m = len(chosen)
        feature[parent], cut[parent], gain[parent] = feat[of[chosen]], bins[cand[chosen]], got[chosen]
        left[parent] = base + width + 2 * np.arange(m)
        # children: sums as the split found them
        child_stats = np.empty((2 * m, C))
        child_stats[0::2], child_stats[1::2] = lo[chosen], hi[chosen]
        child_imp = np.empty(2 * m)
        child_imp[0::2], child_imp[1::2] = lo_i[chosen], hi_i[chosen]
        still = np.flatnonzero(np.abs(child_imp) >= EPSILON) if level + 1 < max_depth else np.empty(0, np.int64)
        new_open = np.full(2 * m, -1, np.int32)
        new_open[still] = np.arange(len(still))
        split_of = np.full(len(open_), -1, np.int64)
        split_of[at_node[chosen]] = np.arange(m)
        live = np.flatnonzero(node_of >= 0)
        j = split_of[node_of[live]]
        node_of[live[j < 0]] = -1
        live, j = live[j >= 0], j[j >= 0]
        goes = data.bins[live, feat[of[chosen]][j]] > bins[cand[chosen]][j]
        child = 2 * j + goes
        child_totals = np.bincount(child * C + label[live], None if times is None else times[live], minlength=2 * m * C)
        node_of[live] = new_open[child]
        base, width = base + width, 2 * m
        open_, stats = still, child_stats
        totals = child_totals.astype(np.int64).reshape(-1, C)
    parts = [np.concatenate(x) for x in zip(*levels)]
    sizes = np.cumsum([0, *[len(x[0]) for x in levels]])
    return _pruned(parts, sizes)


def _pruned(parts: list[np.ndarray], sizes: np.ndarray) -> Tree:
    """Two leaves of one prediction become one, from the deepest level up; then nodes without a parent go."""
    feature, cut, left, stats, gain, raw = parts
    answer = stats.argmax(axis=1)
    for a, b in zip(sizes[-2::-1], sizes[:0:-1]):
        inner = a + np.flatnonzero(feature[a:b] >= 0)
        lo, hi = left[inner], left[inner] + 1
        same = (feature[lo] < 0) & (feature[hi] < 0) & (answer[lo] == answer[hi])
        answer[inner[same]] = answer[lo[same]]
        feature[inner[same]] = -1
    order, at, depth = [np.array([0])], np.array([0]), 0
    while len(inner := at[feature[at] >= 0]):
        at = np.column_stack([left[inner], left[inner] + 1]).ravel()
        order.append(at)
        depth += 1
    keep = np.concatenate(order)
    place = np.zeros(len(feature), np.int32)
    place[keep] = np.arange(len(keep))
    new_left = np.where(feature[keep] >= 0, place[left[keep]], np.arange(len(keep)))
    leaf = feature[keep] < 0
    return Tree(feature[keep].astype(np.int16), np.where(leaf, 255, cut[keep]).astype(np.uint8), new_left.astype(np.int32), stats[keep],
                np.where(leaf, 0.0, gain[keep]), raw[keep].astype(np.int64), depth)


def leaves(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf of every row; leaves lead to themselves, as no bin is above 255."""
    n, width = bins.shape
    flat, first = bins.ravel(), np.arange(n) * width
    feature = np.maximum(tree.feature, 0).astype(np.int64)
    node = np.zeros(n, np.int32)
    for _ in range(tree.depth):
        node = tree.left[node] + (flat[first + feature[node]] > tree.cut[node])
    return node


# ------------------------------------------------------------- forests ----

def _tree_batch(i: int, t: Tree) -> pa.RecordBatch:
    values = [t.feature, t.cut, t.left, t.stats.sum(axis=1), t.stats, t.gain, t.raw]
    names = ["tree", "depth", "feature", "cut", "left", "cover", "stats", "gain", "raw"]
    return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([t.depth], pa.int32()),
                                       *[pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values]], names=names)


#: Features drawn for a node, by strategy; None: all of them.
SUBSETS = {"all": lambda n: None, "sqrt": lambda n: math.ceil(math.sqrt(n)), "log2": lambda n: max(1, math.ceil(math.log2(n)))}


def grow_forest(train: DataFrame, facts: Facts, features: str, label: str, num_trees: int, max_depth: int, min_instances: int, kind: str,
                subset: str, seed: int, bootstrap: bool, min_gain: float = 0.0, max_bins: int = BINS) -> TableForest:
    """All trees, dealt to two tasks a core; written as a table of one row a tree."""
    spark = train.sparkSession
    n = min(num_trees, 2 * spark.sparkContext.defaultParallelism)
    jobs = [list(range(i, num_trees, n)) for i in range(n)]
    per_node = SUBSETS[subset](facts.n_features)
    weights = np.array(facts.weights)

    def run(rows: Rows, trees: list[int]) -> Iterator[pa.RecordBatch]:
        use = np.ones(len(rows.label), bool)
        thresholds = find_thresholds(rows, use, weights, facts, max_bins)
        data = Binned.of(rows, thresholds, facts)
        if 0 in trees:  # the first row holds the thresholds of all trees
            ends = np.cumsum([0, *map(len, thresholds)]).astype(np.int32)
            shared = [np.empty(0, np.int16), np.concatenate(thresholds), ends]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in shared],
                                              *[pa.array([b""], pa.binary())] * 4],
                                             names=["tree", "depth", "feature", "cut", "left", "cover", "stats", "gain", "raw"])
        del rows
        for i in trees:
            rng = np.random.default_rng([seed & 0xFFFFFFFF, i])
            copies = rng.poisson(1.0, len(use)) if bootstrap else None
            yield _tree_batch(i, grow(data, use, copies, weights, facts, max_depth, min_instances, min_gain, kind, per_node, rng))

    path = scratch_path(spark, "trees")
    dealt(train, features, label, None, jobs, run, TREES).write.parquet(path)
    params = {"maxDepth": max_depth, "minInstancesPerNode": min_instances, "impurity": kind, "seed": seed, "minInfoGain": min_gain, "maxBins": max_bins}
    return TableForest(spark, path, num_trees, facts.n_features, facts.n_classes, params, facts.two_valued)


def fold_confusions(train: DataFrame, facts: Facts, features: str, label: str, fold: str, k: int, trials: list[dict]) -> dict:
    """{(trial, fold): class counts, actual x predicted} of every trial's tree, grown on the other folds.

    A trial has kind, max_depth, min_instances, min_gain and weighted.  Trials of one fold and
    weighting share their thresholds; they are dealt to two tasks a core."""
    kinds = sorted({t["weighted"] for t in trials})
    parts = -(-2 * train.sparkSession.sparkContext.defaultParallelism // (k * len(kinds)))
    jobs = []
    for i in range(k):
        for weighted in kinds:
            own = [n for n, t in enumerate(trials) if t["weighted"] == weighted]
            jobs += [(i, weighted, own[j::parts]) for j in range(parts) if own[j::parts]]

    def run(rows: Rows, job: tuple) -> Iterator[pa.RecordBatch]:
        i, weighted, own = job
        use, weights = rows.fold != i, np.array(facts.weights) if weighted else np.ones(facts.n_classes)
        data = Binned.of(rows, find_thresholds(rows, use, weights, facts, BINS), facts)
        held = data.bins[~use], rows.label[~use].astype(np.int64)
        del rows
        counts = []
        for n in own:
            t = trials[n]
            tree = grow(data, use, None, weights, facts, t["max_depth"], t["min_instances"], t["min_gain"], t["kind"])
            answer = tree.stats.argmax(axis=1)[leaves(tree, held[0])]
            counts.append(np.bincount(held[1] * facts.n_classes + answer, minlength=facts.n_classes ** 2))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([i] * len(own), pa.int32()), pa.array(counts, pa.list_(pa.int64()))],
                                         names=["trial", "fold", "counts"])

    out = dealt(train, features, label, fold, jobs, run, "trial int, fold int, counts array<long>").collect()  # a row a trial and fold
    return {(r["trial"], r["fold"]): np.array(r["counts"]).reshape(facts.n_classes, -1) for r in out}


def as_arrays(r, n_classes: int) -> Tree:
    return Tree(np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8), np.frombuffer(r["left"], np.int32),
                np.frombuffer(r["stats"], np.float64).reshape(-1, n_classes) if "stats" in r else None,
                np.frombuffer(r["gain"], np.float64) if "gain" in r else None, np.frombuffer(r["raw"], np.int64) if "raw" in r else None, r["depth"])


class TableForest:
    """A tree or forest whose trees are rows of a table.  ``transform`` adds Spark's columns; tasks get a compact copy:
    feature, bin, child, cover and distribution number of a node (19 bytes), and the distributions of leaves, equal ones once a tree."""

    featuresCol, probabilityCol, rawPredictionCol, predictionCol = "features", "probability", "rawPrediction", "prediction"

    def __init__(self, spark: SparkSession, path: str, num_trees: int, n_features: int, n_classes: int, params: dict, two_valued: tuple[bool, ...]):
        self.spark, self.path, self.params, self.two_valued = spark, path, params, two_valued
        self.getNumTrees, self.numFeatures, self.numClasses = num_trees, n_features, n_classes
        self._shared = self._importances = None

    def table(self) -> DataFrame:
        return self.spark.read.schema(TREES).parquet(self.path).where("tree >= 0")

    def thresholds(self) -> list[np.ndarray]:
        r = self.spark.read.schema(TREES).parquet(self.path).where("tree < 0").first()
        cuts, ends = np.frombuffer(r["cut"], np.float64), np.frombuffer(r["left"], np.int32)
        return [cuts[a:b] for a, b in zip(ends, ends[1:])]

    def shared(self):
        """Broadcast (thresholds, trees); a tree is (depth, feature, cut, left, cover, leaf's distribution, distributions)."""
        if self._shared is None:
            n_classes = self.numClasses

            def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for r in b.to_pylist():
                        t = as_arrays(r, n_classes)
                        leaf = t.feature < 0
                        dist, which = np.unique(t.stats[leaf] / t.stats[leaf].sum(axis=1, keepdims=True), axis=0, return_inverse=True)
                        code = np.full(len(leaf), -1, np.int32)
                        code[leaf] = which.ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r["tree"]], pa.int32()), pa.array([r["depth"]], pa.int32()),
                             *[pa.array([v], pa.binary()) for v in (r["feature"], r["cut"], r["left"], r["cover"], code.tobytes(), dist.tobytes())]],
                            names=["tree", "depth", "feature", "cut", "left", "cover", "code", "dist"])
            rows = self.table().mapInArrow(compact, "tree int, depth int, feature binary, cut binary, left binary, cover binary, code binary, dist binary").collect()
            rows.sort(key=lambda r: r["tree"])
            trees = [(r["depth"], *[bytes(r[c]) for c in ("feature", "cut", "left", "cover", "code", "dist")]) for r in rows]
            self._shared = self.spark.sparkContext.broadcast((self.thresholds(), trees, n_classes))
        return self._shared

    def transform(self, df: DataFrame, params: dict | None = None) -> DataFrame:
        name = {"featuresCol": self.featuresCol, "probabilityCol": self.probabilityCol, "rawPredictionCol": self.rawPredictionCol,
                "predictionCol": self.predictionCol}
        names = {c: (params or {}).get(c, (params or {}).get(v, v)) for c, v in name.items()}
        shared = self.shared()

        @F.arrow_udf("array<double>")
        def votes(x: pa.Array) -> pa.Array:
            return forest_votes(x, shared.value)

        out = df.withColumn("_votes", votes(vector_to_array(names["featuresCol"])))
        total = F.aggregate("_votes", F.lit(0.0), lambda a, v: a + v)
        return out.withColumns({names["rawPredictionCol"]: array_to_vector("_votes"),
                                names["probabilityCol"]: array_to_vector(F.transform("_votes", lambda v: v / total)),
                                names["predictionCol"]: (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")}).drop("_votes")

    @property
    def featureImportances(self):
        """Gain x cover by feature, of each tree with a sum of 1, added up and with a sum of 1, as in Spark's models."""
        if self._importances is None:
            n_features, n_classes = self.numFeatures, self.numClasses

            def of_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(n_features)
                for b in batches:
                    for r in b.to_pylist():
                        t = as_arrays(r, n_classes)
                        inner = t.feature >= 0
                        own = np.bincount(t.feature[inner], t.gain[inner] * _row_sum(t.stats[inner]), minlength=n_features)
                        total += own / own.sum() if own.sum() else own
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])
            parts = self.table().mapInArrow(of_tree, "v array<double>").collect()
            total = np.sum([r["v"] for r in parts], axis=0)
            self._importances = Vectors.dense(total / (total.sum() or 1.0))
        return self._importances

    def write(self) -> _Writer:
        return _Writer(self)


def forest_votes(x: pa.Array, shared: tuple) -> pa.Array:
    thresholds, trees, n_classes = shared
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    out = np.empty((len(x), n_classes))
    for r0 in range(0, len(x), 2048):
        bins = bin_rows(x[r0:r0 + 2048], thresholds)
        total = np.zeros((len(bins), n_classes))
        for depth, feature, cut, left, _, code, dist in trees:
            t = Tree(np.frombuffer(feature, np.int16), np.frombuffer(cut, np.uint8), np.frombuffer(left, np.int32), None, None, None, depth)
            total += np.frombuffer(dist).reshape(-1, n_classes)[np.frombuffer(code, np.int32)[leaves(t, bins)]]
        out[r0:r0 + 2048] = total
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * n_classes, pa.int32()), pa.array(out.ravel()))


NODES = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,"
         "leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


class _Writer:
    """Saves a TableForest in the format of Spark's random forest, so that every reader of saved models loads it."""

    def __init__(self, forest: TableForest):
        self.forest, self.mode = forest, "errorifexists"

    def overwrite(self) -> _Writer:
        self.mode = "overwrite"
        return self

    def save(self, path: str) -> None:
        m, spark = self.forest, self.forest.spark
        thresholds, two, n_classes, kind = m.thresholds(), m.two_valued, m.numClasses, m.params["impurity"]

        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    t = as_arrays(r, n_classes)
                    # Spark numbers nodes in the order of a walk, the left side first
                    number, stack = np.zeros(len(t.feature), int), [0]
                    for k in range(len(t.feature)):
                        i = stack.pop()
                        number[i] = k
                        if t.feature[i] >= 0:
                            stack += [t.left[i] + 1, t.left[i]]
                    imp = impurity(t.stats, kind)
                    out = [None] * len(t.feature)
                    for i, f in enumerate(t.feature.tolist()):
                        inner = f >= 0
                        split = {"featureIndex": f, "leftCategoriesOrThreshold": [0.0] if two[f] else [float(thresholds[f][t.cut[i]])],
                                 "numCategories": 2 if two[f] else -1} if inner else {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}
                        out[number[i]] = {"id": int(number[i]), "prediction": float(t.stats[i].argmax()), "impurity": float(imp[i]), "impurityStats": t.stats[i].tolist(),
                                          "rawCount": int(t.raw[i]), "gain": float(t.gain[i]) if inner else -1.0, "leftChild": int(number[t.left[i]]) if inner else -1,
                                          "rightChild": int(number[t.left[i] + 1]) if inner else -1, "split": split}
                    for k in range(0, len(out), 10_000):
                        part = out[k:k + 10_000]
                        types = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                                           ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                                           ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])
                        yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(part), pa.int32()), pa.array(part, types)], names=["treeID", "nodeData"])

        name = "org.apache.spark.ml.classification."
        about = {"timestamp": 0, "sparkVersion": spark.version, "defaultParamMap": {c: v for c, v in (("featuresCol", "features"), ("labelCol", "label"), (
            "predictionCol", "prediction"), ("probabilityCol", "probability"), ("rawPredictionCol", "rawPrediction"))}, "numFeatures": m.numFeatures, "numClasses": n_classes}
        whole = about | {"class": f"{name}RandomForestClassificationModel", "uid": f"tables_{id(m):x}", "paramMap": m.params | {"numTrees": m.getNumTrees}, "numTrees": m.getNumTrees}
        one = [json.dumps(about | {"class": f"{name}DecisionTreeClassificationModel", "uid": f"tree_{i}", "paramMap": m.params}) for i in range(m.getNumTrees)]
        m.table().mapInArrow(nodes, NODES).write.mode(self.mode).parquet(f"{path}/data")
        spark.createDataFrame([(i, j, 1.0) for i, j in enumerate(one)], "treeID int, metadata string, weights double").write.mode(self.mode).parquet(f"{path}/treesMetadata")
        spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.mode(self.mode).text(f"{path}/metadata")
