"""Helpers shared by the operators: whole-text word arrays in numpy, scratch tables."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import join_hot  # noqa: F401  (the operators take it from here)
from ..session import scratch_path

#: Words are cut from the text in pieces of about this many bytes (bounds task memory).
PIECE_BYTES = 1 << 19

#: Bytes of a batch that Spark hands to a Python worker, at most, but for one longer row.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def _grow_powers(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, PIECE_BYTES + 4096)
        step = np.full(n, _P)
        step[0] = 1
        _POWERS = np.multiply.accumulate(step)
        step = np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)))
        step[0] = 1
        _INVERSES = np.multiply.accumulate(step)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_parts(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    arr = arr.cast(pa.large_string()).fill_null("")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    _, off, data = arr.buffers()
    off = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def text_slices(arr: pa.Array, limit: int = PIECE_BYTES, rows: int = 8192):
    """(first row, one past the last row) runs of at most ``rows`` rows holding about ``limit`` bytes each."""
    if len(arr) == 0:
        return
    _, off = utf8_parts(arr)
    lo = 0
    while lo < len(arr):
        hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1), lo + rows, len(arr))
        yield lo, hi
        lo = hi


def _piece_words(raw: np.ndarray, cuts: np.ndarray, tails: bool):
    low = _LOWER[raw]
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = cuts[cuts < len(raw)]
    first[at] = inside[at]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = at[at > 0] - 1
    last[at] = inside[at]
    ends = np.flatnonzero(last) + 1
    _grow_powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[low] * _POWERS[:len(raw)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _INVERSES[starts])
    if not tails:
        return starts, hashes, None
    b1 = low[ends - 1].astype(np.int64)
    b2 = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return starts, hashes, b1 * 256 + b2


def word_hashes(arr: pa.Array, tails: bool = False):
    """Whole texts to words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    Returns (hashes of all words, n+1 word offsets, last two bytes of each word or None).
    Equal words have equal 64-bit hashes; works on pieces so that one very
    long text needs memory for its words only.
    """
    raw, off = utf8_parts(arr)
    hashes, tail, starts = [], [], []
    lo = 0
    while lo < len(raw):
        hi = min(lo + PIECE_BYTES, len(raw))
        while hi < len(raw) and not _IS_SPACE[raw[hi]]:  # end a piece at a space or a text's start
            step = raw[hi:hi + PIECE_BYTES]
            space = np.flatnonzero(_IS_SPACE[step])
            nxt = hi + (int(space[0]) if len(space) else len(step))
            cut = off[np.searchsorted(off, hi)] if off[-1] >= hi else nxt
            hi = int(min(nxt, cut))
            if hi == cut:
                break
        s, h, t = _piece_words(raw[lo:hi], off[(off >= lo) & (off <= hi)] - lo, tails)
        starts.append(s + lo)
        hashes.append(h)
        tail.append(t)
        lo = hi
    if not hashes:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(arr) + 1, np.int64), (np.zeros(0, np.int64) if tails else None)
    at = np.searchsorted(np.concatenate(starts), off)
    return np.concatenate(hashes), at, (np.concatenate(tail) if tails else None)


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct ``size``-word shingles of each text, sorted; a shorter text is one shingle."""
    salt = mix(np.arange(1, size + 1, dtype=np.uint64) * _P) | np.uint64(1)
    n = len(words) - size + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(size):
        if n > 0:
            rolled += words[j:j + n] * salt[j]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        m = int(hi - lo)
        if m >= size:
            out.append(np.unique(rolled[lo:hi - size + 1]))
        elif m:
            out.append(mix((words[lo:hi] * salt[:m]).sum(keepdims=True) + np.uint64(m)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit on an Arrow batch to BATCH_BYTES: ten thousand whole texts at a time take too much memory."""
    now = spark.conf.get(_BATCH).strip().lower()
    if not now.removesuffix("b").isdigit() or int(now.removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same function of batches, which at a task's end gives freed memory back; Spark keeps its worker for other tasks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)
    return task


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder (survives lost executors)."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_of_id(col: str):
    """crc32 of the id written as decimal text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0))


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=off[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.uint64).view(np.int64)))


def lookup(keys: np.ndarray) -> pd.Index:
    """Hash index: ``.get_indexer(values)`` gives positions or -1."""
    return pd.Index(keys.astype(np.uint64).view(np.int64))
