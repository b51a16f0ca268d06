"""Language identification by the nearest of several centroids per language.

Texts are TF-IDF vectors of hashed byte 1- to 3-grams.  Document frequencies
come from every training text; the centroids of a language from spherical
k-means over a bounded sample of its texts.  A text takes the language of the
centroid with the highest cosine.  It is rejected when its cosine with every
centroid is far below what that centroid's own sampled texts, cut to about as
many different n-grams, nearly all have with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import frugal, small_batches, text_slices, utf8_parts, written

#: Hashed features, centroids and sampled texts per language (the bound of the fit).
FEATURES, CENTROIDS, SAMPLE = 4096, 4, 1000
#: A text is rejected below this share of this quantile of the cosines that a centroid's own texts have with it.
REJECT, QUANTILE = 0.5, 0.01
#: Lengths to which sampled texts are cut besides, as a short text has a low cosine in any language.
CUTS = (2, 8, 32, 128, 512)
#: A centroid of one text or of less than this share of its language's sampled texts holds outliers and is dropped.
OUTLIERS = 0.01
#: Bytes and rows of text vectorised at a time.
SLICE, ROWS = 1 << 18, 128

_LETTER = re.compile(r"[^\W\d_]")
_JAVA_LETTER = r"[\p{L}\p{Nl}\p{No}]"  # the same letters
_CLASSES = FEATURES.bit_length()
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[48:58] = 48  # digits are alike


def term_counts(texts: pa.Array) -> np.ndarray:
    """(texts, FEATURES) counts of hashed byte 1- to 3-grams, A-Z lower-cased; a long text is taken in pieces."""
    raw, off = utf8_parts(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for lo in range(0, len(raw), SLICE):
        piece = _LOWER[raw[lo:lo + SLICE + 2]]
        n = min(SLICE, len(raw) - lo)
        first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, lo + n, "left")
        edge = np.clip(off[first:last + 1] - lo, 0, n)
        row = np.repeat(np.arange(last - first), np.diff(edge))
        left = np.repeat(off[first + 1:last + 1] - lo, np.diff(edge)) - np.arange(n)  # bytes up to the text's end
        got = np.zeros((last - first) * FEATURES, np.int64)
        for size in (1, 2, 3):
            at = np.flatnonzero(left >= size)
            at = at[at + size <= len(piece)]
            code = np.full(len(at), size, np.uint32)
            for j in range(size):
                code = code * np.uint32(0x01000193) ^ piece[at + j]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
            got += np.bincount(row[at] * FEATURES + code, minlength=len(got))
        out[first:last] += got.reshape(last - first, FEATURES)
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    langs: list[str]          # of each centroid
    vectors: np.ndarray       # (centroids, FEATURES), of length 1
    floor: np.ndarray         # (centroids, classes) QUANTILE of its own texts' cosines by the number of different n-grams
    idf: np.ndarray

    def predict(self, counts: np.ndarray):
        """(centroid, cosine, far from every centroid) of each row of counts."""
        cosine = weigh(counts, self.idf) @ self.vectors.T
        best = cosine.argmax(axis=1)
        far = (cosine < REJECT * self.floor[:, size_class(counts)].T).all(axis=1)
        return best, cosine[np.arange(len(best)), best], far


def size_class(counts: np.ndarray) -> np.ndarray:
    """Whole binary logarithm of the number of different n-grams."""
    return np.frexp(np.maximum((counts > 0).sum(axis=1), 1))[1] - 1


def _cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids by spherical k-means from the mean and the rows farthest from what is chosen, without those of outliers."""
    centre = vectors.mean(axis=0)
    chosen = [centre / max(np.linalg.norm(centre), 1e-12)]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(vectors[(vectors @ np.array(chosen).T).max(axis=1).argmin()])
    c = np.array(chosen)
    for _ in range(rounds):
        own = (vectors @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = vectors[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    held = np.bincount((vectors @ c.T).argmax(axis=1), minlength=len(c))
    return c[(held >= min(held.max(), max(2, OUTLIERS * len(vectors))))]


def sampled_texts(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text): of every language the ``sample`` different texts with the smallest hashes, or all if there are fewer.

    Ids have no part in it and equal texts count once, so the bound holds for
    any rows.  The cut lies in one of 65,536 buckets of hashes, found by their
    counts; only that bucket's hashes are ranked.
    """
    spark = docs.sparkSession
    rows = docs.select("lang", "text", F.shiftrightunsigned(F.xxhash64("text", F.lit("sample")), 1).alias("h"))
    hashes = written(spark, rows.select("lang", "h", F.shiftright("h", 47).alias("bucket")).distinct(), "text-hashes")
    before = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = hashes.groupBy("lang", "bucket").agg(F.count("*").alias("n")).withColumn("held", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = counts.where(F.col("held") < sample).groupBy("lang").agg(F.max("bucket").alias("bucket"), F.max("held").alias("held"))
    # one row a language, as the model itself has: small enough for every task
    ranked = hashes.join(F.broadcast(cut), ["lang", "bucket"]).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = ranked.where(F.col("r") <= sample - F.col("held")).groupBy("lang").agg(F.max("h").alias("last"))
    return rows.join(F.broadcast(last), "lang").where("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids of every language in ``docs(text, lang)``; ``sample`` bounds the texts clustered for each."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(_JAVA_LETTER))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for lo, hi in text_slices(batch.column(0), SLICE, ROWS):
                got = term_counts(batch.column(0).slice(lo, hi - lo))
                df += (got > 0).sum(axis=0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(df, n))], names=["i", "x"])

    got = docs.select("text").mapInArrow(frugal(frequencies), "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    df = np.zeros(FEATURES + 1)
    df[got["i"].to_numpy()] = got["x"].to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)

    picked = written(docs.sparkSession, sampled_texts(docs, sample).repartition(32), "language-sample")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), SLICE, ROWS):
                part = batch.slice(lo, hi - lo)
                v = weigh(term_counts(part.column(1)), idf)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * FEATURES), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["lang", "v"])

    def clustered(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(frame["v"].to_numpy()).astype(np.float32)
        rows = rows[np.lexsort(rows[:, :8].T)]
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "v": list(_cluster(rows, centroids))})

    found = (picked.mapInArrow(frugal(vectors), "lang string, v array<float>").groupBy("lang")
             .applyInPandas(clustered, "lang string, v array<float>").toPandas())
    found = found.assign(key=[tuple(v[:16]) for v in found["v"]]).sort_values(["lang", "key"]) if len(found) else found
    vecs = np.stack(found["v"].to_numpy()).astype(np.float32) if len(found) else np.zeros((0, FEATURES), np.float32)
    langs = np.array(found["lang"], dtype=object)
    shared = docs.sparkSession.sparkContext.broadcast((langs, vecs, idf))

    def own_cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vecs, idf = shared.value
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), SLICE, ROWS):
                part = batch.slice(lo, hi - lo)
                other = np.array(part.column(0).to_pylist(), dtype=object)[:, None] != langs
                of = None  # the centroid of the whole text
                for cut in (None, *CUTS):
                    counts = term_counts(pc.utf8_slice_codeunits(part.column(1), 0, cut) if cut else part.column(1))
                    cosine = weigh(counts, idf) @ vecs.T
                    of = np.where(other, -1, cosine).argmax(axis=1) if of is None else of
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(of), pa.array(size_class(counts).astype(np.int64)), pa.array(cosine[np.arange(len(of)), of].astype(float))],
                        names=["centroid", "class", "cosine"])

    floor = np.full((len(vecs), _CLASSES), np.nan)
    if len(vecs):
        # at most CUTS + 1 numbers a sampled text
        low = (picked.mapInArrow(frugal(own_cosines), "centroid long, class long, cosine double").groupBy("centroid", "class")
               .agg(F.percentile("cosine", F.lit(QUANTILE)).alias("q")).collect())
        for r in low:
            floor[r["centroid"], r["class"]] = r["q"]
    # a class without texts has the floor of the next smaller one; no floor below the smallest
    for j in range(_CLASSES):
        floor[:, j] = np.where(np.isnan(floor[:, j]), floor[:, j - 1] if j else 0.0, floor[:, j])
    return Centroids(list(langs), vecs, floor, idf)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       held_out: Column | None = None, sample: int = SAMPLE, centroids: int = CENTROIDS,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of whole texts by the nearest centroid.

    Learns from the rows with a letter in the text and a language whose
    ``held_out`` is false (null counts as false).  Returns (doc_id, held_out, lang_pred,
    score, rejected) and the columns in ``keep``, one row per row of ``docs``;
    score is the cosine, 0 to 1.  lang_pred is ``und`` with score 0 for null
    texts, texts without a letter, and when nothing could be learned; such rows
    are rejected, as are texts far from every centroid.  Ids, null and repeated
    ones too, have no part in the fit, and equal texts of a language count once
    in its sample; repeated rows are rows of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    extra = [F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    docs = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), *extra)
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text", "lang"), sample, centroids)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            for lo, hi in text_slices(batch.column(2), SLICE, ROWS):
                part = batch.slice(lo, hi - lo)
                texts = part.column(2)
                best, cosine = np.full(len(texts), len(langs) - 1), np.zeros(len(texts))
                far = np.ones(len(texts), bool)
                letters = np.array([bool(t.is_valid and _LETTER.search(t.as_py())) for t in texts])
                if len(model.langs) and letters.any():
                    b, c, f = model.predict(term_counts(texts))
                    best[letters], cosine[letters], far[letters] = b[letters], np.clip(c[letters], 0, 1), f[letters]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(langs[best], pa.string()), pa.array(cosine.astype(float)), pa.array(far),
                     *[part.column(4 + i) for i in range(len(keep))]],
                    names=["doc_id", "held_out", "lang_pred", "score", "rejected", *[f"keep{i}" for i in range(len(keep))]])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"doc_id {kinds['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean"
    schema += "".join(f", keep{i} {kinds[f'keep{i}']}" for i in range(len(keep)))
    got = docs.mapInArrow(frugal(run), schema)
    return got.select("doc_id", "held_out", "lang_pred", "score", "rejected", *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])
