"""Feature engineering.

Everything fitted here is a small, bounded statistic computed with one
DataFrame aggregation (modes, category lists, quantile edges, a vocabulary of
at most ``max_features`` terms); the per-row work is a Spark ML
``PipelineModel`` of built-in transformers, so scoring is a narrow map with
no shuffle and the fitted model is persisted with the ML writer (A7).

Block order follows the reference: text, categoricals, tenure bins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (Bucketizer, CountVectorizerModel, ElementwiseProduct,
                                Normalizer, OneHotEncoder, SQLTransformer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import const_array
from ..session import scratch_path
from .cleaning import CATEGORICAL_COLUMNS

# Token rule = two or more letters, digits or underscores
# (the reference's default word pattern), unigrams + bigrams.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

TEXT_COL = "case_summary"
TENURE_COL = "customer_tenure_months"


# ---------------------------------------------------------------- text ----

def tokens(col=TEXT_COL) -> Column:
    """Lower-cased tokens of the whole text (no truncation)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def with_ngrams(tok: Column, max_n: int = 2) -> Column:
    """Unigrams followed by bigrams ("a b") of a token array."""
    if max_n < 2:
        return tok
    pairs = F.zip_with(tok, F.slice(tok, 2, F.greatest(F.size(tok) - 1, F.lit(0))),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tok, F.filter(pairs, lambda x: x.isNotNull()))


GRAMS_SQL = (
    "SELECT *, concat(_tok, filter(zip_with(_tok, slice(_tok, 2, greatest(size(_tok) - 1, 0)), "
    "(a, b) -> concat(a, ' ', b)), x -> x IS NOT NULL)) AS _grams FROM ("
    "SELECT *, regexp_extract_all(lower(coalesce({col}, '')), '{pat}', 0) AS _tok FROM __THIS__)"
)


def term_stats(df: DataFrame, key: str = "case_id", text_col: str = TEXT_COL,
               max_n: int = 2) -> DataFrame:
    """(term, tf, df) over the corpus in one aggregation keyed by term only:
    every occurrence adds to tf, every distinct term of a document adds to
    df.  Both inputs combine map-side (a partition sends one row per
    distinct term), so neither frequent terms nor long documents
    concentrate in one task, and no (document, term) pairs are shuffled.
    ``key`` is kept for API compatibility (documents need no id).

    The text is tokenised once per document: the token array is its own
    projection (referenced three times by the n-gram expression, so the
    optimizer keeps it instead of inlining the regex), and one generator
    pair emits both the occurrence list (_k = 0) and the distinct list
    (_k = 1) instead of a union that would re-run the scan and tokeniser
    for each branch."""
    t = df.select(tokens(text_col).alias("_t"))
    return _gram_stats(t.select(with_ngrams(F.col("_t"), max_n).alias("_g")))


def _gram_stats(g: DataFrame) -> DataFrame:
    from .reshape import explode_array
    both = explode_array(g, [], F.array(F.col("_g"), F.array_distinct("_g")), "_a", "_k")
    return explode_array(both, ["_k"], "_a", "term").groupBy("term").agg(
        F.sum(1 - F.col("_k")).cast("long").alias("tf"), F.sum("_k").cast("long").alias("df"))


def select_vocabulary(stats: DataFrame, min_df: int = 2,
                      max_features: int | None = 500) -> DataFrame:
    """E1 vocabulary: terms with df >= min_df, the max_features most frequent
    (ties: alphabetical); result in alphabetical order."""
    v = stats.filter(F.col("df") >= min_df)
    if max_features:
        v = v.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    return v


#: Words that are sent to the tasks at most, to find the pairs that can be among the most frequent terms.
MAX_FREQUENT = 20_000


def frequent_terms(df: DataFrame, min_df: int = 2, max_features: int | None = 500, key: str = "case_id",
                   text_col: str = TEXT_COL, max_n: int = 2) -> DataFrame:
    """``select_vocabulary(term_stats(df))``, without counting the pairs that can't be in it.

    Nearly all different terms of a corpus are rare pairs.  A pair is no more
    frequent than its words, so with ``max_features`` words of a count of T
    or more, only pairs of such words can be selected: words are counted first,
    then the pairs of those.  If these words are too few or too many (equal
    counts) to tell anything, all pairs are counted."""
    if not max_features or max_n < 2:
        return select_vocabulary(term_stats(df, key, text_col, max_n), min_df, max_features)
    words = term_stats(df, key, text_col, 1).filter(F.col("df") >= min_df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        least = words.orderBy(F.desc("tf"), F.asc("term")).limit(max_features).agg(F.count("*").alias("n"), F.min("tf").alias("tf")).first()
        frequent = []
        if least["n"] == max_features:
            frequent = words.filter(F.col("tf") >= least["tf"]).limit(MAX_FREQUENT + 1).collect()  # MAX_FREQUENT + 1 rows at most
    finally:
        words.unpersist()
    if not 0 < len(frequent) <= MAX_FREQUENT:
        return select_vocabulary(term_stats(df, key, text_col, max_n), min_df, max_features)
    known = [r["term"] for r in frequent]
    # the other words become null, and so do their pairs
    kept = df.select(tokens(text_col).alias("_t")).select(F.transform("_t", lambda w: F.when(w.isin(known), w)).alias("_t"))
    pairs = F.zip_with("_t", F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    stats = _gram_stats(kept.select(F.filter(pairs, lambda x: x.isNotNull()).alias("_g")))
    counted = df.sparkSession.createDataFrame([tuple(r) for r in frequent], words.schema)
    return select_vocabulary(counted.unionByName(stats), min_df, max_features)


@dataclass
class TextModel:
    vocabulary: list[str]
    idf: list[float]
    n_docs: int


def fit_text(df: DataFrame, key: str = "case_id", text_col: str = TEXT_COL,
             min_df: int = 2, max_features: int | None = 500, max_n: int = 2) -> TextModel:
    """Fit vocabulary and smoothed idf (ln((1+n)/(1+df)) + 1)."""
    n_docs = df.count()
    vocab = frequent_terms(df, min_df, max_features, key, text_col, max_n)
    rows = sorted(vocab.select("term", "df").collect())  # <= max_features rows
    terms = [r[0] for r in rows]
    idf = [math.log((1 + n_docs) / (1 + r[1])) + 1.0 for r in rows]
    return TextModel(terms, idf, n_docs)


# --------------------------------------------------------- categoricals ----

@dataclass
class TabularModel:
    modes: dict
    categories: dict          # col -> sorted list of seen values (after imputation)
    tenure_edges: list[float]  # inner bin edges


def fit_modes_and_categories(df: DataFrame, cols: list[str],
                             max_categories: int | None = None,
                             impute: bool = True) -> tuple[dict, dict]:
    """E2 + E4 fit: most frequent value (ties -> smallest) and the sorted
    category set of every column, from one count of (column, value) with
    map-side combine.  The result is as large as the model it names; a limit
    on it is the caller's (``max_categories``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    counts = df.select(pairs.alias("e")).groupBy("e.col", "e.value").agg(F.count("*").alias("n"))
    found: dict = {c: {} for c in cols}
    for r in counts.collect():
        found[r["col"]][r["value"]] = r["n"]
    modes, cats = {}, {}
    for c in cols:
        seen = {v: n for v, n in found[c].items() if v is not None}
        if max_categories is not None and len(seen) > max_categories:
            raise ValueError(f"{c} has {len(seen)} categories, more than {max_categories}")
        modes[c] = min(seen, key=lambda v: (-seen[v], v)) if seen else None
        cats[c] = sorted(seen)   # imputed nulls become the mode, which is among them
    return modes, cats


def impute_mode(df: DataFrame, cols: list[str], modes: dict | None = None) -> DataFrame:
    """Fill nulls with the most frequent value."""
    if modes is None:
        modes, _ = fit_modes_and_categories(df, cols)
    return df.fillna({c: v for c, v in modes.items() if v is not None})


def exact_quantiles(df: DataFrame, col: str, ps: list[float]) -> list[float] | None:
    """Exact percentiles with linear interpolation, for any number of
    distinct values: counts by value (map-side combine), range-partitioned
    and written once; the counts of the partitions tell in which of them the
    wanted ranks lie, and only those are ranked.  ``None`` without values."""
    spark = df.sparkSession
    counts = (df.select(F.col(col).cast("double").alias("v")).where("v is not null")
              .groupBy("v").agg(F.count("*").alias("n")))
    parts = (counts.repartitionByRange("v")
             .select("v", "n", F.spark_partition_id().alias("part")))
    path = scratch_path(spark, "value-counts")
    parts.write.parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    sizes = sorted((r["lo"], r["part"], r["n"]) for r in
                   parts.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("lo")).collect())
    total = sum(n for _, _, n in sizes)
    if not total:
        return None
    start, starts = 0, {}
    for _, part, n in sizes:
        starts[part] = (start, start + n)
        start += n
    at = [p * (total - 1) for p in ps]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    values: dict = {}
    for part, (lo, hi) in starts.items():
        wanted = [r for r in ranks if lo <= r < hi]
        if not wanted:
            continue
        run = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + lo
        ranked = parts.where(F.col("part") == part).withColumn("last", run)
        hit = F.filter(F.array(*[F.lit(r) for r in wanted]),
                       lambda r: (r >= F.col("last") - F.col("n")) & (r < F.col("last")))
        for r in ranked.select("v", hit.alias("r")).where(F.size("r") > 0).collect():
            values.update(dict.fromkeys(r["r"], r["v"]))
    return [values[math.floor(x)] if x == math.floor(x) else
            (math.ceil(x) - x) * values[math.floor(x)] + (x - math.floor(x)) * values[math.ceil(x)] for x in at]


def impute_median(df: DataFrame, cols: list[str], relative_error: float | None = None) -> DataFrame:
    """Fill nulls with the median: exact, or by a sketch when the caller
    names a ``relative_error``."""
    if relative_error:
        med = df.agg(*[F.percentile_approx(c, 0.5, int(1 / relative_error)).alias(c) for c in cols]).first().asDict()
    else:
        med = {c: (exact_quantiles(df, c, [0.5]) or [None])[0] for c in cols}
    return df.fillna({c: float(v) for c, v in med.items() if v is not None})


# ------------------------------------------------------------ tenure bins ----

def quantile_edges(df: DataFrame, col: str = TENURE_COL, n_bins: int = 5,
                   relative_error: float | None = None) -> list[float]:
    """E5 fit: quantile edges with near-duplicates removed; returns the
    inner edges (a value's bin = number of inner edges <= value).  Exact
    percentiles (linear interpolation), or by a sketch when the caller names
    a ``relative_error``."""
    ps = [i / n_bins for i in range(n_bins + 1)]
    if relative_error:
        q = df.agg(F.percentile_approx(col, F.array(*[F.lit(p) for p in ps]), int(1 / relative_error)).alias("q")).first()["q"]
    else:
        q = exact_quantiles(df, col, ps)
    if not q:
        return []
    edges = [float(x) for x in q]
    kept = [edges[0]] + [e for prev, e in zip(edges, edges[1:]) if e - prev > 1e-8]
    return kept[1:-1]


def bin_index(col: str, inner_edges: list[float]) -> Column:
    """E5 transform: count of inner edges <= x (null stays null)."""
    x = F.col(col).cast("double")
    idx = F.lit(0)
    for e in inner_edges:
        idx = idx + F.when(x >= F.lit(e), 1).otherwise(0)
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(idx)


# ------------------------------------------------------------- assembly ----

@dataclass
class FeatureSpace:
    """Fitted feature pipeline + names of every output slot."""
    pipeline: PipelineModel
    names: list[dict] = field(default_factory=list)   # idx, block, source_col, name
    text: TextModel | None = None
    tabular: TabularModel | None = None
    block_cols: dict = field(default_factory=dict)    # source column -> its block's vector column

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(df)

    def blocks(self, df: DataFrame) -> DataFrame:
        """Every block as a vector column of its own, not assembled yet."""
        return PipelineModel(self.pipeline.stages[:-1]).transform(df)

    def assemble(self, df: DataFrame) -> DataFrame:
        """The feature vector from the block columns."""
        return self.pipeline.stages[-1].transform(df)

    def names_df(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(n["idx"], n["block"], n["source_col"], n["name"]) for n in self.names],
            "idx int, block string, source_col string, name string")

    def slots(self, block: str | None = None, source_col: str | None = None) -> list[int]:
        return [n["idx"] for n in self.names
                if (block is None or n["block"] == block)
                and (source_col is None or n["source_col"] == source_col)]


def _fmt_bin(i: int) -> str:
    return f"{float(i)}"


CALENDAR_SQL = ("SELECT *, CAST(hour({ts}) AS STRING) AS hour, "
                "date_format({ts}, 'EEEE') AS day_of_week FROM __THIS__")


def fit_features(train: DataFrame, key: str = "case_id", text_col: str | None = TEXT_COL,
                 cat_cols: list[str] = CATEGORICAL_COLUMNS, tenure_col: str | None = TENURE_COL,
                 min_df: int = 2, max_features: int | None = 500, n_bins: int = 5,
                 output_col: str = "features", calendar: bool = False, impute: bool = True,
                 ts_col: str = "created_at", variant: str | None = None) -> FeatureSpace:
    """Fit the column-block transformer on the training rows only.

    ``text_col=None`` drops the text block (E10 ablation).  ``variant="B"``
    is the reference's second preprocessor: 5000 terms without a minimum
    document frequency, hour and day-name one-hot columns (B17) and no
    categorical imputation (a missing value encodes as all zeros)."""
    if variant == "B":
        max_features, min_df, calendar, impute = 5000, 1, True, False
    stages, blocks, names = [], [], []
    fit_rows = train
    if calendar:
        cal = SQLTransformer(statement=CALENDAR_SQL.format(ts=ts_col))
        stages.append(cal)
        fit_rows = cal.transform(train)
        cat_cols = list(cat_cols) + ["day_of_week", "hour"]
    text = None
    if text_col:
        text = fit_text(train, key, text_col, min_df, max_features)
        stages += [
            SQLTransformer(statement=GRAMS_SQL.format(col=text_col, pat=TOKEN_PATTERN.replace("\\", "\\\\"))),
            CountVectorizerModel.from_vocabulary(text.vocabulary, inputCol="_grams", outputCol="_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(text.idf), inputCol="_tf", outputCol="_tfidf_raw"),
            Normalizer(p=2.0, inputCol="_tfidf_raw", outputCol="_tfidf"),
        ]
        blocks.append("_tfidf")
        names += [{"block": "text", "source_col": text_col, "name": t} for t in text.vocabulary]

    modes, cats = fit_modes_and_categories(fit_rows, cat_cols, impute=impute) if cat_cols else ({}, {})
    if not impute:
        modes = {c: None for c in cat_cols}
    if cat_cols:
        fill = ", ".join(
            f"coalesce({c}, {_sql_lit(modes[c])}) AS _imp_{c}" for c in cat_cols)
        stages.append(SQLTransformer(statement=f"SELECT *, {fill} FROM __THIS__"))
        # one indexer for all columns: a single pass over the training rows
        stages.append(StringIndexer(inputCols=[f"_imp_{c}" for c in cat_cols],
                                    outputCols=[f"_ix_{c}" for c in cat_cols],
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        for c in cat_cols:
            names += [{"block": "cat", "source_col": c, "name": f"{c}_{v}"} for v in cats[c]]
        stages.append(OneHotEncoder(inputCols=[f"_ix_{c}" for c in cat_cols],
                                    outputCols=[f"_oh_{c}" for c in cat_cols], dropLast=True))
        blocks += [f"_oh_{c}" for c in cat_cols]

    edges: list[float] = []
    if tenure_col:
        edges = quantile_edges(fit_rows, tenure_col, n_bins)
        splits = [-math.inf] + edges + [math.inf]
        stages += [
            SQLTransformer(statement=f"SELECT *, coalesce(CAST({tenure_col} AS DOUBLE), "
                                     f"double('NaN')) AS _ten FROM __THIS__"),
            Bucketizer(splits=splits, inputCol="_ten", outputCol="_bin", handleInvalid="keep"),
            OneHotEncoder(inputCols=["_bin"], outputCols=["_oh_bin"], dropLast=True,
                          handleInvalid="keep"),
        ]
        blocks.append("_oh_bin")
        names += [{"block": "tenure", "source_col": tenure_col, "name": f"{tenure_col}_{_fmt_bin(i)}"}
                  for i in range(len(edges) + 1)]

    stages.append(VectorAssembler(inputCols=blocks, outputCol=output_col, handleInvalid="keep"))
    model = Pipeline(stages=stages).fit(train)
    for i, n in enumerate(names):
        n["idx"] = i
    sources = ([text_col] if text_col else []) + list(cat_cols) + ([tenure_col] if tenure_col else [])
    return FeatureSpace(model, names, text, TabularModel(modes, cats, edges), dict(zip(sources, blocks)))


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def feature_long(df: DataFrame, space: FeatureSpace, key: str = "case_id",
                 features: str = "features", nonzero_only: bool = True) -> DataFrame:
    """E9 applied: (key, idx, block, source_col, name, x) rows of the vector."""
    from pyspark.ml.functions import vector_to_array
    names = const_array([n["name"] for n in space.names])
    blocks = const_array([n["block"] for n in space.names])
    srcs = const_array([n["source_col"] for n in space.names])
    from .reshape import explode_array
    if nonzero_only:
        # drop zeros inside the array, so the generator emits only the
        # stored entries (a tf-idf row has a few dozen of max_features slots)
        arr = df.select(key, vector_to_array(F.col(features)).alias("_a"))
        slots = F.zip_with(F.sequence(F.lit(0), F.greatest(F.size("_a") - 1, F.lit(0))), F.col("_a"),
                           lambda i, v: F.struct(i.alias("idx"), v.alias("x")))
        out = (explode_array(arr, [key], F.filter(slots, lambda e: e["x"] != 0), "_e")
               .select(key, F.col("_e.x").alias("x"), F.col("_e.idx").alias("idx")))
    else:
        out = explode_array(df, [key], vector_to_array(F.col(features)), "x", "idx")
    return (out.withColumn("name", names[F.col("idx")])
            .withColumn("block", blocks[F.col("idx")])
            .withColumn("source_col", srcs[F.col("idx")]))
