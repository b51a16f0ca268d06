"""Scale properties that must hold in the plans, not only in the results."""

import pytest
from pyspark.sql import functions as F

from casetriage.operators import cleaning as C
from casetriage.operators import features as FE
from casetriage.operators import splits as SP
from casetriage.operators.joins import join_small

SF_MID_DIR = "/root/testdata/sf0.01"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_last_is_a_combining_aggregate_not_a_window(spark):
    # one hot key holds a third of the rows
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("case_id"),
        (F.col("id") % 12).alias("file_seq"), F.col("id").alias("row_seq"), (F.col("id") * 7).alias("v"))
    out = C.dedup_latest(df)
    plan = _plan(out)
    assert "Window" not in plan
    assert plan.count("Aggregate") >= 2          # partial (map side) + final
    hot = out.filter("case_id = 'HOT'").first()
    # HOT rows are the multiples of 3: latest is file 9, row 2997
    assert (hot.file_seq, hot.row_seq) == (9, 2997)


def test_rank_within_skewed_class_is_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("case_id"),
                                  F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1).alias("label"))
    ranked = SP.rank_within_class(df, "label", "case_id")
    assert "Window" in _plan(ranked)  # only inside (label, bucket)
    per = ranked.groupBy("label").agg(F.min("class_rank").alias("lo"), F.max("class_rank").alias("hi"),
                                      F.count("*").alias("n"), F.countDistinct("class_rank").alias("d")).collect()
    for r in per:
        assert r.lo == 1 and r.hi == r.n == r.d


def test_join_small_broadcasts_only_with_a_bound(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "BroadcastHashJoin" in _plan(join_small(big, small, "k", small_rows=10))
        assert "BroadcastHashJoin" not in _plan(join_small(big, small, "k", small_rows=None))
        assert "BroadcastHashJoin" not in _plan(join_small(big, small, "k", small_rows=10, max_rows=5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_category_fit_refuses_unbounded_columns(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        FE.fit_modes_and_categories(df, ["c"], max_categories=100)
    modes, cats = FE.fit_modes_and_categories(df.limit(50), ["c"], max_categories=100)
    assert len(cats["c"]) == 50


def test_term_stats_shuffle_is_keyed_by_term_only(spark):
    df = spark.createDataFrame([(1, "aa bb aa cc"), (2, "aa cc cc dd")], "case_id long, case_summary string")
    st = FE.term_stats(df)
    plan = _plan(st)
    assert "partial_sum" in plan
    got = {r.term: (r.tf, r.df) for r in st.collect()}
    assert got["aa"] == (3, 2) and got["cc"] == (3, 2) and got["bb"] == (1, 1)
    assert got["cc cc"] == (1, 1) and got["aa bb"] == (1, 1)


def test_spread_only_reshuffles_an_under_split_scan(spark):
    from casetriage.sources.fixtures import table
    from casetriage.sources.readers import spread
    docs = table(spark, SF_MID_DIR, "documents")
    cores = spark.sparkContext.defaultParallelism
    out = spread(spark, docs, "doc_id")
    if docs.rdd.getNumPartitions() < cores:
        assert "Exchange hashpartitioning(doc_id" in _plan(out)
    # every row kept, nothing duplicated
    assert out.count() == docs.count() == out.select("doc_id").distinct().count()
    many = spark.range(0, 1000, 1, numPartitions=cores * 2)
    assert spread(spark, many, "id") is many     # enough splits: unchanged plan, no shuffle


def test_const_array_equals_lit(spark):
    import math
    from casetriage.functions.scalar import const_array
    vals = [0.1, -0.0, 1e-300, 5e-324, 6.427706291585914e-05, -12345.678, float("nan"), float("inf")]
    W = [vals[:4], vals[4:]]
    strs = ["it's", "back\\slash", "x y", "ünï", "", None]
    r = spark.range(1).select(const_array(vals).alias("a"), F.lit(vals).alias("b"),
                              const_array(W).alias("c"), F.lit(W).alias("d"),
                              const_array(strs).alias("e"), F.lit(strs).alias("f"),
                              const_array([True, False]).alias("g"), const_array([1, 3000000000]).alias("i")).first()
    same = lambda x, y: (math.isnan(x) and math.isnan(y)) or (x == y and math.copysign(1, x) == math.copysign(1, y))
    assert all(same(x, y) for x, y in zip(r.a, r.b)) and len(r.a) == len(r.b)
    assert all(same(x, y) for u, v in zip(r.c, r.d) for x, y in zip(u, v))
    assert r.e == r.f and r.g == [True, False] and r.i == [1, 3000000000]


def test_trees_are_trained_by_all_cores(spark):
    """Rows of a tree trainer reach every core, if each gets a thousand; an LR's stay together, as its jobs are short."""
    from casetriage.operators import models as M
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(0, cores * 1000, 1, 2 * cores)
    assert M.persist_training(df, cores * 1000).rdd.getNumPartitions() == 1
    assert M.persist_training(df, cores * 1000, trees=True).rdd.getNumPartitions() == cores
    assert M.persist_training(df.coalesce(1), cores * 1000, trees=True).rdd.getNumPartitions() == cores
    assert M.persist_training(df, 900, trees=True).rdd.getNumPartitions() == 1


def test_classifiers_share_one_feature_fit(spark):
    from casetriage.plans.flagship import fit_triage
    a, b = (fit_triage(spark, "/root/testdata/sf0.001", kind) for kind in ("lr", "dt"))
    assert a.space is b.space and a.data is b.data


@pytest.mark.parametrize("n", [1, 3, 8, 20, 200])
def test_frequent_terms_are_those_of_all_counts(spark, n, monkeypatch):
    """Equal counts, words of one text, repeated pairs, null and empty texts; and pairs of rare words are never counted."""
    texts = ["aa bb aa bb cc", "aa bb dd ee", "cc cc cc", "xx xx xx xx xx xx", "dd ee dd ee ff gg", "hh ii", "hh ii jj kk", None, "", "Aa_1 ll"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "case_id int, case_summary string").repartition(3)
    for least in (1, 2):
        want = FE.select_vocabulary(FE.term_stats(df), least, n).collect()
        assert FE.frequent_terms(df, least, n).collect() == want
        with monkeypatch.context() as m:
            m.setattr(FE, "MAX_FREQUENT", 1)
            assert FE.frequent_terms(df, least, n).collect() == want
    counted = []
    inner = FE._gram_stats
    monkeypatch.setattr(FE, "_gram_stats", lambda g: counted.append(inner(g)) or counted[-1])
    FE.frequent_terms(df, 2, 3).collect()
    assert "hh ii" not in {r.term for part in counted for r in part.collect()}


def test_forest_is_grown_by_several_fits_at_a_time(spark, monkeypatch):
    """Fits with few rows share the cores; their trees make one forest, which a saved copy equals."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from casetriage.operators import models as M
    cores = spark.sparkContext.defaultParallelism
    assert M.tree_fits(spark.range(1), 16_478) == (1, cores)
    assert M.tree_fits(spark.range(1), M.ROWS_PER_TRAINING_PARTITION * cores) == (cores, 1)
    monkeypatch.setattr(M, "ROWS_PER_TREE_PARTITION", 100)
    rows = spark.range(300).select(
        array_to_vector(F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"),
        (F.col("id") % 7 > 3).cast("int").alias("priority_encoded"), F.lit(1.0).alias("weight"))
    whole = []
    monkeypatch.setattr(M, "_fit_forests", lambda *a, f=M._fit_forests: whole.append(a[2:]) or f(*a))
    m = M.train_rf(rows, num_trees=11, max_depth=3)
    assert whole == [(min(3, cores), 1)]
    assert m.getNumTrees == len(m.trees) == 11 and m.numFeatures == 2 and m.numClasses == 2 and m.getMaxDepth() == 3
    assert m.totalNumNodes == sum(t.numNodes for t in m.trees)
    assert abs(sum(m.featureImportances.toArray()) - 1) < 1e-9
    assert m.transform(rows).where("prediction = priority_encoded").count() == 300
    assert len({t.toDebugString for t in m.trees}) > 1


def test_case_texts_are_shuffled_once(spark):
    """Orders meet their customers before the texts come in, whatever the tables' sizes; the rows are those of the SQL text."""
    from casetriage.sources import fixtures as X
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "-1")
        cases = X.view(spark, SF_MID_DIR, "cases")
        exchanges = [x for x in _plan(cases).splitlines() if "Exchange" in x and "hashpartitioning" in x]
        by_customer = [x for x in exchanges if "custkey" in x]
        assert len(by_customer) == 2 and sum("doc_id" in x for x in exchanges) == 2, exchanges  # texts and labels by doc_id
        want = spark.sql(X.CASES)
        assert cases.schema == want.schema
        assert cases.exceptAll(want).count() == 0 and want.exceptAll(cases).count() == 0
        text = _plan(cases)
        assert text.index("o_orderkey") < text.index("custkey")  # the customer's join is inside the order's side
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_joins_of_cases_keep_repeated_and_missing_keys(spark):
    from casetriage.sources import fixtures as X
    spark.createDataFrame([(1, " A ", "s"), (1, "b", "s"), (2, "c", "t"), (None, "d", "t"), (9, None, "u")],
                          "doc_id long, text string, source string").createOrReplaceTempView("documents")
    spark.createDataFrame([(1, 7, "O"), (1, 8, "F"), (2, None, "P"), (None, 7, "O")],
                          "o_orderkey long, o_custkey long, o_orderstatus string").selectExpr(
        "*", "DATE'1995-01-01' AS o_orderdate").createOrReplaceTempView("orders")
    spark.createDataFrame([(7, "BUILDING", 120.0), (7, "HOUSEHOLD", -5.0), (None, "MACHINERY", 1.0)],
                          "c_custkey long, c_mktsegment string, c_acctbal double").createOrReplaceTempView("customer")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, toxic int, quality int").createOrReplaceTempView("labels")
    rows = [sorted(map(str, spark.sql(q).collect())) for q in (X.CASES, X.spark_sql("cases"))]
    assert rows[0] == rows[1] and len(rows[0]) == 15  # two texts x (two customers of one order + one) x two labels, and three


def test_a_sample_never_sorts_all_rows(spark):
    """Columns computed of the sample, each used more than once, don't make the sample a sort of the whole table."""
    from casetriage.operators import ranking as R
    df = spark.range(2000).select(F.col("id").alias("case_id"), F.concat(F.lit("a b "), "id").alias("t"))
    s = R.sample_n(df, 16).withColumn("w", F.regexp_extract_all("t", F.lit("[a-z0-9]+"), 0))
    s = s.withColumn("g", F.concat("w", F.slice("w", 1, 1), F.slice("w", 2, 1))).select("case_id", F.size("g").alias("n"))
    assert "TakeOrderedAndProject" in _plan(s) and "rangepartitioning" not in _plan(s)
    want = [r.case_id for r in df.orderBy(R.hash_order("case_id", 42), "case_id").limit(16).collect()]
    assert sorted(r.case_id for r in s.collect()) == sorted(want)
