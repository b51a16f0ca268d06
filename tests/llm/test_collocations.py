import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import casetriage.llm.collocations as m
from casetriage.llm.collocations import exact_score, mine_phrases, phrases_of, transform

from edge import LONG, ROWS, documents


def brute(rows, least, top):
    """(lang, text) rows to sorted result rows."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda x: x.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = set()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            inside |= {(lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * a >= 100 * f[lang, w[i:i + k]]}
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "Ee", "f-f", "ü", "漢"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "?! ", "\x0b"]
    return [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("shard,least,top", [(10, 3, 2000), (300, 3, 7), (1 << 20, 8, 2000), (60, 1, 50)])
def test_equals_brute_force(spark, monkeypatch, shard, least, top):
    """Any size of shards gives the same counts; each shard has words of several languages."""
    monkeypatch.setattr(m, "SHARD_WORDS", shard)
    rows = texts(shard, 150)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert got(mine_phrases(docs, least=least, top=top)) == brute(rows, least, top)


def test_a_full_filter_only_lets_more_through(spark, monkeypatch):
    monkeypatch.setattr(m, "MOST_BITS", 6)
    rows = texts(5, 120)
    assert got(mine_phrases(spark.createDataFrame(rows, "lang string, text string"), least=4)) == brute(rows, 4, 2000)


def test_intervals_of_one_shard_are_all_its_phrases():
    rng = np.random.default_rng(1)
    x = np.r_[rng.integers(0, 6, 3000), 0]
    everything = [lambda h: np.ones(len(h), bool)] * 4
    seen = {}
    for h, a, w in phrases_of(transform(x).astype(np.int32), np.arange(1, 7, dtype=np.uint64), everything):
        assert len(set(h.tolist())) == len(h)
        seen |= {tuple(r): c for r, c in zip(w.tolist(), a.tolist())}
    want = Counter(tuple(x[i:i + k].tolist()) for k in range(1, 6) for i in range(len(x) - k + 1) if 0 not in x[i:i + k])
    assert seen == dict(want)


def test_long_texts_are_cut_at_breaks(spark, monkeypatch):
    """Pieces of a very long text give the counts of the whole, with and without breaks in it."""
    monkeypatch.setattr(m, "PIECE_BYTES", 40)
    monkeypatch.setattr(m, "SHARD_WORDS", 50)
    rows = [("en", LONG[:5000]), ("en", "no break at all in here " * 40), ("de", "x y. " * 200)]
    assert got(mine_phrases(spark.createDataFrame(rows, "lang string, text string"), least=5)) == brute(rows, 5, 2000)


def test_score_is_exact(spark):
    rng = random.Random(2)
    rows = [(10**13, 10**14, 10**13, 10**13), (3, 7, 2, 5), (10**12 + 7, 99_999_999_999_999, 10**12 + 7, 3 * 10**12)]
    rows += [(a := rng.randrange(1, 10**13), rng.randrange(a, 10**14), a + rng.randrange(10**5), a + rng.randrange(10**13)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    for r in df.withColumn("s", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect():
        assert r.s == 1000 * r.a * r.n // (r.l * r.r)


def test_edge_rows(spark):
    assert got(mine_phrases(documents(spark), least=2)) == brute([(r[2], r[1]) for r in ROWS], 2, 2000)


def test_empty_table_and_no_candidates(spark):
    assert mine_phrases(documents(spark, [])).collect() == []
    assert mine_phrases(spark.createDataFrame([("en", "one two three")], "lang string, text string")).collect() == []


def test_tasks_get_small_batches(spark):
    """Ten thousand whole texts or shards in one batch take too much of an executor's memory."""
    from casetriage.llm.common import BATCH_BYTES
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 * BATCH_BYTES))
    try:
        docs = spark.createDataFrame([("en", "a b c")], "lang string, text string")
        assert mine_phrases(docs, least=1).count() == 1
        assert int(spark.conf.get(name).lower().removesuffix("b")) <= BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_shards_take_little_disk(spark):
    """Four bytes a word of its list for hashes, and less than that for every place of the text, whatever codec the table has."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    rows = [("en", " ".join(words[min(int(rng.expovariate(0.004)), 2999)] for _ in range(4000))) for _ in range(10)]
    shards = m.shard_table(spark.createDataFrame(rows, "lang string, text string").coalesce(1))
    got = shards.agg(F.sum(F.octet_length("bwt")).alias("bwt"), F.sum(F.octet_length("hashes")).alias("hashes")).first()
    known = len({w for _, t in rows for w in t.split()})
    assert got.hashes <= 4.1 * known + 64 and got.bwt < 2 * 40_000


def test_words_of_equal_hashes_are_told_apart(spark, monkeypatch):
    """With one hash for all words everything passes the filters, and the counts are still those of the words."""
    rows = texts(3, 120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    real = m._arrays
    monkeypatch.setattr(m, "_arrays", lambda b: ((x, h & np.uint64(0xFF)) for x, h in real(b)))
    assert got(mine_phrases(docs, least=4)) == brute(rows, 4, 2000)
