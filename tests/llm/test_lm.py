import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casetriage.llm import lm
from casetriage.llm.common import word_hashes
from casetriage.llm.lm import SIDE, SYMBOLS, Params, Trainer, score_documents
from casetriage.llm.queries import op1_lm_score

from edge import SF_SMALL, documents


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]


def base_scores(rows, held):
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return {(i, len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
             round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)), 6)) for i, t in rows}


@pytest.fixture(scope="module")
def scored(spark):
    return op1_lm_score(spark, SF_SMALL).toPandas()


def test_counts_and_base_equal_brute_force(spark, scored):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    got = {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored.itertuples()}
    assert got == base_scores(rows, held.get)
    assert {r.doc_id: r.held_out for r in scored.itertuples()} == held


def test_the_far_words_are_joined(spark, monkeypatch):
    """With few near counts nearly all words go through the join: same results."""
    rows = [(i, f"a b a c{i % 3} d{i} a b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.col("doc_id") % 5 == 1
    want = {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in score_documents(df, held_out=held).collect()}
    assert {w[0] for w in want} == set(range(30))
    got = {(w[0], w[2], w[3], w[4], w[5]) for w in want}
    assert got == base_scores(rows, lambda i: i % 5 == 1)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, SYMBOLS)
    ctx = np.repeat(rng.integers(0, SYMBOLS, (1, lm.CONTEXT)), SYMBOLS, axis=0)
    p = Params.start(counts)
    assert abs(np.exp(p.log_probs(ctx, np.arange(SYMBOLS))).sum() - 1) < 1e-4
    share = (counts + 0.5) / (counts + 0.5).sum()
    drift = np.abs(p.log_probs(ctx, np.arange(SYMBOLS)) - np.log(share))
    assert np.median(drift) < 0.5  # the untrained model is nearly the unigram model
    trainer, ctx = Trainer(p, counts, 1), rng.integers(0, 200, (lm.BATCH, lm.CONTEXT))
    target = (ctx[:, 0] * 7 + 3) % 200  # the word before tells the next one
    before = p.log_probs(ctx, target).mean()
    for _ in range(60):
        trainer.step(ctx, target)
    assert trainer.p.log_probs(ctx, target).mean() > before + 0.5
    assert abs(np.exp(trainer.p.log_probs(np.repeat(ctx[:1], SYMBOLS, axis=0), np.arange(SYMBOLS))).sum() - 1) < 1e-4
    assert SIDE * SIDE >= SYMBOLS


def test_whole_vocabulary_with_an_unknown_word_sums_to_one(spark):
    """Shares inside a tail class with one unseen word each add up to one."""
    v = lm.Vocabulary(np.array([1], np.uint64), np.array([9]), 30, 8, 5, np.array([6] + [0] * (lm.TAILS - 1)), np.array([3] + [0] * (lm.TAILS - 1)))
    counts = [1, 2, 3, 0]
    assert abs(sum((c + 0.5) / (v.tail_counts[0] + 0.5 * (v.tail_distinct[0] + 1)) for c in counts) - 1) < 1e-12


def test_word_hashes_match_words_across_pieces(monkeypatch):
    monkeypatch.setattr("casetriage.llm.common.PIECE_BYTES", 40)
    texts = ["The cat\tthe\n CAT", None, "", "  ", "a" * 300 + " b", "ünï THE ünï", "x" * 95, "end the"]
    h, at, tail = word_hashes(pa.array(texts), tails=True)
    seen = {}
    for t, lo, hi in zip(texts, at[:-1], at[1:]):
        words = tokens(t)[:-1]
        assert hi - lo == len(words)
        for w, x, y in zip(words, h[lo:hi], tail[lo:hi]):
            assert seen.setdefault(w, x) == x
            b = w.encode()
            assert y == b[-1] * 256 + (b[-2] if len(b) > 1 else 0)
    assert len(set(seen.values())) == len(seen)


def test_edge_rows_and_no_training_rows(spark):
    rows = score_documents(documents(spark)).collect()
    assert len(rows) == 13 and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    rows = score_documents(documents(spark), held_out=F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and abs(r.base_score) < 1e-6 and math.isfinite(r.score) for r in rows)
    assert score_documents(documents(spark, [])).collect() == []
