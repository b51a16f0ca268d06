import base64
import math
import zlib

from casetriage.llm.langid import FEATURES, fit, identify_languages, sampled_texts, term_counts
from casetriage.llm.queries import op8_language_id
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa
import pytest
from edge import SF_MID, SF_SMALL, documents


def test_held_out_accuracy(spark):
    rows = op8_language_id(spark, SF_MID).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_pieces_of_a_long_text_add_up(monkeypatch):
    texts = ["abc defg hij" * 50, "", "x", "añb" * 30, None, "q r s t"]
    whole = term_counts(pa.array(texts))
    monkeypatch.setattr("casetriage.llm.langid.SLICE", 17)
    assert np.array_equal(whole, term_counts(pa.array(texts)))
    assert whole[1].sum() == whole[4].sum() == 0 and whole[2].sum() == 1
    assert np.array_equal(whole[3], term_counts(pa.array([texts[3]]))[0])


def test_edge_rows(spark):
    rows = identify_languages(documents(spark), keep=("text", "n")).collect()
    assert len(rows) == 13
    for r in rows:
        if r.doc_id in (3, 4, 5, 6):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in rows if r.doc_id == 9} == {"es"}
    assert rows[0].__fields__[-2:] == ["text", "n"]


def test_nothing_to_learn_and_empty_table(spark):
    rows = identify_languages(documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in rows} == {"und"}
    assert identify_languages(documents(spark, [])).collect() == []


def test_a_foreign_script_is_rejected(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame([(-1, "日本語の文章はここにあります。" * 20, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in identify_languages(docs.union(more)).collect()}
    assert got[-1] and sum(got.values()) < 5


def strangers():
    rng = np.random.default_rng(7)
    hexed = rng.bytes(400).hex()
    return ["日本語の文章はここにあります。" * 20, "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5, "Быстрая лиса прыгает через ленивую собаку.",
            "Η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί. " * 5, "الثعلب البني السريع يقفز فوق الكلب الكسول. " * 5,
            "השועל החום המהיר קופץ מעל הכלב העצלן. " * 5, " ".join(hexed[i:i + 2] for i in range(0, 800, 2)), hexed,
            base64.b64encode(rng.bytes(600)).decode()]


def own_short_texts(docs):
    """The first words of some texts: short ones of a known language stay."""
    return [" ".join(r.text.split()[:6]) for r in docs.where("n_chars > 300").orderBy("doc_id").limit(40).collect()]


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_MID])
def test_foreign_scripts_and_junk_are_rejected_at_any_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    foreign, short = strangers(), own_short_texts(docs)
    rows = [(-1 - i, t, None) for i, t in enumerate(foreign)] + [(-101 - i, t, None) for i, t in enumerate(short)]
    rows += [(-1001, "", "en"), (-1002, "123 !!", "de")]  # labelled, without a letter
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in identify_languages(docs.select("doc_id", "text", "lang").union(more)).collect()}
    assert [t[:20] for i, t in enumerate(foreign) if not got[-1 - i]] == []
    assert sum(got[-101 - i] for i in range(len(short))) <= 2
    assert got[-1001] and got[-1002]
    assert sum(v for k, v in got.items() if k >= 0) < 0.01 * docs.count()


def test_the_sample_is_bounded_for_any_ids(spark):
    rows = [(None, f"wort{i} und mehr", "de") for i in range(600)] + [(1, f"word{i} and more", "en") for i in range(300)]
    rows += [(None, "always the same", "en")] * 500 + [(7, f"mot{i}", "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = sampled_texts(docs, 50).collect()
    assert len(set(got)) == len(got)
    assert {k: sum(r.lang == k for r in got) for k in ("de", "en", "fr")} == {"de": 50, "en": 50, "fr": 40}
    assert sorted(got) == sorted(sampled_texts(docs.repartition(2).withColumn("doc_id", F.lit(3)), 50).collect())
    assert len(sampled_texts(docs, 1).collect()) == 3 and sampled_texts(docs.limit(0), 5).collect() == []


def plain_counts(text):
    """Hashed byte 1- to 3-grams by a plain loop."""
    raw = bytes(48 if chr(b).isdigit() and b < 128 else b + 32 if 65 <= b <= 90 else b for b in text.encode())
    out = {}
    for size in (1, 2, 3):
        for i in range(len(raw) - size + 1):
            code = size
            for b in raw[i:i + size]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
            code = (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - FEATURES.bit_length() + 1)
            out[code] = out.get(code, 0) + 1
    return out


def test_prediction_is_the_plain_nearest_centroid(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("octet_length(text) < 4000")
    model = fit(docs.select("text", "lang"))
    got = {r.doc_id: r for r in identify_languages(docs).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        if got[r.doc_id].lang_pred == "und":
            continue
        v = {i: math.log1p(n) * float(model.idf[i]) for i, n in plain_counts(r.text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * float(c[i]) for i, x in v.items()) / norm for c in model.vectors]
        assert abs(got[r.doc_id].score - max(cosine)) < 1e-4
        assert max(c for c, k in zip(cosine, model.langs) if k == got[r.doc_id].lang_pred) > max(cosine) - 1e-5
