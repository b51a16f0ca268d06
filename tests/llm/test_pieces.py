import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from casetriage.llm.pieces import PieceCodec, encode_documents

from edge import ROWS, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(PATH)


def texts():
    rng = random.Random(5)
    out = ["", " ", "a", "  a", "a  b ", "\n\nx", "▁x", "\x00", "ﬁ½①", "a\tb", "</s> <unk> <0x41>", "日本𠮷", "\r\n", " " * 37 + "x",
           "a" * 500, "ab" * 300, "▁▁ ▁", "aaa   bbb\n  ccc", "\n \n  \n"]
    for letters in ("abcdeè rsthing   \n\t▁.,1239日𠮷éñ", "ehrtnis ", "the and ing"):
        out += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(400)]
    return out


def test_encodes_and_decodes_as_the_library(codec, library):
    for t in texts():
        ids = library.encode(t, add_eos=True)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids), t


def test_pieces_equal_the_merge_rule(codec):
    rng = random.Random(6)
    for _ in range(300):
        t = "".join(rng.choice("aeinorst▁") for _ in range(rng.randint(1, 30)))
        assert codec.pieces(t) == codec.merged(t)


def test_a_cut_inside_a_long_text_changes_nothing(codec, library, monkeypatch):
    monkeypatch.setattr("casetriage.llm.pieces.CHUNK", 50)
    for t in texts()[-60:]:
        assert codec.encode(t) == library.encode(t, add_eos=True)


def test_documents(spark, library):
    rows = encode_documents(documents(spark), PATH).collect()
    assert len(rows) == len(ROWS)
    for r, (doc_id, text, _, _) in zip(sorted(rows, key=lambda r: (r.doc_id or 0, r.n_tokens)),
                                       sorted(ROWS, key=lambda x: (x[0] or 0, len(library.encode(x[1] or ""))))):
        ids = library.encode(text or "", add_eos=True)
        assert (r.doc_id, r.ids, r.decoded) == (doc_id, ids, library.decode(ids))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    assert encode_documents(documents(spark, []), PATH).collect() == []
