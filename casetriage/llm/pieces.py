"""Exact SentencePiece encoding of merge-type (BPE) vocabularies by backtracking, and decoding.

Merges never join a word to the space mark of the next word, so a text is
encoded segment by segment, and equal segments once per task.  Within a
segment, Aho-Corasick finds all pieces; the longest one that is compatible
with its left neighbour is taken, and a bitfield remembers positions from
which no compatible piece leads on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments whose encodings a task keeps (twice that many for a while), and characters of a text handled at a time.
CACHE, CHUNK = 300_000, 1 << 20


_NONE = float("-inf")  # score of two symbols that don't merge


class PieceCodec:
    """Encoder and decoder of one vocabulary file (the library only reads the file's pieces and scores)."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = sp.eos_id()
        self.surface: dict[int, str] = {}
        self.byte_id, self.byte_of = {}, {}
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.finder = ahocorasick.Automaton()
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.byte_of[i] = i, value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.surface[i] = piece.replace(MARK, " ")
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.finder.add_word(piece, len(piece))
        self.finder.make_automaton()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that join words are not supported")
        line = "" if any("\n" in p for p in self.ids) else "\\n"  # a line end outside the vocabulary stands alone
        self.segments = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else ""))
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merge rule itself, for pairs of pieces: the best-scored neighbours join first, the leftmost on ties."""
        score, parts = self.score.get, list(text)
        pairs = [score(a + b, _NONE) for a, b in zip(parts, parts[1:])]
        while pairs and (best := max(pairs)) != _NONE:
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], _NONE)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging both texts again gives these two pieces (``left`` empty: the first piece)."""
        key = (left, right)
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            got = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return got

    def pieces(self, segment: str) -> list[str]:
        end, ids, known = len(segment), self.ids, self.pairs
        longest = [1] * end  # a character outside the vocabulary is a symbol of its own
        for last, n in self.finder.iter(segment):
            longest[last - n + 1] = n  # the matches of one start come by rising length
        open_ = bytearray(b"\x01" * (end + 1))
        out: list[str] = []
        left, pos, n = "", 0, longest[0]
        while pos < end:
            if n:
                piece = segment[pos:pos + n]
                if open_[pos + n]:
                    fits = known.get((left, piece))
                    if self.compatible(left, piece) if fits is None else fits:
                        out.append(piece)
                        left, pos = piece, pos + n
                        n = longest[pos] if pos < end else 0
                        continue
            else:  # nothing leads on from here: give back the last piece and try a shorter one
                open_[pos] = 0
                n = len(out.pop())
                pos -= n
                left = out[-1] if out else ""
            n -= 1
            while n > 1 and segment[pos:pos + n] not in ids:
                n -= 1
        return out

    def encode_segment(self, segment: str) -> list[int]:
        ids = []
        for p in self.pieces(segment):
            i = self.ids.get(p)
            ids += [i] if i is not None else [self.byte_id[b] for b in p.encode("utf-8")]
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """Text of ids, spaces for space marks; control ids have none."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.surface.get(i, ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def split(self, text: str) -> Iterator[list[str]]:
        """Segments of the marked text (a mark in front, marks for spaces), in lists of about CHUNK characters."""
        text = MARK + text.replace(" ", MARK) if text else ""
        lo = 0
        while len(text) - lo > CHUNK:
            cut = self.segments.search(text, lo + CHUNK).end()  # the end of a segment's rest is a segment's end
            yield self.segments.findall(text, lo, cut)
            lo = cut
        if lo < len(text):
            yield self.segments.findall(text, lo)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.split(text) for s in part for i in self.encode_segment(s)] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """As the library decodes: the space of the mark in front goes."""
        return self.decode_ids(ids).removeprefix(" ")


class _Segments(dict):
    """segment -> (ids joined by spaces, number of ids, decoded text)"""

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, segment: str):
        got = self.older.get(segment)
        if got is None:
            ids = self.codec.encode_segment(segment)
            got = (" ".join(map(str, ids)), len(ids), self.codec.decode_ids(ids))
        if len(segment) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[segment] = got
        return got


@lru_cache(maxsize=1)
def _codec(vocabulary: str) -> tuple[PieceCodec, _Segments]:
    """Codec and known segments, kept by a worker process from task to task."""
    codec = PieceCodec(vocabulary)
    return codec, _Segments(codec)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_ids: bool = True) -> DataFrame:
    """Encode whole texts with an end id, and decode the ids again.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256) and, with
    ``keep_ids``, ids (array<int>) and decoded; one row per row of ``docs``.
    Null and empty texts have the end id only.  ``vocabulary`` is the path of a
    SentencePiece BPE file that every executor can open.  Rows are
    independent: ids may be null or repeated, other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, known = _codec(vocabulary)
        end = str(codec.end)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                counts, hashes, decoded_hashes, ids, texts = [], [], [], [], []
                for text in part.column(1):
                    n, sha, back, first = 1, hashlib.sha256(), hashlib.sha256(), True
                    all_ids, all_text = [], []
                    for chunk in codec.split(text.as_py() or ""):
                        id_text, lengths, decoded = zip(*map(known.__getitem__, chunk))
                        n += sum(lengths)
                        id_text, decoded = " ".join(id_text) + " ", "".join(decoded)
                        decoded = decoded.removeprefix(" ") if first else decoded
                        first = False
                        sha.update(id_text.encode())
                        back.update(decoded.encode("utf-8"))
                        if keep_ids:
                            all_ids.append(id_text)
                            all_text.append(decoded)
                    sha.update(end.encode())
                    counts.append(n)
                    hashes.append(sha.hexdigest())
                    decoded_hashes.append(back.hexdigest())
                    if keep_ids:
                        ids.append([int(i) for i in ("".join(all_ids) + end).split()])
                        texts.append("".join(all_text))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded_hashes)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts)]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           + (", ids array<int>, decoded string" if keep_ids else ""))
