"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's new segments (a run of word marks with what follows; no piece holds a mark after another
character) are concatenated and indexed by a suffix array as deep as the longest piece.  Every piece is
binary-searched for its range of suffixes; the ranges give all edges (place, piece), which are sorted by
place and relaxed from left to right.

The public vocabulary is a BPE model, so relaxation keeps, for each place, the last piece of the encoding
of the text up to there: an edge extends it if the two pieces stand side by side under the merge rules,
which holds for exactly one edge into each place.  (Adding piece scores instead, as for unigram models,
would not give the library's ids.)  Whether a pair stands is worked out once by merging its characters.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, map_texts, read_documents

MARK, VOCABULARY = "▁", "piece_bpe_32k.model"
_START = -1


class Codec:
    """Encodes and decodes with one vocabulary; keeps the ids of segments and pairs it has seen, up to ``most`` each."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = 800_000, index_chars: int = 400_000):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
        n = sp.vocab_size()
        self.most, self.index_chars = most, index_chars
        self.byte_id = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.unknown = sp.unk_id()
        self.out = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        # A piece that its own merges don't reach is never put out.
        reached = [i for i in plain if self.merged(self.text[i]) == [self.text[i]]]
        self.depth = max(len(self.text[i]) for i in reached)
        if any(MARK in self.text[i].lstrip(MARK) for i in reached):
            raise ValueError("pieces that hold a word mark after another character are not supported")
        chars = np.zeros((len(reached), self.depth), np.uint32)
        for k, i in enumerate(reached):
            chars[k, : len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.piece_ids, self.piece_chars = np.array(reached), chars
        self.piece_len = (chars > 0).sum(1)
        self.alphabet = np.unique(chars)[1:]
        # No merge reaches over two characters that no piece holds side by side, so texts part there: around
        # line ends and tabs, and between a letter and a mark after it.
        beside = {x for i in reached for x in zip(self.text[i], self.text[i][1:], strict=False)}
        letter = r"[^\W\d_²³¹]"
        bars = "".join(c for c in "\n\t" if ord(c) not in set(self.alphabet.tolist()))
        stops = "".join(c for c in ",.;:!?" if not any(b == c and re.match(letter, a) for a, b in beside))
        self.split = re.compile((f"{MARK}*{letter}+(?=[{stops}])|" if stops else "") + f"{MARK}*[^{MARK}{bars}]+|{MARK}+" + (f"|[{bars}]+" if bars else "")).findall
        self.shift = n.bit_length()
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, s: str) -> list[str]:
        """BPE from single characters: the best-scored neighbours merge first, the leftmost of equals."""
        parts, score = list(s), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                x = score.get(parts[k] + parts[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, piece id, its length) of every occurrence of every piece in ``s``, by place."""
        cps = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
        chars = np.intersect1d(np.unique(cps), self.alphabet)
        if not len(chars):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)

        def ranks(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(chars, x), len(chars) - 1)
            return np.where(chars[at] == x, at + 1, 0)

        kind = ">u1" if len(chars) < 255 else ">u2" if len(chars) < 65535 else ">u4"
        width = -(-self.depth * np.dtype(kind).itemsize // 8) * 8
        deep = width // np.dtype(kind).itemsize
        coded = np.zeros(len(cps) + deep, kind)
        coded[: len(cps)] = ranks(cps)
        starts = np.flatnonzero(coded[: len(cps)])
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(coded, deep)[starts])
        words = keys.view(">u8").astype(np.uint64)
        suffixes = np.lexsort(words.T[::-1])
        index = keys[suffixes].view(f"S{width}").ravel()
        asked = np.zeros((len(self.piece_ids), deep), kind)
        asked[:, : self.depth] = np.where(self.piece_chars > 0, ranks(self.piece_chars), 0)
        here = ((asked > 0).sum(1)) == self.piece_len
        low = asked[here]
        high = low.copy()
        high[np.arange(deep)[None, :] >= self.piece_len[here][:, None]] = np.iinfo(np.dtype(kind)).max
        a = np.searchsorted(index, low.view(f"S{width}").ravel(), "left")
        b = np.searchsorted(index, high.view(f"S{width}").ravel(), "right")
        many = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        which = np.repeat(np.flatnonzero(here), many)
        edge = np.sort(starts[suffixes[at]] << self.shift | which)
        which = edge & ((1 << self.shift) - 1)
        return edge >> self.shift, self.piece_ids[which], self.piece_len[which]

    def stands(self, p: int, t: int) -> bool:
        key = p << self.shift | t
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > 2 * self.most:
                self.pairs.clear()
            a, b = self.text[p], self.text[t]
            ok = self.pairs[key] = self.merged(a + b) == [a, b]
        return ok

    def relax(self, segments: list[str]) -> Iterator[np.ndarray]:
        """The ids of each segment."""
        bar = "\x00"
        place, piece, length = (x.tolist() for x in self.edges(bar.join(segments)))
        pairs, shift, e, base, m = self.pairs, self.shift, 0, 0, len(place)
        for s in segments:
            n, end = len(s), base + len(s)
            last: list = [None] * (n + 1)
            last[0] = (_START, 0)
            for i in range(n):
                p = last[i][0]
                while e < m and place[e] == base + i:
                    t, to = piece[e], i + length[e]
                    if last[to] is None:
                        ok = p < 0 or pairs.get(p << shift | t)
                        if ok is None:
                            ok = self.stands(p, t)
                        if ok:
                            last[to] = (t, i)
                    e += 1
                if last[i + 1] is None and s[i] not in self.score:
                    last[i + 1] = (_START, i)
            ids: list[int] = []
            while n:
                t, i = last[n]
                ids += reversed([self.byte_id[x] for x in s[i].encode("utf-8", "replace")] if self.byte_id else [self.unknown]) if t < 0 else (t,)
                n = i
            ids.reverse()
            base = end + 1
            yield np.array(ids, "<i4")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids as the library gives them: a mark is put in front, spaces are marks; the empty text has none."""
        for k in range(0, len(texts), 1024):
            parts = [self.split(MARK + x.replace(" ", MARK)) if x else [] for x in texts[k : k + 1024]]
            known = self.known
            if len(known) > self.most:
                known.clear()
            new, chars, got = [], 0, {}
            for s in {s for p in parts for s in p if s not in known}:
                new.append(s)
                chars += len(s) + 1
                if chars > self.index_chars:
                    got.update((a, b.tobytes()) for a, b in zip(new, self.relax(new), strict=True))
                    new, chars = [], 0
            if new:
                got.update((a, b.tobytes()) for a, b in zip(new, self.relax(new), strict=True))
            for p in parts:
                yield np.frombuffer(b"".join([known[s] if s in known else got[s] for s in p]), "<i4")
            known.update((a, b) for a, b in got.items() if len(a) <= 64)

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of fallback tokens are joined again; the mark in front goes."""
        out = self.out
        return b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace").removeprefix(" ")


@cache
def codec(vocabulary: str = VOCABULARY) -> Codec:
    return Codec(vocabulary)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every row; a null text counts as empty and has no ids."""

    def rows(ids: list, texts: list[bytes]) -> dict:
        return {"doc_id": ids, "ids": list(codec(vocabulary).encode([x.decode("utf-8", "replace") for x in texts]))}

    return map_texts(docs, id_col, text_col, rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of every row of doc_id, ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [codec(vocabulary).decode(np.array(x or [], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(lean(run), "doc_id long, text string")


SCHEMA = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Every row encoded and decoded again, told by digests: crc32 of the ids (little-endian, 32 bits), sha256
    of the decoded text, whether that is the text (a literal word mark comes back as a space).

    Null text counts as empty: no tokens.  Repeated rows get equal values; an empty table gives an empty
    result; other columns are not read.
    """

    def rows(ids: list, texts: list[bytes]) -> dict:
        c = codec(vocabulary)
        out: dict[str, list] = {x.strip().split(" ")[0]: [] for x in SCHEMA.split(",")}
        plain = [x.decode("utf-8", "replace") for x in texts]
        for i, text, got in zip(ids, plain, c.encode(plain), strict=True):
            back = c.decode(got)
            row = (i, len(got), int(c.is_byte[got].sum()), zlib.crc32(got.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text)
            for name, x in zip(out, row, strict=True):
                out[name].append(x)
        return out

    return map_texts(docs, id_col, text_col, rows, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_documents(spark, sf_dir))
