"""Quality rules from tokeniser fertility.

Public vocabularies split every word (white space does not count); per document: characters a token under
each vocabulary, share of byte-fallback tokens, entropy of the token distribution against the most that so
many tokens could have.  The bands that reject documents are learned from the corpus itself: for each
language (or script, told from the text, where there is no language) the quartiles of each figure over all
documents that pass the base rules; what lies further than SPREAD quartile distances outside them is
rejected.  Base rules (length, repeated windows, symbols, repeated lines) are counted beside.
"""

from __future__ import annotations

import base64
import re
from functools import cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, materialize, read_documents

#: The first has byte fallback and gives shares and entropy; all give characters a token.
VOCABULARIES = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")
#: Quartile distances that a figure may lie outside the quartiles; a distance counts as this share of the median at least.
SPREAD, LEAST_DISTANCE = 3.0, 0.01
#: Byte-fallback tokens that are never held against a document.
BYTES_ALLOWED = 0.05
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
WINDOW = 8


def _path(vocabulary: str) -> str:
    import public_tokenizers

    return vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)


@cache
def _pieces(vocabulary: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=_path(vocabulary))
    return sp, np.array([sp.is_byte(i) for i in range(sp.vocab_size())])


@cache
def _ranks(vocabulary: str):
    import public_tokenizers
    import tiktoken

    with open(_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words:
    """Ids of words, kept for words seen before; forgets all when it holds ``most`` words."""

    def __init__(self, vocabulary: str, most: int = 300_000):
        self.sp, self.most, self.ids = _pieces(vocabulary)[0], most, {}

    def encode(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        try:
            return np.frombuffer(b"".join([ids[w] for w in words]), np.int32)
        except KeyError:
            if len(ids) > self.most:
                ids.clear()
        new = [w for w in set(words) if w not in ids]
        got = {w: np.array(x, np.int32).tobytes() for w, x in zip(new, self.sp.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True)}
        out = np.frombuffer(b"".join([ids[w] if w in ids else got[w] for w in words]), np.int32)
        ids.update((w, x) for w, x in got.items() if len(w) <= 64)
        return out


class Sizes(dict):
    """How many tokens a word has under a vocabulary of ranks."""

    def __init__(self, vocabulary: str, most: int = 300_000):
        super().__init__()
        self.encoding, self.most = _ranks(vocabulary), most

    def __missing__(self, word: bytes) -> int:
        n = len(self.encoding.encode_ordinary(word.decode("utf-8", "replace")))
        if len(self) > self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


_CYRILLIC, _CJK = re.compile("[Ѐ-ԯ]"), re.compile("[぀-ヿ㐀-鿿가-힯]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def script(text: bytes) -> str:
    if text.isascii():
        return "latin"
    s = text.decode("utf-8", "replace")
    n = {"latin": len(_LATIN.findall(s)), "cyrillic": len(_CYRILLIC.findall(s)), "cjk": len(_CJK.findall(s))}
    n["other"] = sum(map(str.isalpha, s)) - sum(n.values()) if sum(n.values()) < 0.5 * len(s) else 0
    return max(n, key=n.get)


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(n + 1, bool)
    same[1:n] = k[1:] == k[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order] = same[:n] | same[1:]
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits of the distribution of ids."""
    s = np.sort(ids)
    c = np.diff(np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)]) / len(s)
    return float(-(c * np.log2(c)).sum())


FIGURES = "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string, other_chars_per_token double"
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def figures(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, vocabularies: tuple[str, str]) -> DataFrame:
    """COUNTS and FIGURES of each row, and the group whose bands hold for it."""
    schema = f"{COUNTS}, {FIGURES}"
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    state: list = []

    def rows(ids: list, texts: list[bytes]) -> dict:
        if not state:
            state.extend((Words(vocabularies[0]), Sizes(vocabularies[1])))
        words_of, sizes = state
        is_byte = _pieces(vocabularies[0])[1]
        out = []
        for i, text in zip(ids, texts, strict=True):
            words = text.split()
            n = len(words)
            chars = len(text.translate(None, _NOT_CHARS))
            again = repeated(words)
            tokens = words_of.encode(words)
            m, other = len(tokens), sum(map(sizes.__getitem__, words))
            per, share, bits = (chars / m, float(is_byte[tokens].mean()), entropy(tokens)) if m else (0.0, 0.0, 0.0)
            out.append((i, n, chars, len(text) - len(text.translate(None, _SYMBOLS)), repeated_lines(text), again, n < 20 or 100 * again > 30 * n, m, per, share, bits, script(text), chars / other if other else 0.0))
        return {k: list(v) for k, v in zip(names, zip(*out, strict=True), strict=True)}

    out = map_texts(docs, id_col, text_col, rows, schema, [lang_col] if lang_col else [])
    if lang_col is None:
        return out.withColumn("band", F.col("script"))
    return out.withColumn("band", F.coalesce(F.concat(F.lit("lang:"), F.col(out.columns[-1])), F.col("script"))).drop(out.columns[-1])


def _banded() -> dict[str, Column]:
    """The figures that have bands; entropy as a share of the most that so many tokens could have."""
    most = F.log2(F.greatest("n_tokens", F.lit(2)))
    return {"b_chars": F.col("chars_per_token"), "b_other": F.col("other_chars_per_token"), "b_bytes": F.col("byte_share"), "b_entropy": F.col("token_entropy") / most}


def bands(measured: DataFrame) -> DataFrame:
    """band, and low and high of each figure: from the quartiles of the rows that pass the base rules.

    Figures are counted to three digits, so that what is exchanged stays small; counts are exact.
    """
    parts = []
    for name, x in _banded().items():
        counts = measured.filter("NOT base_failed").groupBy("band", F.round(x, 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        q = counts.groupBy("band").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
        reach = SPREAD * F.greatest(F.col("q")[2] - F.col("q")[0], LEAST_DISTANCE * F.col("q")[1]) + 0.0005
        low, high = F.col("q")[0] - reach, F.col("q")[2] + reach
        if name == "b_bytes":
            low, high = F.lit(0.0), F.greatest(high, F.lit(BYTES_ALLOWED))
        if name == "b_entropy":
            high = F.lit(1.1)  # none is too varied
        parts.append(q.select("band", low.alias(f"{name}_low"), high.alias(f"{name}_high")))
    return reduce(lambda x, y: x.join(y, "band"), parts)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, vocabularies: tuple[str, str] = VOCABULARIES) -> DataFrame:
    """One row for each row of ``docs`` with the base counts, the verdict and the fertility figures.

    Null or blank text has no words: all counts 0, figures 0, base_failed, not kept.  Without ``lang_col``, or
    where it is null, the script's bands hold.  Repeated rows get equal values and count each for the bands;
    an empty table gives an empty result; very long texts are read whole; other columns, whatever their
    names, are not read.
    """
    measured = materialize(figures(docs, id_col, text_col, lang_col, vocabularies), "fertility")
    learned = materialize(bands(measured).withColumnRenamed("band", "group_"), "fertility-bands")
    inside = reduce(lambda x, y: x & y, [x.between(F.col(f"{name}_low"), F.col(f"{name}_high")) for name, x in _banded().items()])
    rows = measured.join(learned, measured["band"] == learned["group_"], "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return rows.select(*[x.strip().split(" ")[0] for x in COUNTS.split(",")], kept.alias("kept"), *[x.strip().split(" ")[0] for x in FIGURES.split(",")], "band")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read_documents(spark, sf_dir), lang_col="lang")
