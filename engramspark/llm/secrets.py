"""Secret scans: Aho-Corasick keyword prefilter, anchored patterns near hits, checksums of embedded tokens.

Everything runs on the UTF-8 bytes of the whole text (all patterns are ASCII, so no match can start or end
inside a character); offsets become code points only for documents that have spans.

Keyword hits come from one automaton over the lower-cased bytes.  At each hit, in order of its start, the
kind's pattern is matched right there (never searched); a hit inside an earlier match of its kind is
skipped, which gives the leftmost non-overlapping matches.  Runs of hex digits have no keyword: every
sixth byte is looked at, and a run of 24 must show at least four hex digits in a row among those, so the
pattern runs only in windows around such places.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, map_texts, read_documents

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt")

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_SPARSE_HEX = re.compile(rb"[0-9a-f]{4,}")
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc62(body: bytes) -> str:
    """CRC-32 in six digits of base 62, as the tokens of two public hosts end."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _sealed(m: re.Match) -> bool:
    body = m[0].split(b"_", 1)[1]
    return crc62(body[:30]).encode() == body[30:]


def _header(m: re.Match) -> bool:
    head = m[0].split(b".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except ValueError:
        return False


#: keyword (lower case) -> kind, pattern, what a match must hold
_RULES = {w: ("assign", _ASSIGN, lambda m: len(m[2]) >= 6) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")}
_RULES |= {"akia": ("access", _ACCESS, lambda m: len(m[0]) >= 20)}
_RULES |= {f"gh{c}_": ("github", _GITHUB, _sealed) for c in "pousr"}
_RULES |= {"npm_": ("npm", _NPM, _sealed), "eyj": ("jwt", _JWT, _header)}


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, rule in _RULES.items():
        a.add_word(word, (len(word), *rule))
    a.make_automaton()
    return a


def _hex_runs(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _SPARSE_HEX.finditer(text[::6]):
        for x in _HEX.finditer(text, max(0, 6 * m.start() - 5), 6 * m.end()):
            yield x.span()


def find(text: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, in code points, by start and then by kind as listed in KINDS."""
    hits = sorted(((end - rule[0] + 1, *rule[1:]) for end, rule in _automaton().iter(text.lower().decode("latin-1"))), key=lambda h: h[0])
    spans = [("hex", a, b) for a, b in _hex_runs(text)]
    over: dict[str, int] = {}
    for start, kind, pattern, holds in hits:
        if start >= over.get(kind, 0) and (m := pattern.match(text, start)):
            over[kind] = m.end()
            if holds(m):
                spans.append((kind, start, m.end()))
    if spans and not text.isascii():
        at = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        point = lambda i: int(at[i - 1]) if i else 0
        spans = [(k, point(a), point(b)) for k, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _rows(ids: list, texts: list[bytes]) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for i, text in zip(ids, texts, strict=True):
        spans = find(text)
        base = [s for s in spans if s[0] in BASE]
        out["doc_id"].append(i)
        for k in BASE:
            out[f"n_{k}"].append(sum(s[0] == k for s in base))
        out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        out["spans"].append(listed(spans))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty: no spans, the digest of the empty list.  Repeated rows and null ids are
    scanned like any other; an empty table gives an empty result; other columns are not read.
    """
    return map_texts(docs, id_col, text_col, _rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: bytes) -> str:
    """The text with each span, or union of overlapping spans, replaced by ``[kind]`` of its first."""
    chars, out, at = text.decode("utf-8", "replace"), [], 0
    spans = find(text)
    k = 0
    while k < len(spans):
        kind, start, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [chars[at:start], f"[{kind}]"]
        at, k = end, k + 1
    return "".join([*out, chars[at:]])


def redact(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``; secrets in the text are replaced by their kind, a null text stays null.

    If there is a column of text lengths, it gets the new lengths.
    """

    @F.pandas_udf("string")
    def clean(s):
        return s.map(lambda x: None if x is None else redacted(x.encode()))

    (new,) = fresh(docs, "ss_text")
    out = docs.withColumn(new, clean(F.col(f"`{text_col}`")))
    cols = [F.col(new).alias(c) if c == text_col else F.coalesce(F.length(new).cast(docs.schema[c].dataType), F.col(f"`{c}`")).alias(c) if c == n_chars_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_documents(spark, sf_dir))
