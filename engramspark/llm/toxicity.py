"""Toxicity through a noisy channel: obfuscated words are restored, then the restored text is scored.

1. A character model (4-grams of letters inside words, accents folded) is counted over all documents; its
   size is fixed.
2. Words that look written around a filter (digits and marks among letters, letters three times or more in
   a row, look-alike characters) become lattices: each character can stand for letters, repeat the one
   before, or stand for nothing, at a cost.  Runs of tokens of up to three characters become one lattice, in
   which a word may end or go on between two tokens.  Exact Viterbi decoding under the character model picks
   the readings.
3. Words of the restored text and their first 4 to 8 letters are weighed by how much more often toxic
   training documents hold them, shrunk where few documents tell; a logistic model on the evidence of all
   weighed words of a document gives the score.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice, product, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, lean, map_texts, materialize, read_documents
from .training import partition_sum

DIVISOR, REMAINDER, THRESHOLD = 5, 0, 0.5
#: The classifier learns from so many labelled rows at most.
TRAIN_ROWS = 20_000
#: Rows that the prior counts for; the weight (a rise of the log-odds) below which a feature is no evidence.
SMOOTHING, LEAST_WEIGHT = 2.0, 1.0
SHORT, LONGEST = 3, 64  # tokens of up to SHORT characters in a row are decoded as one lattice; longer words than LONGEST are read in pieces
RUN, RUN_OVERLAP = 256, 64
#: Runs of up to so many plain tokens, read in as many ways, are decoded only if a word they can hold is evidence; the results are the same.
PLAIN_RUN = 6
#: Letters of a feature that are looked at before a word is decoded; what is longer may be there.
DEPTH = 12
LETTERS = 27  # 0 is the word's edge
BEGINNINGS = (4, 5, 6, 7, 8)

#: What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¢": "c",
}
#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKE = str.maketrans("авекмнорстухіјѕԁαεικνορτυχ", "abekmhopctyxijsdaeikvoptux")
_HIDDEN = re.compile("[­​-‏⁠﻿̶]")
_ANY = frozenset("*#")
_SPELL, _REPEAT, _NOTHING, _WILD = 1.2, 0.7, 1.0, 4.5
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”‘’…–—¿"
_OUTER = "".join(c for c in _EDGES if c not in STANDS_FOR and c not in _ANY)
#: Marks at a word's ends that may be letters of it.
_MAYBE = re.compile(f"[{re.escape(''.join(c for c in _EDGES if c not in _OUTER))}]")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1+")
_OTHER_SCRIPT, _LATIN = re.compile("[Ͱ-ԯ]"), re.compile("[a-z]")
_ROW = re.compile(r"(.)\1*")
#: Words of Latin letters that compatibility forms leave alone, none like the one before: read as they are.
_PLAIN = re.compile(r"(?:([a-zß-öø-ÿ])(?!\1))+")
_SURE = re.compile(r"(?:([a-zß-öø-ÿ])(?!\1)){5,9}")
_BAR = re.compile(r"[*#]{4,}")
_SHORT_RUN = re.compile(rb"[\x01\x02]{2,}")
_HASH = (1 << 62) - 1
_WILDCARD = [(chr(96 + k), k, _WILD) for k in range(1, LETTERS)]
#: Readings of one character: letter or nothing, its folded number, cost.
Arcs = list[tuple[str, int, float]]
#: Cost, hash of the text, the text as a chain of letters.
Path = tuple[float, int, tuple | None]


class Evidence:
    """Features with a value each, and which lattices can hold any of them.

    A feature is a whole word, or ``^`` and a word's beginning.
    """

    def __init__(self, values: dict[str, float]):
        self.values = values
        #: Beginnings of features: 1 if the word is a feature should it end there, 2 if it is one whatever follows, else 0.
        self.ways: dict[str, int] = {"": 0}
        self.begin = {f[1:]: x for f, x in values.items() if f[0] == "^"}
        for f in values:
            part, kind = (f[1:], 2) if f[0] == "^" else (f, 1)
            if len(part) > DEPTH:
                part, kind = part[:DEPTH], 2
            self.ways[part] = self.ways.get(part, 0) | kind
            n = len(part) - 1
            while part[:n] not in self.ways:
                self.ways[part[:n]] = 0
                n -= 1

    def of(self, readings: list[str]) -> list[float]:
        """The values of all features of some readings."""
        out, ways, values, begin = [], self.ways, self.values, self.begin
        for r in readings:
            for n in BEGINNINGS:
                if n > len(r):
                    if r in values:
                        out.append(values[r])
                    break
                part = r[:n]
                kind = ways.get(part)
                if kind is None:  # no feature begins so
                    break
                if kind & 2:
                    out.append(begin[part])
            else:
                if r in values:
                    out.append(values[r])
        return out

    def hopeless(self, word: str) -> bool:
        """Whether the letters that all readings of a word begin with, whatever follows, rule out every feature."""
        sure = _SURE.match(word)
        if sure and len(word) <= LONGEST:
            for n in range(BEGINNINGS[0], sure.end()):  # the last letter may yet take an accent
                kind = self.ways.get(word[:n])
                if kind is None:
                    return True
                if kind & 2:
                    break
        return False

    def reachable(self, columns: list[Arcs]) -> bool:
        """Whether any reading of a lattice, or one without letters like the one before, may have a feature; False is certain."""
        ways, at = self.ways, {""}
        for arcs in columns:
            if not arcs:
                if any(ways[p] & 1 for p in at):
                    return True
                at = at | {""}
                continue
            after = set()
            for letter, _, _ in arcs:
                if not letter:
                    after |= at
                    continue
                for p in at:
                    kind = ways.get(p + letter)
                    if kind is not None:
                        if kind & 2:
                            return True
                        after.add(p + letter)
                    if p[-1:] == letter:
                        after.add(p)
            at = after
        return any(ways[p] & 1 for p in at)


def single(word: str) -> str:
    """A word without letters like the one before."""
    return "".join([c for c, before in zip(word, "\n" + word) if c != before])


def _cheapest(paths: list[Path], best: int) -> list[Path]:
    """The cheapest paths of different texts."""
    if best == 1:
        return [min(paths, key=itemgetter(0))]
    out: dict[int, Path] = {}
    for p in sorted(paths, key=itemgetter(0)):
        if p[1] not in out:
            out[p[1]] = p
            if len(out) == best:
                break
    return list(out.values())


@cache  # one entry a character
def fold(c: str) -> int:
    """1 to 26 for a letter under any accent, 0 for anything else."""
    x = ord(unicodedata.normalize("NFKD", c)[0])
    return x - 96 if 97 <= x <= 122 else 19 if c == "ß" else 0


_CODES = np.zeros(256, np.int32)
_CODES[97:123] = np.arange(1, 27)


def letter_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of (three letters before, letter) inside the words of some texts; edges on both sides count."""
    joined = b" ".join([b"  ", *texts, b"  "]).lower()
    if not joined.isascii():
        joined = unicodedata.normalize("NFKD", joined.decode("utf-8", "replace").lower().replace("ß", "s")).encode("ascii", "ignore")
    d = _CODES[np.frombuffer(joined, np.uint8)]
    c, b, a = np.zeros_like(d), np.zeros_like(d), np.zeros_like(d)
    c[1:], b[2:], a[3:] = d[:-1], d[:-2], d[:-3]
    b *= c > 0
    a *= b > 0
    counts = np.bincount(((a * LETTERS + b) * LETTERS + c) * LETTERS + d, minlength=LETTERS**4)
    counts[0] = 0  # between words
    return counts


def count_letters(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    def of(batches) -> np.ndarray:
        out = np.zeros(LETTERS**4)
        for b in batches:
            texts = b.column(0).to_pylist()
            for k in range(0, len(texts), 128):
                out += letter_counts(texts[k : k + 128])
        return out

    return partition_sum(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text")), (LETTERS**4,), of)


def letter_costs(counts: np.ndarray) -> np.ndarray:
    """-ln p(letter | three before), interpolated with shorter histories."""
    c4 = counts.reshape((LETTERS,) * 4).astype(float)
    c3, c2 = c4.sum(0), c4.sum((0, 1))
    c1 = c2.sum(0)
    p = (c1 + 1) / (c1.sum() + LETTERS)
    for c in (c2, c3, c4):
        p = (c + 10 * p) / (c.sum(-1, keepdims=True) + 10)
    return -np.log(p).ravel()


class Restorer:
    """Readings of words under a character model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.astype(float).tolist()
        self.table = costs.astype(float).reshape(-1, LETTERS)
        self.tails: dict[tuple[str, bool], list[str]] = {}
        # For every state the least cost of n more letters, whichever they are, and the word's end; the first of them.
        self.ahead, self.choice = [self.table[:, 0]], [np.zeros(0, int)]

    def _ahead(self, n: int) -> np.ndarray:
        while len(self.ahead) <= n:
            after = np.arange(LETTERS**3)[:, None] % 729 * LETTERS + np.arange(1, LETTERS)
            sums = self.table[:, 1:] + _WILD + self.ahead[-1][after]
            self.choice.append(sums.argmin(1) + 1)
            self.ahead.append(sums.min(1))
        return self.ahead[n]

    def lattice(self, word: str, masked: bool = False) -> list[Arcs]:
        """For each character its readings: (letter or nothing, folded letter, cost); ``masked``: each * and # is one letter.

        More than three of them in a row are a bar, which stands for nothing.
        """
        bars = {k for m in _BAR.finditer(word) for k in range(*m.span())} if "*" in word or "#" in word else ()
        out: list[Arcs] = []
        before = ""
        for k, c in enumerate(word):
            if k in bars:
                out.append([("", 0, _NOTHING)])
                before = ""
                continue
            if masked and c in _ANY:
                out.append(_WILDCARD)
                before = ""
                continue
            f = fold(c)
            arcs = [(x, ord(x) - 96, _SPELL) for x in STANDS_FOR.get(c, "")]
            if f:
                arcs.append((c, f, 0.0))
            elif c.isalpha():
                arcs.append((c, 0, 0.0))
            else:
                arcs.append(("", 0, _NOTHING if not arcs else 6 * _NOTHING))
            if c in _ANY:
                arcs += _WILDCARD
            if c == before:
                arcs.append(("", 0, _REPEAT))
            out.append(arcs)
            before = c
        return out

    def search(self, columns: list[Arcs], best: int) -> list[str]:
        """The ``best`` cheapest different readings of a lattice, exactly; an empty column lets a word end or go on there.

        A state is the last three letters.  Each keeps its ``best`` cheapest texts, so nothing is pruned that
        could still win.  Lattices with wildcards have up to 27^3 states: see ``search_wide``.
        """
        plain = 0
        while plain < len(columns) and len(columns[plain]) == 1 and columns[plain][0][0]:
            plain += 1  # one reading each: no choice yet
        wild = [len(arcs) >= LETTERS - 1 for arcs in columns]
        stop = len(columns)
        while stop > plain and wild[stop - 1]:
            stop -= 1  # wildcards at the end are looked up
        if any(wild[:stop]):
            return self.search_wide(columns, plain, best)
        costs, key = self.costs, 0
        for ((_, f, _),) in columns[:plain]:
            key = key % 729 * LETTERS + f
        head = "".join(arcs[0][0] for arcs in columns[:plain])
        if best == 1 and stop == len(columns):
            return [head + self._cheapest_text(columns[plain:], key)]
        states: dict[int, list[Path]] = {key: [(0.0, 0, None)]}
        for arcs in columns[plain:stop]:
            after: dict[int, list[Path]] = {}
            for key, held in states.items():
                at, base = key * LETTERS, key % 729 * LETTERS
                if not arcs:
                    end = costs[at]
                    after.setdefault(key, []).extend(held)
                    after.setdefault(0, []).extend([(t + end, h * 131 + 32 & _HASH, (p, " ")) for t, h, p in held])
                for letter, f, cost in arcs:
                    if letter:
                        cost, code = cost + costs[at + f], ord(letter)
                        after.setdefault(base + f, []).extend([(t + cost, h * 131 + code & _HASH, (p, letter)) for t, h, p in held])
                    else:
                        after.setdefault(key, []).extend([(t + cost, h, p) for t, h, p in held])
            states = {k: v if len(v) == 1 else _cheapest(v, best) for k, v in after.items()}
        ends = [(t + costs[key * LETTERS], h, p) for key, held in states.items() for t, h, p in held] if stop == len(columns) else self._masked_ends(states, columns[stop:], best)
        out = []
        for _, _, path in _cheapest(ends, best):
            text = []
            while path:
                path, letter = path
                text.append(letter)
            out.append(head + "".join(reversed(text)))
        return out

    def _cheapest_text(self, columns: list[Arcs], key: int) -> str:
        """``search`` for one reading, without wildcards, behind the letters that ``key`` stands for."""
        costs = self.costs
        states: dict[int, tuple[float, tuple | None]] = {key: (0.0, None)}
        for arcs in columns:
            after: dict[int, tuple[float, tuple | None]] = {}
            for key, (t, path) in states.items():
                at = key * LETTERS
                if not arcs:
                    if key not in after or t < after[key][0]:
                        after[key] = t, path
                    c = t + costs[at]
                    if 0 not in after or c < after[0][0]:
                        after[0] = c, (path, " ")
                for letter, f, c in arcs:
                    if letter:
                        k, c = key % 729 * LETTERS + f, t + (c + costs[at + f])
                        if k not in after or c < after[k][0]:
                            after[k] = c, (path, letter)
                    elif key not in after or t + c < after[key][0]:
                        after[key] = t + c, path
            states = after
        path, text = min([(t + costs[key * LETTERS], path) for key, (t, path) in states.items()], key=itemgetter(0))[1], []
        while path:
            path, letter = path
            text.append(letter)
        return "".join(reversed(text))

    def _masked_ends(self, states: dict[int, list[Path]], columns: list[Arcs], best: int) -> list[Path]:
        """The paths with the wildcards of ``columns`` behind: how many are letters, and the first of these, in every way."""
        skips = sorted(min((c for x, _, c in arcs if not x), default=np.inf) for arcs in columns)
        out: list[Path] = []
        for n in range(len(columns) + 1):
            skipped = sum(skips[: len(columns) - n])
            if skipped == np.inf:
                continue
            ahead = self._ahead(max(0, n - 1))
            for key, held in states.items():
                if not n:
                    out += [(t + skipped + self.costs[key * LETTERS], h, p) for t, h, p in held]
                    continue
                sums = self.table[key, 1:] + ahead[key % 729 * LETTERS + np.arange(1, LETTERS)]
                for f in np.argsort(sums, kind="stable")[:best].tolist():
                    at, letters = key % 729 * LETTERS + f + 1, [f + 1]
                    for k in range(n - 1, 0, -1):
                        letters.append(int(self.choice[k][at]))
                        at = at % 729 * LETTERS + letters[-1]
                    for t, h, p in held:
                        for x in letters:
                            h, p = h * 131 + 96 + x & _HASH, (p, chr(96 + x))
                        out.append((t + skipped + _WILD + float(sums[f]), h, p))
        return out

    def search_wide(self, columns: list[Arcs], plain: int, best: int) -> list[str]:
        """``search`` over arrays of states: the cheapest reading, and the next cheapest that end in other states."""
        key = 0
        for ((_, f, _),) in columns[:plain]:
            key = key % 729 * LETTERS + f
        keys, total = np.array([key]), np.zeros(1)
        steps: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
        for arcs in columns[plain:]:
            new, cost, back, said, letters = [], [], [], [], []
            if not arcs:
                arcs, letters = [("", 0, 0.0)], [" "]
                new.append(np.zeros_like(keys))
                cost.append(total + self.table[keys, 0])
                back.append(np.arange(len(keys)))
                said.append(np.zeros(len(keys), np.int64))
            wild = len(arcs) >= LETTERS - 1
            if wild:  # grouped by the last two letters, so that each next state is met once
                order = np.argsort(keys % 729, kind="stable")
                pair = keys[order] % 729
                starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                sums = total[order, None] + self.table[keys[order], 1:]
                least = np.minimum.reduceat(sums, starts, axis=0)
                sizes = np.diff(np.r_[starts, len(order)])
                first = np.where(sums == np.repeat(least, sizes, axis=0), np.arange(len(order))[:, None], len(order))
                new.append((pair[starts][:, None] * LETTERS + np.arange(1, LETTERS)).ravel())
                cost.append((least + _WILD).ravel())
                back.append(order[np.minimum.reduceat(first, starts, axis=0).ravel()])
                said.append(np.tile(np.arange(len(letters), len(letters) + LETTERS - 1), len(starts)))
                letters += [x for x, _, _ in _WILDCARD]
            for letter, f, c in arcs:
                if wild and letter and c == _WILD:
                    continue
                new.append(keys % 729 * LETTERS + f if letter else keys)
                cost.append(total + c + (self.table[keys, f] if letter else 0.0))
                back.append(np.arange(len(keys)))
                said.append(np.full(len(keys), len(letters)))
                letters.append(letter)
            keys, total, b, w = (np.concatenate(x) for x in (new, cost, back, said))
            if len(new) > 1:
                order = np.lexsort((total, keys))
                order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]]
                keys, total, b, w = keys[order], total[order], b[order], w[order]
            steps.append((b, w, letters))
        total = total + self.table[keys, 0]
        head, out = "".join(arcs[0][0] for arcs in columns[:plain]), []
        few = np.argpartition(total, 3 * best)[: 3 * best] if len(total) > 3 * best else np.arange(len(total))
        for at in few[np.argsort(total[few], kind="stable")].tolist():
            text = []
            for b, w, letters in reversed(steps):
                text.append(letters[w[at]])
                at = b[at]
            out.append(head + "".join(reversed(text)))
        return list(dict.fromkeys(out))[:best]

    def run(self, tokens: list[str] | tuple[str, ...], evidence: Evidence | None = None) -> list[str]:
        """Words of a run of short tokens: one lattice in which a word may end, or go on, between any two tokens.

        Masks at the ends of a token that holds something else are decoration.  With ``evidence``: none if no
        word that the lattice can hold has a feature.
        """
        if evidence:
            plain = plain_words(tokens)
            if plain and not evidence.of(plain):
                return []
        columns: list[Arcs] = []
        for n, token in enumerate(tokens):
            columns += [[]] * (n > 0) + self.lattice(token.strip("*#") or token)
        if evidence and not plain and not evidence.reachable(columns):
            return []
        return self.search(columns, 1)[0].split()

    def decode(self, word: str, best: int = 3, masked: bool = False, evidence: Evidence | None = None) -> list[str]:
        """The cheapest readings, best first; with ``evidence``: none if no reading of the lattice has a feature."""
        columns = self.lattice(word, masked)
        return self.search(columns, best) if not evidence or evidence.reachable(columns) else []

    def tail(self, core: str, word: str, masked: bool, evidence: Evidence | None = None) -> list[str]:
        """``decode``; what marks behind plain letters are read as depends on the last three letters alone, and is remembered."""
        if not (word.startswith(core) and core.isascii() and core.isalpha()) or _DOUBLE.search(core) or len(word) > len(core) + 8:
            return self.decode(word, masked=masked, evidence=evidence)
        if evidence and core[: BEGINNINGS[0]] not in evidence.ways:  # every reading begins with these letters
            return []
        key = word[max(0, len(core) - 3) :], masked
        if key not in self.tails:
            if len(self.tails) > 100_000:
                self.tails.clear()
            self.tails[key] = self.decode(key[0], masked=masked)
        return [core[:-3] + x for x in self.tails[key]]

    def readings(self, word: str, evidence: Evidence | None = None) -> list[str]:
        """The restored words that a lower-case word may count as; its plain form unless it looks written around.

        Words of more than LONGEST characters are read in pieces of that length, which overlap by half.
        With ``evidence`` readings are left out if none that the word can have has a feature.
        """
        if len(word) > LONGEST:
            return [r for k in range(0, len(word) - LONGEST // 2, LONGEST // 2) for r in self.readings(word[k : k + LONGEST], evidence)]
        if _PLAIN.fullmatch(word):
            return [word]
        core = word.strip(_EDGES)
        if core.isascii() and core.isalpha():
            doubled = _DOUBLE.search(core)
            odd = len(core) < len(word) and _MAYBE.search(word) or doubled and _TRIPLE.search(core)
        else:
            plain = unicodedata.normalize("NFKC", _HIDDEN.sub("", word))
            if _OTHER_SCRIPT.search(plain) and _LATIN.search(plain):
                plain = plain.translate(LOOK_ALIKE)
            core = plain.strip(_EDGES)
            doubled = _DOUBLE.search(core)
            odd = (not core.isalpha() or doubled and _TRIPLE.search(core) or _MAYBE.search(plain)) and (any(map(fold, core)) or len(_MAYBE.findall(plain)) > 2)
            word = plain
        out = [core]
        if odd:
            # Marks around the word are cut unless they may be letters of it.
            word = word.strip(_OUTER)
            for masked in (False, True) if not _ANY.isdisjoint(word) else (False,):
                out += self.tail(core, word, masked, evidence)
            out += map(single, out[1:])
        elif doubled:
            out.append(single(core))
        return out

    def words(self, text: str) -> Iterator[list[str]]:
        """Readings of each different word of a text, and of letters that stand apart joined."""
        words = text.lower().split()
        for w in (*set(words), *spaced(words)):
            yield self.readings(w)
        for tokens in short_runs(words):
            yield self.run(tokens)


def _core(word: str) -> str:
    """A word without the marks at its ends that are no letters, if it is short; else nothing."""
    core = word.strip(_OUTER) or word
    return core if len(core) <= SHORT or len(core.strip(_EDGES) or core) <= SHORT else ""


_CORES: dict[str, str] = {}


def short_runs(words: list[str]) -> set[tuple[str, ...]]:
    """Runs of two or more tokens of up to SHORT characters (marks at both ends not counted): letters or pieces of words set apart.

    Of more than RUN tokens: pieces of RUN, which overlap.
    """
    if len(_CORES) > 300_000:
        _CORES.clear()
    out = set()
    cores = list(map(_CORES.get, words))
    if None in cores:
        for k, w in enumerate(words):
            if cores[k] is None:
                cores[k] = _core(w)
                if len(w) <= LONGEST:
                    _CORES[w] = cores[k]
    for m in _SHORT_RUN.finditer(bytes(map(bool, cores))):
        run_pieces(tuple(cores[m.start() : m.end()]), out)
    return out


def run_pieces(whole: tuple[str, ...], out: set[tuple[str, ...]]) -> None:
    """Adds to ``out`` how a whole run of short tokens is read: at most RUN at once, marks at the ends as letters and as marks."""
    for k in range(0, max(1, len(whole) - RUN_OVERLAP), RUN - RUN_OVERLAP):
        run = whole[k : k + RUN]
        if len(run) > 1 and run not in out and ("a" <= run[0][0] <= "z" or any(map(fold, "".join(run)))):
            out.add(run)
            if run[0][0] in _EDGES or run[-1][-1] in _EDGES:
                out.add((run[0].lstrip(_EDGES) or run[0], *run[1:-1], run[-1].rstrip(_EDGES) or run[-1]))


def plain_words(run: tuple[str, ...]) -> list[str] | None:
    """Every word that the lattice of a run can hold, if its tokens are few and letters alone; else None.

    Such a lattice only chooses where words end, and which of like letters in a row count, so what none of
    these words tells, its decoding cannot tell.
    """
    if len(run) > PLAIN_RUN or not "".join(run).isalpha():
        return None
    runs = [run]
    if any(map(_DOUBLE.search, run)):
        runs = list(islice(product(*map(_said, run)), PLAIN_RUN + 1))
        if len(runs) > PLAIN_RUN:
            return None
    return ["".join(r[a:b]) for r in runs for a in range(len(r)) for b in range(a + 1, len(r) + 1)]


def _said(token: str) -> list[str]:
    """A token with each row of like letters at every length from one."""
    rows = [[m[0][:n] for n in range(1, len(m[0]) + 1)] for m in _ROW.finditer(token)]
    return ["".join(x) for x in product(*rows)]


def spaced(words: list[str], least: int = 4) -> list[str]:
    """Runs of ``least`` or more words of one character each (the last may carry marks), joined; also without an end."""
    one = np.fromiter(map(len, words), np.int64, len(words)) == 1
    if one.sum() < least - 1:
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, one, False].astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        tail = words[b] if b < len(words) and len(words[b].rstrip(_EDGES)) == 1 else ""
        if b - a + bool(tail) >= least:
            run = words[a:b] + [tail] * bool(tail)
            out += map("".join, (run, run[1:], run[:-1]))  # a word of one letter may stand before or behind
    return out


def features(readings: list[str]) -> list[str]:
    """Readings of a word, and their beginnings, which are marked."""
    out = []
    for r in readings:
        if r:
            out.append(r)
            out += ["^" + r[:n] for n in BEGINNINGS if len(r) >= n]
    return out


class Scorer:
    """Scores of texts; remembers words seen: those without evidence in two generations, those with it by weight."""

    def __init__(self, costs: np.ndarray, weights: dict[str, float], beta: np.ndarray | None, most: int = 600_000):
        self.restorer, self.evidence, self.beta, self.most = Restorer(costs), Evidence(weights), beta, most
        self.forget()

    def forget(self) -> None:
        self.young: set[str | tuple[str, ...]] = set()
        self.old: set[str | tuple[str, ...]] = set()
        self.weight: dict[str | tuple[str, ...], float] = {}
        self.kinds: dict[str, int] = {}  # of words seen: 2 for one character, 1 for others that are short
        self.runs: set[tuple[str, ...]] = set()  # whole runs of words seen without evidence
        self.passing: list[str] = []  # long words in ``kinds``

    def learn(self, word: str | tuple[str, ...]) -> float:
        """The weight of a word, or of the strongest word in a run of short tokens, not seen before; 0 without evidence."""
        evidence, restorer = self.evidence, self.restorer
        if isinstance(word, str) and evidence.hopeless(word):
            x = 0.0
        elif isinstance(word, str):
            short = _core(word)
            core = short or word.strip(_OUTER) or word  # read alike, if not in pieces
            if core == word or len(word) > LONGEST:
                x = max(evidence.of(restorer.readings(word, evidence)), default=0.0)
            else:
                x = self.weight.get(core)
                if x is None:
                    x = 0.0 if core in self.young else self.learn(core)
            if short:
                self.kinds[word] = 1 + (len(word) == 1)
                if len(word) > LONGEST:
                    self.passing.append(word)
        else:
            x = max(evidence.of(restorer.run(word, evidence)), default=0.0)
        if len(word) <= LONGEST:
            if x:
                self.weight[word] = x
            else:
                self.young.add(word)
        return x

    def found(self, asked: set[str] | set[tuple[str, ...]]) -> list[float]:
        """The weights of those words or runs that are evidence."""
        rest = asked - self.young
        if self.old:
            again = rest & self.old
            self.young |= again
            rest -= again
        out = []
        for w in rest:
            x = self.weight.get(w)
            if x is None:
                x = self.learn(w)
            if x:
                out.append(x)
        return out

    def score(self, text: str) -> float:
        if self.beta is None:
            return 0.0
        if max(len(self.kinds), len(self.weight), len(self.runs)) > self.most // 2:
            self.forget()
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, set()
        words = text.lower().split()
        different = set(words)
        hits = self.found(different)
        kinds = bytes(map(self.kinds.get, words, repeat(0)))
        whole = {tuple(words[m.start() : m.end()]) for m in _SHORT_RUN.finditer(kinds)} - self.runs
        if whole:
            runs: set[tuple[str, ...]] = set()
            for run in whole:
                read: set[tuple[str, ...]] = set()
                run_pieces(tuple(map(_core, run)), read)
                found = self.found(read - runs)
                if not found and len(run) <= LONGEST and runs.isdisjoint(read):
                    self.runs.add(run)
                hits += found
                runs |= read
        if b"\2\2\2" in kinds:
            for w in spaced(words):
                hits += self.found({w})
        while self.passing:
            self.kinds.pop(self.passing.pop(), None)
        p = float(1 / (1 + np.exp(-np.clip(summary(hits, len(different)) @ self.beta, -30, 30))))
        return p if hits else p / 2  # no evidence, no verdict


def summary(weights, n_words: int) -> np.ndarray:
    """What the logistic model sees of a document: the evidence of all its weighed words and its length.

    Odds are added as cubes, so that many weak words do not make up for a strong one.
    """
    return np.array([1.0, np.log1p((np.expm1(np.minimum(weights, 12.0)) ** 3).sum()) / 3, np.log1p(n_words)])


def weigh(pos: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """How far a feature raises the log-odds, shrunk by its evidence: the posterior mean less a standard deviation, against the prior."""
    a, m = pos + SMOOTHING * prior, n + SMOOTHING
    mean = a / m
    low = np.clip(mean - np.sqrt(mean * (1 - mean) / (m + 1)), 1e-9, 1 - 1e-9)
    return np.log(low / (1 - low)) - np.log(prior / (1 - prior))


def train(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows_bound: int) -> tuple[np.ndarray, dict[str, float], np.ndarray | None]:
    """Costs of letters, weights of features, the logistic model (None where labels of both classes are missing)."""
    costs = letter_costs(count_letters(docs, text_col))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), DIVISOR, REMAINDER)).groupBy("doc_id").agg(F.max(F.col(label) > 0).cast("int").alias("y"))
    share = rows_bound / max(1, known.count())
    if share < 1:  # a sample by hash, of about ``rows_bound`` rows
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = known.withColumnRenamed("doc_id", "label_id")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("label_id")).drop("label_id")

    def read(text: str, restorer: Restorer, young: dict, pick: Callable[[list[str]], list], evidence: Evidence | None = None) -> tuple[int, list]:
        """How many different words a text has; what ``pick`` takes of the readings of each, and of each run of short tokens."""
        words = (text or "").lower().split()
        different, found = set(words), []
        if len(young) > 200_000:
            young.clear()
        for w in (*different, *spaced(words)):
            x = young.get(w)
            if x is None:
                x = pick(restorer.readings(w, evidence))
                if len(w) <= LONGEST:
                    young[w] = x
            if x:
                found += x
        for tokens in short_runs(words):
            x = young.get(tokens)
            if x is None:
                x = pick(restorer.run(tokens, evidence))
                if len(tokens) <= LONGEST:
                    young[tokens] = x
            found += x
        return len(different), found

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, young = Restorer(costs), {}
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(list(set(read(text, restorer, young, features)[1])), pa.string())], names=["f"])

    counted = {int(r.y): r["count"] for r in rows.groupBy("y").count().collect()}
    total, positive = sum(counted.values()), counted.get(1, 0)
    if not 0 < positive < total:
        return costs, {}, None
    prior = (positive + 1) / (total + 2)
    # Features that would have too little weight even if no clean row held them need not be counted.
    least = next(k for k in range(1, 64) if weigh(np.array(k), np.array(k), prior) >= LEAST_WEIGHT or k == 63)
    seen = rows.filter("y = 1").select("text").mapInArrow(lean(listed), "f string").groupBy("f").count().filter(F.col("count") >= least)
    index = {f: k for k, f in enumerate(sorted(r.f for r in seen.select("f").collect()))}
    m = max(1, len(index))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, young, evidence = Restorer(costs), {}, Evidence(index)

        def marked(readings: list[str]) -> list[int]:
            own = sorted(set(evidence.of(readings)))
            return [*own[:-1], -1 - own[-1]] if own else own  # the last of a word is marked

        for b in batches:
            got = [read(text, restorer, young, marked, evidence) for text in b.column(0).to_pylist()]
            sizes, kept = [n for n, _ in got], [np.array(x, "<i4").tobytes() for _, x in got]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int32()), pa.array(kept, pa.binary())], names=["y", "n", "f"])

    rows = materialize(rows.select("text", "y").mapInArrow(lean(indexed), "y int, n int, f binary"), "toxicity-indexed")

    def per_feature(batches) -> np.ndarray:
        out = np.zeros((2, m))
        for b in batches:
            for y, f in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                f = np.frombuffer(f, "<i4")
                out[y, np.unique(np.where(f < 0, -1 - f, f))] += 1
        return out

    by_class = partition_sum(rows, (2, m), per_feature)
    pos, n_all = by_class[1], by_class.sum(0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for y, n, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f = np.frombuffer(f, "<i4")
                last = np.flatnonzero(f < 0)
                f = np.where(f < 0, -1 - f, f)
                w = weigh(pos[f] - y, n_all[f] - 1, prior)  # a training row does not vote for itself
                w = np.maximum.reduceat(w, np.r_[0, last[:-1] + 1]) if len(last) else w
                out.append(summary(w[w >= LEAST_WEIGHT], n).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["y", "x"])

    rows = materialize(rows.mapInArrow(lean(summed), "y int, x binary"), "toxicity-summed")
    beta = np.array([np.log(prior / (1 - prior)), 0, 0])
    k = len(beta)

    def step(beta: np.ndarray):
        def of(batches) -> np.ndarray:
            out = np.zeros((k, k + 1))
            for b in batches:
                x, y = np.frombuffer(b"".join(b.column(1).to_pylist())).reshape(-1, k), b.column(0).to_numpy()
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                out += x.T @ np.c_[x * (p * (1 - p))[:, None], y - p]
            return out

        return of

    for _ in range(8):
        a = partition_sum(rows, (k, k + 1), step(beta))
        move = np.linalg.solve(a[:, :k] + 1e-2 * np.eye(k), a[:, k] - 1e-2 * beta)
        beta = beta + move
        if np.abs(move).max() < 1e-4:
            break
    w = weigh(pos, n_all, prior)
    return costs, {f: float(w[k]) for f, k in index.items() if w[k] >= LEAST_WEIGHT}, beta


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", rows_bound: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Learns from about ``rows_bound`` labelled rows at most (by hash of the id) whose crc32(id as text) mod 5 is
    not 0; characters are counted over all documents.  Null text counts as empty: no evidence, so never
    toxic.  Repeated rows get equal scores; without labels of both classes nothing can be learned and all
    scores are 0.  Very long texts are read whole; an empty table gives an empty result; other columns of
    ``docs``, whatever their names, are not read.
    """
    costs, weights, beta = train(docs, labels, label, id_col, text_col, rows_bound)
    kept: list[Scorer] = []

    def rows(ids: list, texts: list[bytes]) -> dict:
        if not kept:
            kept.append(Scorer(costs, weights, beta))
        return {"doc_id": ids, "score": [kept[0].score(x.decode("utf-8", "replace")) for x in texts]}

    out = map_texts(docs, id_col, text_col, rows, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), DIVISOR, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of ``docs`` whose score is below THRESHOLD, with all their columns, whatever their names.

    No join, so ids need not be unique and may be null; repeated rows stay or go together.  Null and blank
    texts stay; without labels of both classes all rows stay; an empty table gives an empty result.
    """
    costs, weights, beta = train(docs, labels, label, id_col, text_col, TRAIN_ROWS)
    if beta is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(costs, weights, beta)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([scorer.score(x or "") < THRESHOLD for x in texts], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
