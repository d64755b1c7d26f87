"""Operators on documents: brute force on small fixtures, and the cases that each docstring defines."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from engramspark.llm import exact_dedup, fertility, hmm, ngram_join, packing, pieces, quality, secrets, toxicity
from engramspark.llm.training import isotonic

SCHEMA = "doc_id long, text string, keep_id string, sequence_id int, score string"
LONG = " ".join(f"word{i % 997} tail{i % 31}" for i in range(9000))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, "Über  ärger 日本語 🎉"), (6, LONG), (7, LONG + " x"), (8, "a b c d e f g h i j"), (9, "a  b c d e\nf g h i j")]
OPERATORS = {
    "ngram": lambda d, labels: ngram_join.components(d),
    "dedup": lambda d, labels: exact_dedup.assign(d),
    "packing": lambda d, labels: packing.pack_documents(d),
    "quality": lambda d, labels: quality.classify(d, labels),
    "hmm": lambda d, labels: hmm.score(d, rounds=1),
    "fertility": lambda d, labels: fertility.measure(d),
    "toxicity": lambda d, labels: toxicity.classify(d, labels),
    "pieces": lambda d, labels: pieces.digests(d),
    "secrets": lambda d, labels: secrets.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    out = OPERATORS[name](frame(spark, ODD), labels).collect()
    assert Counter(r.doc_id for r in out if not getattr(r, "piece", 0)) == Counter(i for i, _ in ODD)
    assert OPERATORS[name](frame(spark, []), labels).collect() == []
    assert len(OPERATORS[name](frame(spark, [(1, None), (2, None)]), labels.limit(0)).collect()) == 2


# Exact deduplication


def test_dedup_groups(spark):
    got = {r.doc_id: r for r in exact_dedup.assign(frame(spark, ODD)).collect() if r.doc_id is not None}
    assert (got[1].keep_id, got[1].group_size, got[1].kept) == (1, 2, True)
    assert (got[3].keep_id, got[3].kept) == (3, True)  # one space is not empty
    assert (got[4].kept, got[5].kept, got[5].keep_id, got[4].group_size) == (True, False, 4, 4)
    assert got[9].keep_id == 8
    assert got[4].text_sha256 == hashlib.sha256(b"one two").hexdigest()


def test_dedup_compares_texts_when_digests_collide(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 7}") for i in range(200)] + [(500, None)]
    got = exact_dedup.assign(frame(spark, rows), digest=lambda c: F.lit("same")).collect()
    assert {r.doc_id: r.keep_id for r in got} == {i: i % 7 if t else 500 for i, t in rows}


def test_dedup_keeps_one_row_of_repeats(spark):
    rows = exact_dedup.dedup(frame(spark, ODD)).collect()
    assert Counter(r.text for r in rows)["one two"] == 1
    rows = exact_dedup.dedup(frame(spark, [(3, "a"), (3, "a"), (3, "a"), (4, "a"), (5, "b")])).collect()
    assert sorted(r.doc_id for r in rows) == [3, 5]
    assert rows[0].__fields__ == ["doc_id", "text", "keep_id", "sequence_id", "score"]


# N-gram join


def linked_by_words(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed=0, groups=6, size=25):
    rng = np.random.default_rng(seed)
    rows, i = [(0, None), (1, "a b"), (2, "A  b"), (3, "c")], 10
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5000, 30 + 20 * g)]
        for _ in range(size):
            w = list(base)
            for k in rng.integers(0, len(w), rng.integers(0, 4)):
                w[k] = f"v{rng.integers(0, 50)}"
            rows.append((i, " ".join(w[: len(w) - int(rng.integers(0, 6))])))
            i += 1
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 3, "salts": 3, "block": 4}])
def test_components_match_all_pairs(spark, options):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(frame(spark, rows), **options).collect()}
    assert got == linked_by_words(rows)


def test_traversal_finds_every_possible_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 9)).astype(np.uint64)]) for _ in range(150)]
    bits, size = np.stack([ngram_join.bitmap(s) for s in sets]), np.array([len(s) for s in sets])
    group = np.repeat([3, 8], [100, 50])
    ids, component = np.arange(150), rng.integers(-5, 90, 150)
    found = {tuple(sorted(x)) for u, v in ngram_join.tree_pairs(group, np.zeros(150, int), ids, component, size, bits) for x in zip(u.tolist(), v.tolist(), strict=True)}
    for a in range(150):
        for b in range(a + 1, 150):
            o = len(np.intersect1d(sets[a], sets[b]))
            linked = 4 * o >= 3 * (len(sets[a]) + len(sets[b]) - o)
            if linked and group[a] == group[b] and component[a] != component[b]:
                assert (a, b) in found
    assert all(group[a] == group[b] and component[a] != component[b] for a, b in found)
    crossed = {tuple(sorted(x)) for u, v in ngram_join.tree_pairs(np.zeros(150, int), (ids % 2), ids, ids, size, bits) for x in zip(u.tolist(), v.tolist(), strict=True)}
    whole = {tuple(sorted(x)) for u, v in ngram_join.tree_pairs(np.zeros(150, int), np.zeros(150, int), ids, ids, size, bits) for x in zip(u.tolist(), v.tolist(), strict=True)}
    assert crossed == {x for x in whole if x[0] % 2 != x[1] % 2}


def test_thin_keeps_one_of_each_group(spark):
    rows = near_copies(1, 2, 10)
    kept = sorted(r.doc_id for r in ngram_join.thin(frame(spark, rows)).collect())
    assert kept == sorted(i for i, (_, c) in linked_by_words(rows).items() if i == c)


# Packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    entries = packing.plan(counts, 50)
    bins, ranks = {}, Counter()
    for length, rank, per, first, many, offset in entries.tolist():
        assert ranks[length] == rank
        ranks[length] += per * many
        for b in range(many):
            bins.setdefault(first + b, []).extend((offset + k * length, length) for k in range(per))
    assert ranks == Counter(counts)
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 50
    total = sum(n * c for n, c in counts.items())
    assert len(bins) <= max(2 * -(-total // 50), 0)


def test_packed_ids_match_the_tokenizer(spark):
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = {i: t or "" for i, t in ODD if i is not None} | {20: "I'm ok. don't, S.  x<|endoftext|>y <|ENDOFTEXT|> ÉCOLE. é, x̧, 12, $, ..,,"}
    rows = packing.pack_documents(frame(spark, list(texts.items()))).collect()
    ends = {}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece):
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(array("I", part).tobytes()) == r.ids_crc32
        assert sum(r.length for r in rows if r.doc_id == i) == len(ids)
    for r in rows:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in ends.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:], strict=False)) and sum(items[-1]) <= 4096


# Secrets


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


_PARTS = st.sampled_from(["password", "PASSWD", "api_key", "Apikey", "token", "secret", '"', "'", " ", ":", "=", "AKIA", "IOSFODNN7EXAMPLE", "0123456789abcdef", "deadbeef", "x", "é", "日", "\n", "ABC123", "+/_.=-"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PARTS, max_size=25).map("".join))
def test_base_spans_are_those_of_plain_search(text):
    got = secrets.find(text.encode())
    assert [s for s in got if s[0] in secrets.BASE] == plain_spans(text)


def test_checksummed_tokens():
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good = f"ghp_{body}{secrets.crc62(body.encode())}"
    assert secrets.find(f"é {good} x".encode()) == [("github", 2, 2 + len(good))]
    assert secrets.find(f"ghp_{body}000000".encode()) == []
    assert secrets.redacted(f"é {good}, password = hunter22 end".encode()) == "é [github], [assign] end"


def test_redact_keeps_rows_and_columns(spark):
    rows = secrets.redact(frame(spark, [(1, "token=abcdef0 x"), (2, None), (3, "")])).orderBy("doc_id").collect()
    assert [r.text for r in rows] == ["[assign] x", None, ""] and rows[0].keep_id == "x"


# Fertility


def test_base_counts():
    def repeats(words):
        n, seen, mark = len(words) - 7, Counter(), set()
        for k in range(n):
            seen[tuple(words[k : k + 8])] += 1
        for k in range(n):
            if seen[tuple(words[k : k + 8])] > 1:
                mark.update(range(k, k + 8))
        return len(mark)

    rng = np.random.default_rng(0)
    for _ in range(40):
        words = [b"%d" % x for x in rng.integers(0, 3, rng.integers(0, 60))] + [b"a"] * int(rng.integers(0, 12))
        assert fertility.repeated(words) == repeats(words)
    assert fertility.repeated_lines(b"a\n\na\nb\n \na") == 2


def test_fertility_rejects_strange_text(spark):
    clean = " ".join("the quick brown fox jumps over a lazy dog while many people walk along quiet streets every single morning before work".split())
    odd = " ".join(f"ᚠᚢ{chr(0x16A0 + i)}ᛟ" for i in range(40))
    got = {r.doc_id: r for r in fertility.measure(frame(spark, [(1, clean), (2, odd), (3, "x " * 300), (4, None)])).collect()}
    assert got[1].kept and not got[1].base_failed and got[1].word_chars == len(clean.replace(" ", ""))
    assert not got[3].kept and got[3].base_failed and not got[4].kept and got[4].n_words == 0
    assert got[2].byte_share > 0.5


def plain_counts(text):
    """The base columns of the fertility query, written plainly."""
    space = r"[\x20\x09-\x0d]+"
    words = [w for w in re.split(space, text or "") if w]
    seen = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    mark = {j for k in range(len(words) - 7) if seen[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if re.sub(space, "", x)]
    failed = len(words) < 20 or 100 * len(mark) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(mark), failed


def test_fertility_matches_plain_counts_and_bands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = frame(spark, [(10**6, None), (10**6 + 1, " \n"), (10**6 + 2, LONG), (10**6 + 2, LONG)]).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(1).alias("band"))
    docs = docs.select("doc_id", "text", "lang", F.lit(0).alias("band")).union(extra)
    texts = docs.toPandas()
    got = fertility.measure(docs, lang_col="lang").toPandas()
    assert sorted(got.doc_id) == sorted(texts.doc_id)
    sp, is_byte = fertility._pieces(fertility.VOCABULARIES[0])
    ranks = fertility._ranks(fertility.VOCABULARIES[1])
    by_id = dict(zip(texts.doc_id, texts.text, strict=True))
    for r in got.itertuples():
        text = by_id[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(text)
        words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        ids = [i for w in words for i in sp.encode(w)]
        assert r.n_tokens == len(ids) and r.chars_per_token == pytest.approx(r.word_chars / len(ids) if ids else 0)
        assert r.byte_share == pytest.approx(np.mean(is_byte[ids]) if ids else 0)
        n = np.array(list(Counter(ids).values())) / max(1, len(ids))
        assert r.token_entropy == pytest.approx(-(n * np.log2(n)).sum() if ids else 0, abs=1e-9)
        assert r.other_chars_per_token == pytest.approx(r.word_chars / sum(len(ranks.encode_ordinary(w)) for w in words) if words else 0)
    assert got[got.kept].base_failed.sum() == 0
    # The bands, from plain quartiles.
    got["share"] = got.token_entropy / np.log2(got.n_tokens.clip(lower=2))
    passed = got[~got.base_failed]
    for (band,), rows in passed.groupby(["band"]):
        ok = np.ones(len(rows), bool)
        for col, low, high in (("chars_per_token", True, True), ("other_chars_per_token", True, True), ("byte_share", False, True), ("share", True, False)):
            q1, q2, q3 = np.quantile(rows[col].round(3), [0.25, 0.5, 0.75])
            reach = 3 * max(q3 - q1, 0.01 * q2) + 0.0005
            ok &= (rows[col] >= q1 - reach).to_numpy() | (not low)
            ok &= (not high) | (rows[col] <= max(q3 + reach, 0.05 if col == "byte_share" else 0)).to_numpy()
        assert ok.tolist() == rows.kept.tolist(), band


def test_fertility_rejects_junk_of_a_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    got = fertility.measure(docs, lang_col="lang").join(labels, F.col("doc_id") == F.col("id")).filter("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 0.8 * (n[0, False] + n.get((0, True), 0)) and n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0))


# Pieces


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcdeinrst  ▁\n\té好ü🎉①́\xa0.,012<>|日本語кир"), max_size=50), max_size=6))
def test_pieces_are_those_of_the_library(texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.VOCABULARY))
    codec = pieces.codec()
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(text)
        assert codec.decode(ids) == sp.decode(ids.tolist())


def test_encode_and_decode_frames(spark):
    docs = frame(spark, [(1, "hello world\nagain"), (2, None), (3, "日本 🎉")])
    back = pieces.decode(pieces.encode(docs)).collect()
    assert {r.doc_id: r.text for r in back} == {1: "hello world\nagain", 2: "", 3: "日本 🎉"}
    assert all(r.round_trip for r in pieces.digests(docs).collect())


# Language model


def test_base_scores_and_normalised_model(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["der", "die", "Das", "und"] if i % 2 else ["the", "and", "of", "a"], rng.integers(0, 30)))) for i in range(120)] + [(500, None)]
    got = hmm.score(frame(spark, rows), states=3).collect()
    counts, words = Counter(), {}
    for i, t in rows:
        words[i] = (t or "").lower().split() + [None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words[i])
    n, v = sum(counts.values()), len(counts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.train_tokens == n and r.n_tokens == len(words[r.doc_id])
        assert r.n_known == sum(counts[w] > 0 for w in words[r.doc_id])
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in words[r.doc_id]))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_expected_counts_and_forward_match_brute_force():
    rng = np.random.default_rng(3)
    k, classes = 3, hmm._CLASSES
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.r_[rng.dirichlet(np.ones(classes), k).T, np.ones((1, k))])
    seqs = [np.array(x) for x in ([5, 7, 5], [9], [1, 2, 3, 4, 1])]
    emit, moves, starts = np.zeros((classes, k)), np.zeros((k, k)), np.zeros(k)
    for s, got in zip(seqs, hmm.forward(model, seqs), strict=True):
        paths = {p: model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:], strict=False)]) * np.prod([model.emit[c, z] for c, z in zip(s, p, strict=True)]) for p in itertools.product(range(k), repeat=len(s))}
        total = sum(paths.values())
        assert got == pytest.approx(log10(total))
        for p, w in paths.items():
            starts[p[0]] += w / total
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w / total
            for c, z in zip(s, p, strict=True):
                emit[c, z] += w / total
    whole = sum(hmm.forward(model, seqs)) / log10(np.e)
    for window in (1, 2, 3, 6):
        for chunk in (1, 2, 100):
            got = hmm.expected(model, *hmm.cut(seqs, window=window), chunk)
            for x, want in zip(got, (starts, moves, emit, whole), strict=True):
                assert np.allclose(x, want, atol=1e-4, rtol=1e-4), (window, chunk)


def test_counts_of_long_documents_do_not_depend_on_windows():
    rng = np.random.default_rng(4)
    k = 4
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(0.2 * np.ones(k), k), np.r_[rng.dirichlet(0.1 * np.ones(hmm._CLASSES), k).T + 1e-7, np.ones((1, k))])
    seqs = [rng.integers(0, hmm._CLASSES, n) for n in (3000, 1, 64, 65, 1500, 700)]
    whole = [sum(x) for x in zip(*(hmm.expected(model, s[None, :]) for s in seqs), strict=True)]
    parts = [sum(x) for x in zip(*(hmm.expected(model, *b) for b in hmm.batched(seqs)), strict=True)]
    assert whole[1].sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-3) and whole[0].sum() == pytest.approx(len(seqs), rel=1e-3)
    for x, y in zip(whole, parts, strict=True):
        assert np.allclose(x, y, rtol=2e-3, atol=2e-3)


def test_forward_vectors_are_kept_and_computed_once(monkeypatch):
    rng = np.random.default_rng(8)
    k, through = 5, []
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.r_[rng.dirichlet(np.ones(hmm._CLASSES), k).T, np.ones((1, k))])
    seqs = [rng.integers(0, hmm._CLASSES, n) for n in (400, 33, 32, 170, 1)]
    forward = hmm._forward
    monkeypatch.setattr(hmm, "_forward", lambda *x: through.append(1) or forward(*x))
    want = hmm.expected(model, *hmm.cut(seqs))
    assert len(through) == 13  # the windows of the longest; all were computed twice
    for steps in (1, 7, 32):
        for kept in (1, 100, 250, 1000):  # what is not kept is computed again
            for x, y in zip(hmm.expected(model, *hmm.cut(seqs, window=steps), kept=kept), want, strict=True):
                assert np.allclose(x, y, rtol=1e-4, atol=1e-4), (steps, kept)


def test_hmm_training_does_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["der", "die", "das"] if i % 2 else ["the", "and", "of"], 12))) for i in range(1200)]
    one, other = ({r.doc_id: r.score for r in hmm.score(frame(spark, rows).repartition(n), states=3, rounds=4).collect()} for n in (1, 7))
    assert one == pytest.approx(other, rel=1e-3)


# Classifiers


def test_quality_model_matches_plain_algebra(spark):
    """Ridge and kernel against numpy on all rows at once."""
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(400, d))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    rows = spark.createDataFrame([(bytearray(a.tobytes()), float(b)) for a, b in zip(x, y, strict=True)], "stats binary, y double").repartition(3)
    model = quality.train(rows, features=60)
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, x.std(0))
    z = np.c_[np.ones(400), np.sqrt(2 / 60) * np.cos(np.clip((x - x.mean(0)) / x.std(0), -6, 6) @ model.w + model.b)]
    assert np.allclose(model.features(x), z)
    weight = np.where(y > 0, 200 / y.sum(), 200 / (400 - y.sum()))
    penalty = quality.RIDGE * 400 * np.diag(np.r_[1e-9, np.full(60, 1 / 60)])
    beta = np.linalg.solve(z.T @ (weight[:, None] * z) + penalty, z.T @ (weight * y))
    assert np.allclose(model.beta, beta, rtol=1e-6, atol=1e-8)
    many = quality.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, 20000)) / np.sqrt(2.0 * d), rng.uniform(0, 2 * np.pi, 20000), np.zeros(0), (np.zeros(1), np.zeros(1)))
    f = many.features(x[:20])[:, 1:]
    kernel = np.exp(-((x[:20, None] - x[None, :20]) ** 2).sum(-1) / (4 * d))
    assert np.abs(f @ f.T - kernel).max() < 0.05
    scores = model.score(x)
    assert np.all((scores >= 0) & (scores <= 1)) and ((scores > 0.5) == (y > 0)).mean() > 0.85


def test_isotonic_is_monotone_and_pools():
    x, y = isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 0, 1.0]), np.ones(6))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1


def corpus(kind):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(25, 60))]
        bad = i % 3 == 0
        if bad and kind == "quality":
            words = [w.upper() + "!!" for w in words]
        if bad and kind == "toxic":
            w = ["stupid", "idiot"][i % 2]
            words.insert(int(rng.integers(0, len(words))), [w, ".".join(w), w.replace("i", "1"), " ".join(w), w.replace("i", "iiii")][i % 5])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(spark, kind):
    rows, labels = corpus(kind)
    truth = {i: (q if kind == "quality" else t) for i, q, t in labels}
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    run = quality.classify if kind == "quality" else toxicity.classify
    got = run(frame(spark, rows), table).collect()
    divisor, remainder = (4, 2) if kind == "quality" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % divisor == remainder) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    if kind == "toxic":
        kept = {r.doc_id for r in toxicity.clean(frame(spark, rows), table).collect()}
        assert kept == {r.doc_id for r in got if not r.predicted}


def test_readings_restore_words():
    r = toxicity.Restorer(toxicity.letter_costs(toxicity.letter_counts([b"stupid idiot the of and stupid idiot"] * 50)))
    for w in ("stup1d", "s.t.u.p.i.d", "stuuuupid", "$tupid", "st*pid", "s-t-u-p-1-d"):
        assert "stupid" in r.readings(w), w
    assert r.readings("plain.") == ["plain"]
    assert toxicity.spaced("x s t u p i d, yy".split()) == ["xstupid,", "stupid,", "xstupi"]


def test_runs_of_short_tokens_are_cut_into_words():
    r = toxicity.Restorer(toxicity.letter_costs(toxicity.letter_counts([b"you are an idiot and a fool the ass of them you idiot"] * 50)))

    def found(text):
        return {w for x in r.words(text) for w in x}

    for text, word in (("y o u i d i o t", "idiot"), ("a s s", "ass"), ("the id iot and", "idiot"), ('"i d i o t', "idiot"), ("y o u a r e a n 1 d i o t!", "idiot"), ("- y o u i d i o t!!!!!!", "idiot")):
        assert word in found(text), text


def test_marks_at_the_ends_of_words_may_be_letters():
    r = toxicity.Restorer(toxicity.letter_costs(toxicity.letter_counts([b"clown trash ass fool the of and idiot shit"] * 50)))
    for w, word in (("(lown", "clown"), ("+rash", "trash"), ("a$$", "ass"), ("f***", "fool"), ("idio+", "idiot"), ("shi+!", "shit"), ("<lown,", "clown")):
        assert word in r.readings(w), (w, r.readings(w))
    assert "clown" in r.readings("(clown)") and "fool" in r.readings("fool!")
    assert r.readings("plain.") == ["plain"]


def all_readings(r, columns):
    """The cheapest cost of every text of a lattice, by trying every path."""
    best = {}
    for path in itertools.product(*[c or [("", 0, 0.0), (" ", 0, 0.0)] for c in columns]):
        key, cost, text = 0, 0.0, ""
        for letter, f, c in path:
            if letter == " ":
                cost, key, text = cost + r.costs[key * 27], 0, text + " "
            elif letter:
                cost, key, text = cost + c + r.costs[key * 27 + f], key % 729 * 27 + f, text + letter
            else:
                cost += c
        cost += r.costs[key * 27]
        best[text] = min(best.get(text, cost), cost)
    return best


def test_decoding_is_exact():
    rng = np.random.default_rng(3)
    r = toxicity.Restorer(toxicity.letter_costs(toxicity.letter_counts([b"a stout idiot is not so bright as it sets about the east"] * 20)))
    for _ in range(150):
        word = "".join(rng.choice(list("abeiorst01345$|!.*@t-"), rng.integers(2, 7)))
        if word.count("*") > 2:
            continue
        for masked in (False, True):
            columns = r.lattice(word, masked)
            want, got = all_readings(r, columns), r.search(columns, 3)
            assert abs(want[got[0]] - min(want.values())) < 1e-9
            if not any(len(c) >= 26 for c in columns):
                assert np.allclose([want[x] for x in got], sorted(want.values())[:3])
    columns = r.lattice("1d") + [[]] + r.lattice("10") + [[]] + r.lattice("t")
    assert r.search(columns, 1) == [min(all_readings(r, columns).items(), key=lambda x: x[1])[0]]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (3, 0, 1)], [(1, 1, 0), (3, 1, 0)], [(None, None, None)]])
def test_without_both_classes_nothing_is_toxic(spark, labels):
    docs = frame(spark, [(1, "you idiot"), (2, None), (3, "fine words"), (3, "fine words"), (None, " ")])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.classify(docs, table).collect()} == {(0.0, 0)}
    assert toxicity.clean(docs, table).count() == 5


def test_long_words_and_runs_are_read_whole():
    r = toxicity.Restorer(toxicity.letter_costs(toxicity.letter_counts([b"you idiot and a fool"] * 50)))
    assert "idiot" in {x for y in r.words("q " * 500 + "zzz y o u i d i o t") for x in y}
    assert any("idiot" in x for x in r.readings("z" * 100 + "1d10t"))


def test_single_windows_and_rounds_over_all_blocks(spark):
    rng = np.random.default_rng(6)
    k = 3
    model = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), np.r_[rng.dirichlet(np.ones(hmm._CLASSES), k).T, np.ones((1, k))])
    seqs = [rng.integers(0, hmm._CLASSES, n) for n in (200, 31, 90)]
    want = hmm.expected(model, *hmm.cut(seqs))
    for wide in (1, 2):  # one window at a time could not be written to
        for x, y in zip(hmm.expected(model, *hmm.cut(seqs), wide), want, strict=True):
            assert np.allclose(x, y, rtol=1e-3, atol=1e-3)
    rows = [(i, " ".join(rng.choice(["der", "die", "das"] if i % 2 else ["the", "and", "of"], 12))) for i in range(600)]
    one, more = ([r.score for r in hmm.score(frame(spark, rows), states=3, rounds=n).orderBy("doc_id").collect()] for n in (1, 4))
    assert sum(more) > sum(one)


def test_pairs_seen_are_held_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(8)
    u, v = rng.integers(-9, 9, 4000), rng.integers(-9, 9, 4000)
    seen, got = ngram_join.Seen(), []
    for k in range(0, 4000, 500):
        got += zip(*(x.tolist() for x in seen.fresh(u[k : k + 500], v[k : k + 500])), strict=True)
    assert len(got) == len(set(got)) and set(got) == set(zip(u.tolist(), v.tolist(), strict=True))
    few, got = ngram_join.Seen(50), set()
    for k in range(0, 4000, 500):
        got |= set(zip(*(x.tolist() for x in few.fresh(u[k : k + 500], v[k : k + 500])), strict=True))
    assert got == set(zip(u.tolist(), v.tolist(), strict=True))
    tracemalloc.start()
    seen = ngram_join.Seen()
    for k in range(5):
        seen.fresh(np.arange(200_000), np.full(200_000, k))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(seen.u) == 1_000_000 and held < 32 << 20


def test_large_sets_that_share_a_passage_are_told_apart_before_their_sets_are_sent(spark, monkeypatch):
    """Bitmaps of one width are full for them; near copies among them are still linked."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 5000 + 150 * (i % 4)))) for i in range(12)]
    rows += [(20, rows[3][1] + " one more end"), (21, rows[4][1].replace("p5", "q5"))]
    asked, was = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda docs, i, t, seed, pairs, owners, **more: asked.append(pairs.count()) or was(docs, i, t, seed, pairs, owners, **more))
    got = {r.doc_id: r.component_id for r in ngram_join.components(frame(spark, rows)).collect()}
    assert got == {i: i for i in range(12)} | {20: 3, 21: 4}
    assert sum(asked) == 2


def test_wide_bitmaps_never_rule_out_a_common_shingle():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 9000, np.uint64)
    for n, m in ((2050, 2500), (4000, 5000), (4096, 4097), (8000, 6100)):
        x, y = np.sort(pool[:n]), np.sort(pool[9000 - m :])
        a, b = ngram_join.wide_bitmap(x), ngram_join.wide_bitmap(y)
        assert len(np.intersect1d(x, y)) <= ngram_join.most_common(a, n, b, m) <= min(n, m)
        assert ngram_join.most_common(a, n, ngram_join.wide_bitmap(x[1:]), n - 1) == n - 1
    assert ngram_join.wide_bitmap(pool[:2048]) is None


def test_words_are_hashed_together_and_counted_beyond_the_dictionary(spark, monkeypatch):
    words = [b"a", b"xyz" * 30, "é日本".encode(), b"!"]
    ids, classes = hmm.hashed(words)
    assert ids.tolist() == [hmm.word_id(w) for w in words] and classes.tolist() == [hmm.shared_class(w) for w in words]
    assert [len(x) for x in hmm.hashed([])] == [0, 0]
    monkeypatch.setattr(hmm, "DICTIONARY", 100)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" + "y" * (70 * (x % 5 == 0)) for x in rng.zipf(1.3, rng.integers(0, 60)) % 5000)) for i in range(300)] + [(900, None)]
    counts, texts = Counter(), {i: (t or "").split() + [None] for i, t in rows}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(t)
    for r in hmm.score(frame(spark, rows), states=3, rounds=1).collect():
        assert r.n_known == sum(counts[w] > 0 for w in texts[r.doc_id]) and r.n_tokens == len(texts[r.doc_id])
        assert r.base_score == pytest.approx(sum(log10((counts[w] + 1) / (sum(counts.values()) + len(counts) + 1)) for w in texts[r.doc_id]))


def test_only_what_can_be_evidence_is_decoded(monkeypatch):
    """Words and runs that no feature can come from are not decoded; scores are those of decoding all."""
    costs = toxicity.letter_costs(toxicity.letter_counts([b"you are an idiot and a clown the ass of them stupid trash"] * 50))
    weights = {"idiot": 4.0, "^idio": 3.0, "ass": 2.5, "^clow": 2.0, "^clown": 3.5, "^stupidit": 2.0, "bäd": 1.5, "^" + "trash": 2.25, "a" * 20: 1.25}
    beta, reader = np.array([-3.0, 1.0, -0.1]), toxicity.Restorer(costs)

    def strongest(readings):
        return max((weights.get(f, 0.0) for f in toxicity.features(readings)), default=0.0)

    def plainly(text):
        words = text.lower().split()
        found = [strongest(reader.readings(w)) for w in (*set(words), *toxicity.spaced(words))] + [strongest(reader.run(x)) for x in toxicity.short_runs(words)]
        hits = [x for x in found if x]
        p = 1 / (1 + np.exp(-toxicity.summary(hits, len(set(words))) @ beta))
        return (p if hits else p / 2), len(hits)

    rng = np.random.default_rng(8)
    bad = ["idiot", "1d10t", "id iot", "i d i o t", "y o u i d i o t", "'i d i o t!", "(lown", "clówn", "cloown!", "$tupidity", "a$$", "a s s", "bäd", "bäd", "tras#", "x" * 70 + "1diot", "a" * 20, "a " * 20, ".......ass......." * 5]
    letters = list("abcdiloostuwnä1035$|(!.,*#'\u0301\u200b\u0430")
    texts = []
    for k in range(300):
        words = ["".join(rng.choice(letters, rng.integers(1, 10))) for _ in range(12)] + ["of", "the", "an"]
        words.insert(int(rng.integers(0, 12)), bad[k % len(bad)])
        rng.shuffle(words)
        texts.append(" ".join(w for w in words if w.count("*") + w.count("#") < 4))
    want = [plainly(x) for x in texts]
    for most in (600_000, 60):  # also where little is remembered
        scorer = toxicity.Scorer(costs, weights, beta, most)
        for _ in range(2):
            assert np.allclose([scorer.score(x) for x in texts], [p for p, _ in want], rtol=1e-12)
    assert 100 < sum(n > 0 for _, n in want)

    calls, search = [], toxicity.Restorer.search
    monkeypatch.setattr(toxicity.Restorer, "search", lambda self, columns, best: calls.append(columns) or search(self, columns, best))
    scorer = toxicity.Scorer(costs, weights, beta)
    scorer.score("w0rd5 pr1ce$ l33t, (lumsy gr8!! x-y-z of!! the o f t h e m niño$ " + "h*t " + "zzz000 " * 3)
    assert not calls
    assert scorer.score("1d10t") > 0.5 and len(calls) == 1
