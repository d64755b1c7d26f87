"""The pipeline against a brute-force version over what its trained stage kept, and each stage on odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engramspark.llm import queries

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    clean = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    low = {}
    for r in clean.collect():
        key = " ".join(x for x in re.split(r"[\x20\x09-\x0d]+", r.text))
        low[key] = min(low.get(key, r.doc_id), r.doc_id)
    single = corpus_pipeline.drop_copies(spark, clean, SF)
    assert {r.doc_id for r in single.collect()} == set(low.values()) and single.columns == docs.columns
    thin = corpus_pipeline.drop_near_copies(spark, single, SF).cache()
    sets = {r.doc_id: shingles(r.text) for r in single.collect()}
    lowest = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        if all(lowest[lowest[i]] == lowest[i] for i in sets):
            break
    assert thin.columns == docs.columns and {r.doc_id for r in thin.collect()} == {i for i in sets if lowest[i] == i}
    redacted = corpus_pipeline.redact_secrets(spark, thin, SF)
    assert redacted.columns == docs.columns and redacted.count() == thin.count()
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in thin.select("doc_id").collect()}


ODD = "doc_id long, text string, lang string, w_digest string, w_salt int, xd_mask long, cls long, nj_kept long, n long, u string, sketch string, score double, piece int"
WORDS = "one two three four five six seven eight nine ten"
ROWS = [(1, WORDS), (2, WORDS), (2, WORDS), (3, None), (4, ""), (5, " \n\t"), (None, "lone words here"), (None, None), (6, "password: hunter2hunter2"), (7, "token=abcdefgh " * 3000)]
#: Ids that stay, by stage.
WANT = {
    "toxicity": [1, 2, 2, 3, 4, 5, 6, 7, None, None],  # nothing is toxic
    "exact_dedup": [1, 3, 5, 6, 7, None],  # of null and empty text the smallest id
    "ngram_join": [1, 3, 4, 5, 6, 7, None, None],  # rows without words stay
    "secret_scans": [1, 2, 2, 3, 4, 5, 6, 7, None, None],
}


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, "a", 1, 2, 3, 4, 5, "b", "c", 0.5, 6) for i, t in rows], ODD)


@pytest.mark.parametrize("stage", list(STAGES))
def test_odd_rows_at_each_stage(spark, stage):
    docs = odd(spark, ROWS)
    got = STAGES[stage](spark, docs, SF)
    if stage == "packing":
        rows = got.collect()
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None} and sum(r.doc_id == 2 for r in rows) == 2
        assert sum(r.length for r in rows if r.doc_id == 4) == 1
    else:
        assert got.columns == docs.columns
        ids = sorted((r.doc_id for r in got.collect()), key=lambda x: (x is None, x))
        assert ids == WANT[stage]
        if stage == "secret_scans":
            texts = {r.doc_id: r.text for r in got.filter("doc_id >= 6 OR doc_id = 3").collect()}
            assert texts[3] is None and "hunter2" not in texts[6] and "abcdefgh" not in texts[7]
    empty = STAGES[stage](spark, odd(spark, []), SF)
    assert empty.count() == 0


def test_stages_take_any_order_of_columns_and_types(spark):
    docs = odd(spark, ROWS[:3]).select(F.array("u").alias("list"), "text", "doc_id")
    for name in ("toxicity", "exact_dedup", "secret_scans"):
        assert STAGES[name](spark, docs, SF).columns == docs.columns


def test_registered():
    assert [sum(name.startswith(f"op{n}_") for name in queries.QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(queries.ORACLE) <= set(queries.QUERIES)
