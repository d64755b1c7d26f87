from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from engramspark.operators import cells as C
from engramspark.operators import retrieval as R

CELLS = "session_id string, cell_seq long, cell_id string, keywords array<string>, entities array<string>, raw_text string, timestamp_start string"


def cells(spark, rows):
    return spark.createDataFrame([("s", k + 1, i, kw, e, t, None) for k, (i, kw, e, t) in enumerate(rows)], CELLS)


def ask(spark, text):
    return spark.createDataFrame([(1, text)], "query_id long, query string")


def scores(spark, rows, text, **options):
    return {r.cell_id: r.score for r in R.bm25(ask(spark, text), cells(spark, rows), **options).collect()}


MARLEY = [("C_001", ["jon", "dance"], [], "Jon likes dance very much and dance is his life"), ("C_002", ["marley", "flooring"], [], "The studio has Marley flooring"), ("C_003", ["jon", "dance"], [], "Jon loves dance")]


def test_bm25_values(spark):
    assert scores(spark, [("C_001", ["budget", "project", "q3"], [], "")], "budget") == {"C_001": pytest.approx(log(0.5 / 1.5 + 1), abs=1e-6)}
    assert scores(spark, MARLEY, "Marley flooring studio") == {"C_002": 3.958967}
    assert scores(spark, MARLEY, "Marley flooring studio", doc_fields="keywords") == {"C_002": 1.961659}
    two = [("C_001", ["budget"], ["budget"], None), ("C_002", ["budget"], ["budget"], None)]
    assert scores(spark, two, "budget", doc_fields="keywords") == {"C_001": 0.332322, "C_002": 0.332322}
    assert scores(spark, [("C_001", ["project"], ["budget"], "")], "budget constraints") == {"C_001": 0.15}
    assert scores(spark, [("C_001", ["birthday"], [], "my 18th birthday.")], "How long ago was the birthday?")["C_001"] > 0
    assert scores(spark, [("C_001", ["caroline"], [], "")], "How long ago was the?") == {}
    short_long = scores(spark, [("C_001", ["budget"], [], "a"), ("C_002", ["budget"], [], "a " * 40)], "budget")
    assert short_long["C_001"] > short_long["C_002"]


def test_ranks_and_thresholds(spark):
    rows = spark.createDataFrame([("s", 1, f"c{k:02d}", k, 1.0) for k in range(1, 61)], "session_id string, query_id long, cell_id string, rank long, score double")
    fused = {r.cell_id: r.rrf for r in R.fuse([rows]).collect()}
    assert fused["c01"] == pytest.approx(1 / 61, abs=1e-9) and fused["c06"] > 0.015 > fused["c07"]
    both = {r.cell_id: r.rrf for r in R.fuse([rows, rows]).collect()}
    assert min(v for k, v in both.items() if k <= "c50") > 0.015


@pytest.mark.parametrize(("n", "want"), [(0, (2, 3)), (9, (2, 3)), (12, (2, 4)), (15, (2, 5)), (18, (2, 6)), (20, (2, 6)), (24, (2, 8)), (30, (3, 8)), (40, (4, 8)), (50, (5, 8)), (500, (5, 8))])
def test_bounds(spark, n, want):
    assert tuple(spark.range(1).select(*R.bounds(F.lit(n))).first()) == want


def test_select_fills_up_and_cuts(spark):
    rows = spark.createDataFrame([("s", 1, f"c{k}", k, 0.5) for k in range(1, 9)] + [("t", 1, f"c{k}", k, 0.5) for k in range(90, 93)], "session_id string, query_id long, cell_id string, rank long, score double")
    got = R.select(R.fuse([rows]), spark.createDataFrame([("s", 12), ("t", 30)], "session_id string, n_cells long")).groupBy("session_id").count().collect()
    assert {r.session_id: r["count"] for r in got} == {"s": 4, "t": 3}


def test_neighbours(spark):
    v = spark.createDataFrame([(1, 1, [1.0] * 1024), (1, 2, [0.0] * 1024), (2, 3, [1.0] * 1024)], "session_id long, cell_id long, embedding array<float>")
    q = spark.createDataFrame([(1, 7, [1.0] * 1024)], "session_id long, query_id long, embedding array<float>")
    assert [(r.cell_id, r.distance) for r in R.knn(q, v, 5).orderBy("rank").collect()] == [(1, 0.0), (2, sqrt(1024))]
    assert [r.cell_id for r in R.vector_route(q, v).collect()] == [1]
    assert R.knn(q.limit(0), v, 5).collect() == []
    texts = spark.createDataFrame([("a", "x", [1.0, 2.0]), ("a", "y", None), ("b", "z", [0.0, 0.0])], "session_id string, cell_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [0.0, 0.0]), ("r", None)], "query_id string, embedding array<float>")
    assert sorted((r.session_id, r.query_id, r.cell_id) for r in R.knn(asked, texts, 3).collect()) == [("a", "q", "x"), ("b", "q", "z")]


def test_query_blocks_give_the_same(spark, monkeypatch):
    v = spark.createDataFrame([(i % 2, i, [float(i * k % 7) for k in range(4)]) for i in range(60)], "session_id long, cell_id long, embedding array<float>")
    q = v.withColumnRenamed("cell_id", "query_id")
    one = sorted(map(tuple, R.knn(q, v, 3).collect()))
    monkeypatch.setattr(R, "BLOCK", 7)
    assert sorted(map(tuple, R.knn(q, v, 3).collect())) == one


def test_expansion_brings_cells_of_shared_entities(spark):
    generic = [(f"C_G{k}", ["jon"], [], "Jon likes many things in life i.") for k in range(4)]
    rows = cells(spark, [*generic, ("C_HIT", ["jon", "studio"], ["Jon", "dance studio"], "Jon opened a dance studio."), ("C_SPEC", ["flooring"], ["dance studio"], "The dance studio has Marley flooring.")])
    got = {r.cell_id for r in R.retrieve(ask(spark, "studio"), rows).collect()}
    assert {"C_HIT", "C_SPEC"} <= got and len([c for c in got if c.startswith("C_G")]) <= 2


def test_order_and_prompt(spark):
    c = spark.createDataFrame([("s", 1, "late", [], [], "L", "2026-04-14T12:00:00Z"), ("s", 2, "early", [], [], "E", "2026-04-14T10:00:00Z"), ("s", 3, "never", [], [], "N", None)], CELLS)
    a = spark.createDataFrame([("s", 1, x, k) for k, x in enumerate(("never", "late", "early"))], "session_id string, query_id long, cell_id string, activation long")
    assert [r.cell_id for r in R.ordered(a, c).orderBy("position").collect()] == ["early", "late", "never"]
    none = F.lit(None).cast("string")
    row = spark.range(1).select(R.stamped(F.lit("a"), F.lit("b"), F.lit("T")), R.stamped(F.lit("a"), none, F.lit("T")), R.stamped(none, none, F.lit("T")), R.prompt(F.lit("M"), F.array(F.lit("H")), F.array(F.lit("C")), F.lit("q")), R.prompt(none, F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(""))).first()
    assert tuple(row) == ("[a - b]\nT", "[a - unknown]\nT", "T", "M\n\nH\n\nC\n\nq", "")


def test_exact_scan(spark):
    rows = cells(spark, [("C_001", ["budget plan"], [], ""), ("C_002", [], [], "")]).withColumn("summary", F.lit("the plan"))
    assert {r.cell_id: r.score for r in R.exact_scan(ask(spark, "budget plan"), rows).collect()} == {"C_001": 1.0, "C_002": 0.5}


def test_storage(spark):
    c = cells(spark, [("c1", [], ["budget", "team", "team"], "x"), ("c2", [], ["timeline", "team"], None)])
    assert sorted(r.cell_id for r in C.find_by_entity(c, "team").collect()) == ["c1", "c2"]
    assert C.find_by_entity(c, "Team").collect() == []
    assert C.entity_links(c).count() == 4
    assert [(r.a, r.b, r.n) for r in C.cooccurring(C.entity_links(c)).orderBy("a").collect()] == [("budget", "team", 1), ("team", "timeline", 1)]
    assert [r.cell_id for r in C.session_scan(c, 1).collect()] == ["c1"]
    assert C.deleted(c, spark.createDataFrame([("s",)], "session_id string"), ["session_id"]).count() == 0
    assert {r.cell_id: r.raw_text for r in C.hydrated(c.drop("raw_text"), c.filter("cell_id = 'c1'")).collect()} == {"c1": "x", "c2": ""}
    up = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "one")], "k string, seq long, v string")
    assert sorted(r.v for r in C.upserted(up, ["k"], "seq").collect()) == ["new", "one"]


def test_metas(spark):
    rows = spark.createDataFrame([("s", 1, 1, "C_001", "A", ["k1", "k2"], ["e1"]), ("s", 2, 2, "C_002", "", ["k2"], []), ("s", 2, 3, "C_003", "C", ["k3", "k2"], ["e2"])], "session_id string, flush_id long, cell_seq long, cell_id string, summary string, keywords array<string>, entities array<string>")
    got = C.meta_versions(rows).orderBy("version").collect()
    assert [(r.meta_id, r.status, r.linked_cells, r.raw_text, r.keywords, r.entities) for r in got] == [("M_001", "archived", ["C_001"], "A", ["k1", "k2"], ["e1"]), ("M_002", "active", ["C_001", "C_002", "C_003"], "A C", ["k2", "k3"], ["e2"])]
    with pytest.raises(ValueError, match="needs cells"):
        C.digests_of(rows.limit(0))
    assert [r.version for r in C.active_meta(C.meta_versions(rows)).collect()] == [2]


def test_extraction_replies(spark):
    rows = spark.createDataFrame([("s", 1, "alpha beta alpha", '{"summary": "S", "keywords": ["k"], "cell_type": "task", "confidence": 0.9}'), ("s", 2, "alpha beta alpha", "sorry"), ("s", 3, "x", '{"summary": "", "cell_type": "odd", "confidence": "high"}')], "session_id string, cell_id long, t string, reply string")
    got = C.from_replies(C.with_fallbacks(rows, "t", ["session_id", "cell_id"]), "reply").orderBy("cell_id").collect()
    assert (got[0].summary, got[0].keywords, got[0].cell_type, got[0].confidence) == ("S", ["k"], "task", 0.9)
    assert (got[1].summary, got[1].keywords, got[1].cell_type, got[1].confidence) == ("alpha beta alpha", ["alpha", "beta"], "fact", 0.3)
    assert (got[2].summary, got[2].cell_type, got[2].confidence) == ("x", "fact", 0.5)
