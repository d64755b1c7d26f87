import json

from pyspark.sql import functions as F

from engramspark.api import TURNS, MemoryEngine
from engramspark.config import BufferConfig
from engramspark.runner import main


def fill(spark, path, **options):
    engine = MemoryEngine(spark, str(path), BufferConfig(soft=40, hard=120), **options)
    lines = ["we plan the budget for spring", "the budget is small", "the studio has new flooring", "marley flooring is soft", "the dance class begins", "see you", "bye"]
    rows = [(s, i, "user", f"{t} {s}", f"2026-04-14T10:0{i}:00Z") for s in ("s1", "s2") for i, t in enumerate(lines)]
    engine.add_turns(spark.createDataFrame(rows, TURNS))
    return engine


def test_engine(spark, tmp_path):
    engine = fill(spark, tmp_path / "m")
    engine.add_turn("s1", "assistant", "good night", None)
    engine.add_turn("s3", "user", "hello", None)
    assert engine.turns().count() == 16 and engine.turns().filter("session_id = 's1'").agg(F.max("turn_idx")).first()[0] == 7
    cells = engine.cells().filter("session_id = 's1'").collect()
    assert len(cells) >= 1 and all(c.cell_type == "fragmented" and c.token_count >= 120 for c in cells)
    queries = spark.createDataFrame([("s1", 1, "marley flooring"), ("s2", 2, "budget"), ("s3", 3, "anything")], "session_id string, query_id long, query string")
    got = {r.query_id: r for r in engine.retrieve_context(queries, spark.createDataFrame([("s3", 0, None, "extra")], "session_id string, turn_idx long, role string, content string")).collect()}
    assert "marley flooring" in got[1].prompt and got[1].prompt.startswith(got[1].meta) and got[1].prompt.endswith("\n\nmarley flooring")
    assert got[1].cell_texts[0].startswith("[2026-04-14T10:00:00Z - 2026-04-14T10:0")
    assert got[3].prompt == "[user]: hello\n\n[user]: extra\n\nanything"
    rows = engine.evaluate(queries).collect()
    assert len(rows) == 3 and all(r.baseline_tokens > 0 for r in rows)
    engine.delete_sessions(queries.filter("session_id = 's1'"))
    assert engine.cells().filter("session_id = 's1'").count() == 0 and engine.metas().filter("session_id = 's1'").count() == 0
    assert engine.cells().filter("session_id = 's2'").count() > 0
    engine.add_turn("s1", "user", "back again")
    assert [(r.turn_idx, r.content) for r in engine.turns().filter("session_id = 's1'").collect()] == [(0, "back again")]


def models():
    class Model:
        """Stands for a service; what it was asked is told by its replies."""

        def chat(self, messages, **options):
            task, text = messages[0]["content"], messages[-1]["content"]
            if task.startswith("Describe"):
                return json.dumps({"summary": f"S {len(text)}", "keywords": ["kept"], "entities": ["e1"], "cell_type": "task", "confidence": 0.8})
            if task.startswith("Rewrite"):
                return "flooring of the studio, please" if "Question: it" in text else ""
            return "0.5" if task.startswith("Grade") else "an answer"

        def embed(self, texts):
            return [[float("flooring" in t), float("budget" in t)] for t in texts]

    def embed(rows, text, vector):
        from engramspark.seams import embed_column

        return embed_column(rows, text, vector, Model)

    return Model, embed


def test_engine_with_models_and_store(spark, tmp_path):
    Model, embed = models()  # noqa: N806
    engine = fill(spark, tmp_path / "m", client=Model, embed=embed)
    before = {(r.session_id, r.cell_id): (r.summary, r.cell_type, r.confidence) for r in engine.cells().collect()}
    engine.save()
    assert before and engine.tables["cells"].read().count() == len(before) == engine.tables["vectors"].read().count()
    engine.client = None
    assert {(r.session_id, r.cell_id): (r.summary, r.cell_type, r.confidence) for r in engine.cells().collect()} == before
    assert engine.tables["metas"].read().filter("status = 'active'").count() == 2
    assert engine.cell(spark.createDataFrame([("s1", "C_001")], "session_id string, cell_id string")).count() == 1
    engine.client = Model
    queries = spark.createDataFrame([("s1", 1, "it?", "soft")], "session_id string, query_id long, query string, answer string")
    assert engine.rewritten(queries.drop("answer")).first().query == "flooring of the studio, please"
    words = spark.createDataFrame([("s1", 1, "zzz flooring zzz zzz")], "session_id string, query_id long, query string")
    by_vector = engine.activated(words.withColumn("query", F.lit("qqqq wwww rrrr flooringx"))).collect()
    assert len(by_vector) >= 1  # no keyword matches: the vector route alone
    row = engine.evaluate(queries, client=Model, judge=Model).first()
    assert (row.baseline_answer, row.session_mem_judge_score) == ("an answer", 0.5) and row.sliding_latency_ms >= row.sliding_ttft_ms
    assert row.session_mem_activated_cell_count == len(row.activated_cells) > 0 and row.activated_cells[0].cell_type == "fragmented"
    engine.delete("vectors", spark.createDataFrame([("s1",)], "session_id string"))
    assert engine.tables["vectors"].read("s1").count() == 0 < engine.tables["vectors"].read("s2").count()


def test_rewriter_only_where_it_is_called_for(spark, tmp_path):
    engine = MemoryEngine(spark, str(tmp_path / "m"), rewrite=lambda q: F.concat(F.lit("new "), q))
    rows = spark.createDataFrame([("s", 1, "long plain question on our plans"), ("s", 2, "it?")], "session_id string, query_id long, query string")
    assert [r.query for r in engine.rewritten(rows).orderBy("query_id").collect()] == ["long plain question on our plans", "new it?"]


def test_runner(spark, tmp_path):
    talk = [{"speaker": "Ann" if i % 2 else "Bob", "text": f"turn {i} about the budget " * 8} for i in range(150)]
    (tmp_path / "c.json").write_text(json.dumps([{"sample_id": "s1", "conversation": {"speaker_a": "Ann", "session_1_date_time": "2023-05-07", "session_1": talk}, "qa": [{"question": "budget turn", "answer": "x"}]}]))
    main(["--input", str(tmp_path / "c.json"), "--output", str(tmp_path / "out")])
    total = spark.read.json(str(tmp_path / "out" / "totals")).first()
    assert total.total_qas == 1 and total.avg_baseline_tokens > total.avg_session_mem_tokens > 0
    assert "total_qas: 1" in spark.read.text(str(tmp_path / "out" / "report")).first().value + "".join(r.value for r in spark.read.text(str(tmp_path / "out" / "report")).collect())
