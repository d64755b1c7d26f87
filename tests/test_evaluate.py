import json

import pytest
from pyspark.sql import functions as F

from engramspark.functions.text import chars
from engramspark.operators import evaluate as E
from engramspark.seams import chat_column, embed_column, judge_prompt
from engramspark.sources.tables import conversation_files


def test_prompts(spark):
    t = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "ASSISTANT", "b"), (1, 2, "user", "c"), (1, 3, "user", "d")], "session_id long, turn_idx long, role string, content string")
    parts = E.history(t)
    q = F.lit("q")
    got = parts.select(E.full_prompt(F.col("parts"), q), E.sliding_prompt(F.col("parts"), q, 2), E.sliding_prompt(F.col("parts"), q, 0), E.sliding_prompt(F.col("parts"), q, 99)).first()
    whole = "[User]: a\n\n[Assistant]: b\n\n[User]: c\n\n[User]: d\n\n[User]: q"
    assert tuple(got) == (whole, "[User]: c\n\n[User]: d\n\n[User]: q", whole, whole)


def test_aggregates(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (10, 20)] + [("b", float(x)) for x in range(1, 101)] + [("c", None)], "k string, v double")
    got = {r.k: r for r in E.aggregated(rows, "v", ["k"]).collect()}
    assert (got["a"].mean_value, got["a"].median_value, got["a"].p95_index) == (15.0, 15.0, 20.0)
    assert got["b"].p95_index == 96.0 and got["b"].p95_interpolated == pytest.approx(95.05)
    assert (got["c"].mean_value, got["c"].p95_index) == (0.0, 0.0)
    saved = spark.createDataFrame([(100, 50), (0, 5), (10, 20)], "b long, m long").select(E.saving(F.col("b"), F.col("m"))).collect()
    assert [r[0] for r in saved] == [0.5, 0.0, -1.0]
    assert E.report(spark.createDataFrame([(2, None)], "n long, x double")).first().value == "n: 2\nx: -"


def test_breakdown(spark):
    rows = spark.createDataFrame([("abc", ["a", "bb"], ["cccc"]), (None, None, None)], "meta string, hot_zone array<string>, cell_texts array<string>")
    assert [(r.meta_tokens, r.hot_tokens, r.cell_tokens) for r in E.breakdown(rows, chars).collect()] == [(3, 3, 4), (0, 0, 0)]


def test_conversation_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"sample_id": "s1", "conversation": {
        "speaker_a": "Ann", "session_2_date_time": "2023-05-07", "session_10": [{"speaker": "Bob", "text": "late"}], "session_2": [{"speaker": " Ann ", "text": "hi"}, {"speaker": "Bob", "text": ""}, {"text": "yo"}], "session_x": []},
        "qa": [{"question": "q0", "answer": "a0"}, {"question": "", "answer": "-"}, {"question": "q2", "answer": "a2"}]}]))
    turns, questions = conversation_files(spark, str(path))
    got = turns.orderBy("turn_idx").collect()
    assert [(r.role, r.content, r.ts_raw) for r in got] == [("Ann", "hi", "2023-05-07T00:00:00Z"), ("Ann", "yo", "2023-05-07T00:02:00Z"), ("Bob", "late", "2023-05-01T00:00:00Z")]
    assert [(r.question_id, r.question) for r in questions.orderBy("question_id").collect()] == [(0, "q0"), (2, "q2")]
    assert conversation_files(spark, str(path), max_turns=2)[0].count() == 2
    bad = tmp_path / "bad.json"
    bad.write_text('{"a": 1}')
    with pytest.raises(ValueError, match="array"):
        conversation_files(spark, str(bad))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        conversation_files(spark, str(tmp_path / "none.json"))


def test_seams(spark):
    class Fake:
        def chat(self, messages, **options):
            if "fail" in messages[-1]["content"]:
                raise RuntimeError("down")
            return messages[-1]["content"].upper()

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(1, "ok"), (2, "fail"), (3, None)], "i long, t string")
    assert [r.reply for r in chat_column(rows, "t", "reply", Fake, judge_prompt).orderBy("i").collect()] == ["OK", None, ""]
    assert [list(r.v) for r in embed_column(rows, "t", "v", Fake).orderBy("i").collect()] == [[2.0], [4.0], [0.0]]
    with pytest.raises(Exception, match="down"):
        chat_column(rows, "t", "reply", Fake, judge_prompt, degrade=False).collect()


def test_judged_answers(spark):
    class Client:
        def chat(self, messages, **options):
            return "0.5" if messages[-1]["content"].startswith("Truth: ") else "an answer"

        def embed(self, texts):
            return []

    from engramspark.seams import answered, judged

    rows = spark.createDataFrame([("p", "", "t")], "full string, memory string, truth string")
    for m in ("full", "memory"):
        rows = judged(answered(rows, m, m, Client), m, "truth", Client)
    got = rows.first()
    assert (got.full_answer, got.full_judge_score, got.memory_answer, got.memory_judge_score, got.memory_latency_ms) == ("an answer", 0.5, "", None, 0.0)
    assert got.full_latency_ms == got.full_ttft_ms >= 0


def test_boundaries_by_a_client():
    from engramspark.seams import boundary_detector

    class Client:
        def chat(self, messages, **options):
            text = messages[-1]["content"]
            if "boom" in text:
                raise RuntimeError
            return "Sure: [9, 2, 1]" if text.startswith("1. [user]: a\n2. [user]: b") else "never"

    detect = boundary_detector(Client)
    assert detect([(0, "narrator", "a", None), (1, "user", "b", None)]) == [1, 2]
    assert detect([]) == [] and detect([(0, "user", "boom", None)]) == [] and detect([(0, "user", "x", None)]) == []
    assert detect([(0, "user", "x" * 9000, None)]) == [1] and detect([(0, "user", "x" * 3000, None)] * 3) == [2]


def test_http_client():
    from engramspark.seams import HttpChatClient

    calls = []

    def post(url, body, stream):
        calls.append((url, body))
        if stream and body["messages"] == ["down"]:
            raise OSError
        if stream:
            return iter(['data: {"choices": [{"delta": {"content": "a"}}]}\n', "\n", 'data: {"choices": [{"delta": {"content": "b"}}]}', "data: [DONE]"])
        return iter(['{"choices": [{"message": {"content": "whole"}}], "data": [{"embedding": [1.0]}]}'])

    c = HttpChatClient("http://host/v1/", "m", post=post)
    assert c.chat([], response_format={"type": "json_schema"}) == "whole" and "response_format" not in calls[-1][1]
    text, total, first = c.timed([])
    assert text == "ab" and 0 <= first <= total
    text, total, first = c.timed(["down"])
    assert text == "whole" and total == first
    assert c.embed(["x"]) == [[1.0]] and calls[-1][0] == "http://host/v1/embeddings"
