import json

import pytest
from pyspark.sql import functions as F

from engramspark.functions import text as T

BODIES = ['{"k": 1}', '{"k": {"m": [true, null]}}', "[7]", '["x", {"y": 2}]']
WRAPS = ["{}", "  {}\n", "```json\n{}\n```", "```\n{}\n```", "Here you are: {} - done"]
JSON = [(w.replace("{}", b), json.dumps(json.loads(b), separators=(",", ":"))) for b in BODIES for w in WRAPS if not (b.startswith("[\"x") and "done" in w)]
JSON += [('so {"k": 1,} it is', '{"k":1}'), ("so [7, ] it is", "[7]"), ("{k: }", None), ("[1, 2", None), ("```json\nnothing\n```", None), ("plain words", None), ("", None), (None, None)]


def test_lenient_json(spark):
    rows = spark.createDataFrame([(t,) for t, _ in JSON], "t string").select(F.to_json(T.lenient_json(F.col("t"))).alias("j")).collect()
    assert [r.j for r in rows] == [w for _, w in JSON]


CUTS = [('{"split_indices": [1, 5]}', 5, [1, 5]), ('{"boundaries": [2]}', 3, [2]), ('{"split_indices": [], "split_points": [1]}', 2, [1]), ("cut at [4, 2, 2]!", 9, [2, 4]), ('{"split_indices": [-3, 0, 7, 8]}', 7, [7]), ('{"split_indices": [1.9]}', 3, [1]), ("[]", 4, []), ("none", 4, []), (None, 4, [])]


@pytest.mark.parametrize(("reply", "n", "want"), CUTS)
def test_split_indices(spark, reply, n, want):
    assert spark.createDataFrame([(reply, n)], "r string, n int").select(T.split_indices(F.col("r"), F.col("n"))).first()[0] == want


def test_dates(spark):
    texts = ["1:56 pm on 8 May, 2023", "7 May 2023", "May 7, 2023", "2023-05-07", "2023-05-07 10:11:12", "", "junk"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.lenient_date(F.col("t")).cast("string")).collect()]
    assert got == ["2023-05-08 13:56:00", *["2023-05-07 00:00:00"] * 3, "2023-05-07 10:11:12", *["2023-05-01 00:00:00"] * 2]


def test_judge_scores(spark):
    texts = ["0.85", "1.5", "-0.5", "1.2.3", "no number", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.judge_score(F.col("t"))).collect()] == [0.85, 1.0, 0.5, 0.0, 0.0, 0.0]


def test_rendering_and_fallbacks(spark):
    row = spark.createDataFrame([("JON smith", " \n first \n\n second\nthird\nfourth")], "r string, t string").select(T.capitalize(F.col("r")), T.fallback_summary(F.col("t")), T.cell_type(F.lit("odd")), T.known_role(F.lit("bot"))).first()
    assert tuple(row) == ("Jon smith", "first second third", "fact", "user")


def test_rewrites(spark):
    rows = [("a long question on our plans", False), ("short", True), ("what about them in the long run", True), ("what happened with the plan yesterday", True)]
    got = spark.createDataFrame([(q,) for q, _ in rows], "q string").select(T.needs_rewrite(F.col("q"), T.chars(F.col("q")))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]
