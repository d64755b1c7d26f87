"""Evaluate a conversation file: python -m engramspark.runner --input FILE --output DIR"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import MemoryEngine
from .config import BufferConfig
from .functions.text import chars, chars_div_4
from .operators.evaluate import report, totals
from .operators.segment import split_long
from .seams import HttpChatClient, embed_column
from .sources.tables import conversation_files, save


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--input", required=True, help="JSON file of conversations")
    p.add_argument("--output", required=True, help="folder for memory, questions, totals and report")
    p.add_argument("--memory", help="folder of an engine to use again, instead of one below the output")
    for name in ("sessions", "turns", "questions"):
        p.add_argument(f"--max-{name}", type=int)
    p.add_argument("--window", type=int, default=10, help="turns of the sliding prompt")
    p.add_argument("--soft", type=int, default=BufferConfig.soft)
    p.add_argument("--hard", type=int, default=BufferConfig.hard)
    p.add_argument("--gap-minutes", type=int, default=BufferConfig.gap_minutes)
    p.add_argument("--estimator", choices=("chars", "chars_div_4"), default="chars")
    p.add_argument("--answers", action="store_true", help="let the model answer each prompt")
    p.add_argument("--no-judge", action="store_true", help="do not grade the answers")
    for name in ("chat", "judge"):
        p.add_argument(f"--{name}-url")
        p.add_argument(f"--{name}-key", default="")
        p.add_argument(f"--{name}-model", default="")
    p.add_argument("--embedding-url")
    p.add_argument("--embedding-model", default="")
    p.add_argument("--workers", type=int, help="partitions, so many sessions at once")
    p.add_argument("--verbose", action="store_true")
    return p.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.getOrCreate()
    if a.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if a.workers:
        spark.conf.set("spark.sql.shuffle.partitions", a.workers)
    chat = partial(HttpChatClient, a.chat_url, a.chat_model, a.chat_key) if a.chat_url else None
    judge = partial(HttpChatClient, a.judge_url, a.judge_model, a.judge_key) if a.judge_url and not a.no_judge else None
    embed = None
    if a.embedding_url:
        service = partial(HttpChatClient, a.embedding_url, a.embedding_model)

        def embed(rows, text, vector):
            return embed_column(rows, text, vector, service)

    turns, questions = conversation_files(spark, a.input, a.max_sessions, a.max_turns, a.max_questions)
    buffer = BufferConfig(a.soft, a.hard, a.gap_minutes)
    engine = MemoryEngine(spark, a.memory or f"{a.output}/memory", buffer, estimator=chars if a.estimator == "chars" else chars_div_4, detector=partial(split_long, config=buffer), embed=embed, client=chat)
    engine.add_turns(turns)
    engine.save()
    asked = questions.select("session_id", F.col("question_id").cast("long").alias("query_id"), F.col("question").alias("query"), "answer")
    rows = engine.evaluate(asked, a.window, chat if a.answers else None, judge if a.answers else None)
    save(rows, f"{a.output}/questions", "json")
    total = totals(spark.read.schema(rows.schema).json(f"{a.output}/questions"))
    save(total, f"{a.output}/totals", "json")
    save(report(total), f"{a.output}/report", "text")


if __name__ == "__main__":
    main()
