"""Inputs as turns, cells, queries and vectors; conversation files; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lenient_date, strip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_idx"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("ts_raw"))


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as turns in order of time."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn_idx"), F.lit("user").alias("role"), F.col("event_type").alias("content"), F.col("ts").alias("ts_raw"))


def conversation_files(spark: SparkSession, path: str, max_sessions: int | None = None, max_turns: int | None = None, max_qa: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of a JSON array of conversations with ``session_<n>`` lists and their dates.

    Empty turns and questions are skipped but keep their numbers.  A file that holds no array is refused.
    """
    head = spark.read.text(path, wholetext=True).select(F.substr(strip(F.col("value")), F.lit(1), F.lit(1)).alias("c")).filter("c <> '['")
    if not head.isEmpty():
        raise ValueError("conversation files must hold a JSON array")
    schema = "sample_id STRING, conversation MAP<STRING, VARIANT>, qa ARRAY<STRUCT<question: STRING, answer: STRING>>"
    return conversation_frames(spark.read.schema(schema).option("multiLine", True).json(path), max_sessions, max_turns, max_qa)


def conversation_frames(raw: DataFrame, max_sessions: int | None = None, max_turns: int | None = None, max_qa: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Turns and questions of rows with sample_id, conversation (a map of variants) and qa."""
    raw = raw.filter("conversation IS NOT NULL").withColumn("order_", F.monotonically_increasing_id())
    if max_sessions is not None:
        raw = raw.orderBy("order_").limit(max_sessions)
    entries = raw.select(F.col("sample_id").alias("session_id"), "conversation", F.explode("conversation").alias("key", "value")).filter(F.col("key").rlike(r"^session_\d+$"))
    number = F.regexp_extract("key", r"_(\d+)$", 1).cast("int")
    date = F.try_variant_get(F.try_element_at("conversation", F.concat("key", F.lit("_date_time"))), "$", "string")
    lines = F.try_variant_get("value", "$", "array<struct<speaker: string, text: string>>")
    rows = entries.select("session_id", number.alias("n"), lenient_date(date).alias("date"), F.try_variant_get(F.try_element_at("conversation", F.lit("speaker_a")), "$", "string").alias("first_speaker"), F.posexplode(lines).alias("pos", "t"))
    rows = rows.filter(F.coalesce(F.col("t.text"), F.lit("")) != "")
    turns = rows.select(
        "session_id", F.struct("n", "pos").alias("place"), F.coalesce(F.when(strip(F.col("t.speaker")) != "", strip(F.col("t.speaker"))), F.when(F.col("first_speaker") != "", F.col("first_speaker")), F.lit("user")).alias("role"), F.col("t.text").alias("content"),
        F.date_format(F.col("date") + F.make_interval(mins=F.col("pos")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_raw"),
    )
    from pyspark.sql import Window

    turns = turns.withColumn("turn_idx", (F.row_number().over(Window.partitionBy("session_id").orderBy("place")) - 1).cast("long")).drop("place")
    if max_turns is not None:
        turns = turns.filter(F.col("turn_idx") < max_turns)
    questions = raw.select(F.col("sample_id").alias("session_id"), F.posexplode("qa").alias("question_id", "q")).select("session_id", "question_id", F.col("q.question").alias("question"), F.col("q.answer").alias("answer"))
    questions = questions.filter(F.coalesce("question", F.lit("")) != "")
    if max_qa is not None:
        questions = questions.filter(F.col("question_id") < max_qa)
    return turns, questions


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write rows as parquet, JSON, or a single text column as text."""
    getattr(df.write.mode("overwrite"), kind)(path)
