"""Folding ordered turns into cells: gap, hard limit, soft checks with a boundary detector.

A cell ends where the buffer's state says so, so the fold is sequential in a session and parallel over
sessions; it runs as one native ``aggregate`` over the session's turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUFFER, BufferConfig
from ..functions.text import MOMENT, Estimator, chars, known_role, moment, render

TURN = "struct<turn_idx:bigint,role:string,content:string,ts_raw:string,ts:struct<micros:bigint,zoned:boolean>,tokens:bigint>"
SEGMENT = f"struct<reason:string,turns:array<{TURN}>>"
STATE = f"struct<buffer:array<{TURN}>,checked:bigint,flushes:bigint,segments:array<struct<flush_id:bigint,reason:string,turns:array<{TURN}>>>>"

#: Takes the buffered turns, returns cut points: how many turns are before each cut.
Detector = Callable[[Column], Column]


def no_split(turns: Column) -> Column:
    return F.array().cast("array<int>")


def split_all(turns: Column) -> Column:
    """Everything buffered becomes one segment."""
    return F.array(F.size(turns)).cast("array<int>")


def split_long(turns: Column, config: BufferConfig = BUFFER) -> Column:
    """The rule before any model is asked: beyond so many characters, all but the last turn."""
    total = F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + F.length(t["content"]))
    return F.when(total > config.detector_chars, F.array(F.greatest(F.lit(1), F.size(turns) - 1))).otherwise(F.array().cast("array<int>"))


def cuts(points: Column, n: Column) -> Column:
    """Distinct cut points within 1 to n, ascending."""
    return F.array_sort(F.array_distinct(F.filter(points, lambda i: (i > 0) & (i <= n))))


def is_gap(before: Column, after: Column, minutes: int) -> Column:
    """More than so many minutes between two moments; never when one is unknown, or one alone has a zone."""
    return F.coalesce((before["zoned"] == after["zoned"]) & (after["micros"] - before["micros"] > minutes * 60_000_000), F.lit(False))


def moment_of(turns: DataFrame, col: str = "ts_raw") -> Column:
    """The moment of a column of texts or timestamps."""
    if dict(turns.dtypes)[col] == "string":
        return moment(F.col(col))
    micros = F.unix_micros(F.col(col).cast("timestamp"))
    return F.when(micros.isNotNull(), F.struct(micros.alias("micros"), F.lit(False).alias("zoned"))).cast(MOMENT)


def _step(config: BufferConfig, detector: Detector) -> Callable[[Column, Column], Column]:
    def step(state: Column, turn: Column) -> Column:
        # Higher-order functions nest: each ``let`` is a one-element transform.
        def let(value: Column, body: Callable[[Column], Column]) -> Column:
            return F.transform(F.array(value), body)[0]

        def with_buffer(buffer: Column) -> Column:
            n = F.size(buffer)
            tokens = F.aggregate(buffer, F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
            gap = (n >= 2) & is_gap(F.element_at(buffer, -2)["ts"], F.element_at(buffer, -1)["ts"], config.gap_minutes)

            def decided(total: Column) -> Column:
                multiple = F.floor(total / config.soft).cast("long")
                soft = (multiple >= 1) & (multiple > state["checked"]) & (total < config.hard)
                reason = F.when(gap, "gap").when(total >= config.hard, "hard").when(soft, "soft")
                points = F.when(gap | (total >= config.hard), F.array(n).cast("array<int>")).when(soft, cuts(detector(buffer), n)).otherwise(F.array().cast("array<int>"))

                def cut(p: Column) -> Column:
                    out = F.transform(p, lambda end, k: F.struct(
                        (state["flushes"] + 1).cast("long").alias("flush_id"), reason.alias("reason"),
                        F.slice(buffer, F.when(k == 0, F.lit(0)).otherwise(p[k - 1]) + 1, end - F.when(k == 0, F.lit(0)).otherwise(p[k - 1])).alias("turns"),
                    ))
                    some = F.size(p) > 0
                    rest = F.when(some, F.slice(buffer, F.element_at(p, -1) + 1, F.greatest(F.lit(0), n - F.element_at(p, -1)))).otherwise(buffer)
                    return F.struct(
                        rest.alias("buffer"), F.when(some, F.lit(0).cast("long")).when(soft, multiple).otherwise(state["checked"]).alias("checked"),
                        (state["flushes"] + some.cast("long")).alias("flushes"), F.concat(state["segments"], out).alias("segments"),
                    ).cast(STATE)

                return let(points, cut)

            return let(tokens, decided)

        return let(F.concat(state["buffer"], F.array(turn)), with_buffer)

    return step


def fold(turns: DataFrame, config: BufferConfig = BUFFER, estimator: Estimator = chars, detector: Detector = no_split) -> DataFrame:
    """session_id, state (buffer left, segments) of each session of ``turns`` (session_id, turn_idx, role, content, ts_raw).

    Null content counts as empty, a null role as ``user``.
    """
    content = F.coalesce("content", F.lit(""))
    turn = F.struct(F.col("turn_idx").cast("long").alias("turn_idx"), F.coalesce("role", F.lit("user")).alias("role"), content.alias("content"), F.col("ts_raw").cast("string").alias("ts_raw"), moment_of(turns).alias("ts"), F.coalesce(estimator(content), F.lit(0)).cast("long").alias("tokens"))
    whole = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.array().cast(f"array<{TURN}>").alias("buffer"), F.lit(0).cast("long").alias("checked"), F.lit(0).cast("long").alias("flushes"), F.array().cast(STATE.split("segments:")[1][:-1]).alias("segments")).cast(STATE)
    return whole.select("session_id", F.aggregate("turns", start, _step(config, detector)).alias("state"))


def boundary_lines(turns: Column) -> Column:
    """Numbered turns as a boundary model sees them; unknown roles count as ``user``."""
    return F.array_join(F.transform(turns, lambda t, k: F.concat((k + 1).cast("string"), F.lit(". "), render(known_role(t["role"]), t["content"]))), "\n")


def cells(folded: DataFrame, estimator: Estimator = chars, known: DataFrame | None = None) -> DataFrame:
    """One row a segment: ids in order, link to the one before, bounds, rendered text and its tokens.

    With ``known`` (session_id, cell_id) numbers go on from the largest of a session's ids.
    """
    rows = folded.select("session_id", F.posexplode("state.segments").alias("pos", "s"))
    first_id = F.lit(0)
    if known is not None:
        rows = rows.join(next_cell_number(known), "session_id", "left")
        first_id = F.coalesce(F.col("next") - 1, F.lit(0))
    text = F.array_join(F.transform("s.turns", lambda t: render(t["role"], t["content"])), "\n")
    rows = rows.select(
        "session_id", (F.col("pos") + 1 + first_id).cast("long").alias("cell_seq"), F.format_string("C_%03d", (F.col("pos") + 1 + first_id).cast("int")).alias("cell_id"), F.col("s.flush_id").alias("flush_id"), F.col("s.reason").alias("reason"),
        F.when(F.col("s.reason") == "hard", "fragmented").otherwise("fact").alias("cell_type"), F.size("s.turns").cast("long").alias("n_turns"),
        F.element_at("s.turns", 1)["ts_raw"].alias("timestamp_start"), F.element_at("s.turns", -1)["ts_raw"].alias("timestamp_end"), F.element_at("s.turns", 1)["turn_idx"].alias("first_turn"), F.element_at("s.turns", -1)["turn_idx"].alias("last_turn"), text.alias("raw_text"),
    )
    rows = rows.withColumn("token_count", estimator(F.col("raw_text")))
    return rows.withColumn("linked_prev", F.lag("cell_id").over(Window.partitionBy("session_id").orderBy("cell_seq")))


def hot_zone(folded: DataFrame) -> DataFrame:
    """session_id, hot_zone: the rendered turns that are still buffered."""
    return folded.select("session_id", F.transform("state.buffer", lambda t: render(t["role"], t["content"])).alias("hot_zone"))


def next_cell_number(cell_ids: DataFrame) -> DataFrame:
    """session_id, next: one more than the largest number of ids ``C_<number>``."""
    number = F.regexp_extract("cell_id", r"^C_(\d+)$", 1).try_cast("long")
    return cell_ids.groupBy("session_id").agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"))
