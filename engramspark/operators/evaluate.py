"""Evaluation: prompts of three methods, token savings, breakdown, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Estimator, chars, render_prompt


METHODS = ("baseline", "sliding", "session_mem")


def history(turns: DataFrame) -> DataFrame:
    """session_id, parts: each session's turns as prompt lines, in order."""
    return turns.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "role", "content"))), lambda t: render_prompt(t["role"], t["content"])).alias("parts"))


def full_prompt(parts: Column, question: Column) -> Column:
    return F.array_join(F.concat(parts, F.array(F.concat(F.lit("[User]: "), question))), "\n\n")


def sliding_prompt(parts: Column, question: Column, window: int = 10) -> Column:
    """The last turns and the question; a window of 0 keeps all turns."""
    last = F.slice(parts, F.greatest(F.lit(1), F.size(parts) - window + 1), F.lit(window)) if window else parts
    return full_prompt(last, question)


def saving(base: Column, ours: Column) -> Column:
    """Share of tokens saved; 0 where there was nothing to save, negative where more are used."""
    return F.when(base == 0, 0.0).otherwise((base - ours) / base)


def breakdown(rows: DataFrame, estimator: Estimator = chars) -> DataFrame:
    """Tokens of digest, hot zone and cells (columns meta, hot_zone, cell_texts)."""

    def total(parts: Column) -> Column:
        return F.aggregate(F.coalesce(parts, F.array().cast("array<string>")), F.lit(0).cast("long"), lambda a, x: a + estimator(x))

    return rows.withColumns({"meta_tokens": F.coalesce(estimator(F.col("meta")), F.lit(0)).cast("long"), "hot_tokens": total(F.col("hot_zone")), "cell_tokens": total(F.col("cell_texts"))})


def aggregated(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median, both 95th percentiles (by index and interpolated) and count of a column; zeros without values.

    By index: the element at floor(0.95 n) of the sorted values, or the last one.  Values are ranked by a
    sort, not gathered.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last()))
    rows = rows.withColumns({"rn_": rank, "n_": F.count(value).over(Window.partitionBy(*by))})
    at = F.least(F.floor(F.col("n_") * 0.95), F.col("n_") - 1) + 1
    return rows.groupBy(*by).agg(
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_value"), F.coalesce(F.percentile(value, F.lit(0.5)), F.lit(0.0)).alias("median_value"), F.coalesce(F.max(F.when(F.col("rn_") == at, F.col(value))), F.lit(0.0)).alias("p95_index"),
        F.coalesce(F.percentile(value, F.lit(0.95)), F.lit(0.0)).alias("p95_interpolated"), F.count(F.lit(1)).alias("n"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """One row over all questions: their number, means of savings, tokens, times and scores, median and 95th
    percentile (by index) of the times.  Without questions all are 0, scores without any are null."""
    have = set(rows.columns)
    means = [c for c in rows.columns if c.endswith(("_ms", "_tokens", "_count")) or "saving_rate" in c]
    times = [f"{m}_{t}_ms" for m in METHODS for t in ("latency", "ttft") if f"{m}_{t}_ms" in have]
    scores = [f"{m}_judge_score" for m in METHODS if f"{m}_judge_score" in have]
    # The element at floor(0.95 n) of the sorted values: the first above that share of them.
    p95 = "percentile_disc(0.950000000001D) WITHIN GROUP (ORDER BY `{}`)"
    return rows.agg(
        F.count(F.lit(1)).alias("total_qas"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in means],
        *[F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)).alias(f"median_{c}") for c in times],
        *[F.coalesce(F.expr(p95.format(c)), F.lit(0.0)).alias(f"p95_{c}") for c in times], *[F.avg(c).alias(f"avg_{c}") for c in scores],
    )


def report(rows: DataFrame) -> DataFrame:
    """One text row: ``name: value`` lines of a one-row frame of aggregates."""
    lines = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-"))) for c in rows.columns])
    return rows.select(F.array_join(lines, "\n").alias("value"))
