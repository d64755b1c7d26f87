"""Cells and session digests: fallback extraction, entity links, upserts, versions, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_type, fallback_summary, keyword_runs, lenient_json

REPLY = "struct<summary:string,keywords:array<string>,entities:array<string>,cell_type:string,confidence:string,causal_deps:array<string>>"


def top_keywords(rows: DataFrame, text_col: str, keys: list[str], k: int = 8) -> DataFrame:
    """keys, rank, keyword: the most frequent runs of each text, ties by first place."""
    runs = rows.select(*keys, F.posexplode(keyword_runs(F.col(text_col))).alias("pos", "keyword"))
    counted = runs.groupBy(*keys, "keyword").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first_pos"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_fallbacks(rows: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """``rows`` with summary, keywords (8) and entities (5) made from the text alone."""
    top = top_keywords(rows, text_col, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("keywords"))
    out = rows.join(top, keys, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    return out.withColumn("entities", F.slice("keywords", 1, 5)).withColumn("summary", fallback_summary(F.col(text_col)))


def from_replies(rows: DataFrame, reply_col: str) -> DataFrame:
    """``rows`` (with fallbacks) overridden by an extractor's JSON replies; confidence 0.3 where nothing parses."""
    # A column each, so that a reply is parsed once.
    rows = rows.withColumn("json_", F.to_json(lenient_json(F.col(reply_col)))).withColumn("parsed_", F.from_json("json_", REPLY))
    parsed, empty = F.col("parsed_"), F.col("json_").isNull() | F.col("json_").isin("{}", "[]")

    def given(name: str) -> Column:
        x = parsed[name]
        return F.coalesce(F.when((F.length(x) > 0) if name == "summary" else (F.size(x) > 0), x), F.col(name))

    out = {n: given(n) for n in ("summary", "keywords", "entities")}
    out["cell_type"] = F.when(empty, "fact").otherwise(cell_type(parsed["cell_type"]))
    out["confidence"] = F.when(empty, 0.3).otherwise(F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.5)))
    out["causal_deps"] = F.coalesce(parsed["causal_deps"], F.array().cast("array<string>"))
    return rows.withColumns(out).drop("json_", "parsed_")


def entity_links(cells: DataFrame) -> DataFrame:
    """session_id, cell_id, entity: each entity of a cell once."""
    return cells.select("session_id", "cell_id", F.explode(F.array_distinct("entities")).alias("entity"))


def find_by_entity(cells: DataFrame, entity: str) -> DataFrame:
    """Cells that hold the entity, told exactly (case counts)."""
    return cells.filter(F.array_contains("entities", entity))


def cooccurring(links: DataFrame) -> DataFrame:
    """a, b, n: pairs of entities of one cell (few a cell), with the number of cells."""
    pairs = links.alias("x").join(links.alias("y"), ["session_id", "cell_id"]).filter("x.entity < y.entity")
    return pairs.groupBy(F.col("x.entity").alias("a"), F.col("y.entity").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def upserted(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("rn_ = 1").drop("rn_")


def merged(store: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and cached ones; a cached row stands in for the stored one of its key."""
    both = store.withColumn("from_", F.lit(0)).unionByName(cache.withColumn("from_", F.lit(1)))
    return upserted(both, keys, "from_").drop("from_")


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` without the rows whose keys are in ``gone`` (sessions, cells, vectors, texts)."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def hydrated(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells with their raw text; the empty text where there is none."""
    return cells.join(texts.select("session_id", "cell_id", "raw_text"), ["session_id", "cell_id"], "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


def session_scan(cells: DataFrame, limit: int | None = None) -> DataFrame:
    """Cells of every session in order, the oldest ``limit`` of each."""
    if limit is None:
        return cells
    return cells.withColumn("rn_", F.row_number().over(Window.partitionBy("session_id").orderBy("cell_seq"))).filter(F.col("rn_") <= limit).drop("rn_")


def cell_by_id(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells that ``wanted`` (session_id, cell_id) names."""
    return cells.join(wanted.select("session_id", "cell_id").distinct(), ["session_id", "cell_id"], "left_semi")


#: How a stored cell's lists are decoded.
STORED = {"keywords": "array<string>", "entities": "array<string>", "causal_deps": "array<string>", "linked_cells": "array<string>"}


def decoded(rows: DataFrame) -> DataFrame:
    """Rows whose lists are stored as JSON texts, with native lists; null, empty and broken texts give empty lists."""
    have = [c for c, t in rows.dtypes if c in STORED and t == "string"]
    return rows.withColumns({c: F.coalesce(F.from_json(c, STORED[c]), F.array().cast(STORED[c])) for c in have})


def encoded(rows: DataFrame) -> DataFrame:
    """Rows with their lists as JSON texts."""
    return rows.withColumns({c: F.to_json(c) for c, t in rows.dtypes if c in STORED and t.startswith("array")})


def meta_versions(cells: DataFrame) -> DataFrame:
    """A digest version for each flush: linked cells so far, running summary, keywords and entities of the new cells.

    ``cells`` has session_id, flush_id, cell_seq, cell_id, summary, keywords, entities, and may have
    timestamp_start and timestamp_end: the first digest starts where its first cell does, later ones have no
    start, each ends where its last cell does.
    """
    for c in ("timestamp_start", "timestamp_end"):
        cells = cells if c in cells.columns else cells.withColumn(c, F.lit(None).cast("string"))
    new = cells.groupBy("session_id", "flush_id").agg(F.array_sort(F.collect_list(F.struct("cell_seq", "cell_id", "summary", "keywords", "entities", "timestamp_start", "timestamp_end"))).alias("c"))
    so_far = Window.partitionBy("session_id").orderBy("flush_id").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("session_id")
    summaries = F.filter(F.transform("c", lambda x: x["summary"]), lambda s: F.length(s) > 0)
    rows = new.select(
        "session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("flush_id")).cast("long").alias("version"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("c", lambda x: x["cell_id"])).over(so_far))).alias("linked_cells"),
        F.array_join(F.flatten(F.collect_list(summaries).over(so_far)), " ").alias("raw_text"),
        F.slice(F.array_distinct(F.flatten(F.transform("c", lambda x: x["keywords"]))), 1, 8).alias("keywords"),
        F.slice(F.array_distinct(F.flatten(F.transform("c", lambda x: x["entities"]))), 1, 5).alias("entities"),
        F.element_at("c", 1)["timestamp_start"].alias("timestamp_start"), F.element_at("c", -1)["timestamp_end"].alias("timestamp_end"),
    )
    rows = rows.withColumn("timestamp_start", F.when(F.col("version") == 1, F.col("timestamp_start")))
    rows = rows.withColumn("meta_id", F.format_string("M_%03d", F.col("version").cast("int")))
    return rows.withColumn("status", F.when(F.col("version") == F.max("version").over(whole), "active").otherwise("archived"))


def digests_of(cells: DataFrame) -> DataFrame:
    """``meta_versions`` of cells that there must be; none at all is an error."""
    if cells.isEmpty():
        raise ValueError("a digest needs cells")
    return meta_versions(cells)


def active_meta(metas: DataFrame) -> DataFrame:
    return metas.filter("status = 'active'")
