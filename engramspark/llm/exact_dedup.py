"""Exact deduplication with salted combining, DataFrame functions only.

1. Local: Spark's partial aggregation folds equal texts inside each map task.
2. Salted: rows of one digest are dealt over ``salts`` groups by their id, so that a text that a third of
   all rows share meets in many tasks; each group keeps its smallest id and its count.
3. Global: the winners of the salts (at most ``salts`` rows a text) are combined.

The normalised text itself is a grouping key at every stage, so equal digests of different texts never
merge.  The winners are written without their texts.  To bring the result back to the rows, digest and salt
are joined, unless some digest really stands for more than one text: then the text is part of that join too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, fresh, materialize, read_documents

SALTS = 32


def normalized(text: Column) -> Column:
    """Null as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _joined(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, list[str]]:
    """``docs`` with digest, smallest id and size of the group, kept; the names of these four columns."""
    if not 1 <= salts <= 64:
        raise ValueError("salts must be 1 to 64")
    hx, salt, norm, keep, size, kept, mask, w_hx, w_salt, w_norm = fresh(docs, "xd_digest", "xd_salt", "xd_norm", "xd_keep", "xd_size", "xd_kept", "xd_mask", "w_digest", "w_salt", "w_norm")
    # A projection each, so that text and digest are computed once a row.
    rows = docs.withColumn(norm, normalized(F.col(f"`{text_col}`"))).withColumn(salt, F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(salts)).cast("int"))
    rows = rows.withColumn(hx, digest(F.col(norm)))

    salted = rows.groupBy(hx, salt, norm).agg(F.min(f"`{id_col}`").alias(keep), F.count(F.lit(1)).alias(size))
    whole = salted.groupBy(hx, norm).agg(F.min(keep).alias(keep), F.sum(size).alias(size), F.expr(f"bit_or(shiftleft(1L, {salt}))").alias(mask))

    def narrow(text: Column) -> DataFrame:
        return whole.select(F.col(hx).alias(w_hx), text.alias(w_norm), F.col(keep), F.col(size), mask)

    winners, compared = materialize(narrow(F.lit(None).cast("string")), "dedup-winners"), F.lit(None).cast("string")
    if not winners.groupBy(w_hx).count().filter("count > 1").isEmpty():
        winners, compared = narrow(F.col(norm)), F.col(norm)
    one = F.lit(1).cast("long")
    winners = winners.withColumn(w_salt, F.explode(F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.col(mask).bitwiseAND(F.call_function("shiftleft", one, i)) != 0))).drop(mask)
    left = rows.withColumn(norm, compared)
    out = left.join(winners, (F.col(hx) == F.col(w_hx)) & (F.col(salt) == F.col(w_salt)) & F.col(norm).eqNullSafe(F.col(w_norm)))
    return out.withColumn(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(keep))).drop(norm, salt, w_hx, w_salt, w_norm), [hx, keep, size, kept]


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty.  A null id loses to any other id; in a group where every id is null, every
    row is kept (none can be told from another).  Rows that repeat id and text all get the same values.
    Very long texts are compared whole.  An empty table gives an empty result; other columns are neither read
    nor in the way.
    """
    rows, (hx, keep, size, kept) = _joined(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col, salts, digest)
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(keep).alias("keep_id"), F.col(size).alias("group_size"), F.col(kept).alias("kept"), F.col(hx).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Null text counts as empty.  If the winner's id occurs on several rows of the group, one row of them stays;
    of a group without any id all rows stay.  Very long texts are compared whole; columns may have any names;
    an empty table gives an empty result.
    """
    rows, (hx, _, _, kept) = _joined(docs, id_col, text_col, salts, sha256)
    rows = rows.filter(F.col(kept))
    if docs.groupBy(f"`{id_col}`").count().filter((F.col("count") > 1) & F.col(f"`{id_col}`").isNotNull()).isEmpty():
        return rows.select(*[f"`{c}`" for c in docs.columns])
    named = rows.filter(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, hx])
    return named.unionByName(rows.filter(F.col(f"`{id_col}`").isNull())).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read_documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
