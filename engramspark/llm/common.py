"""Helpers shared by the corpus operators: the shared folder, materialised steps, batches of texts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it; Python's ``bytes.split()`` splits on the same six characters.
SPACES = r"[\x20\x09-\x0D]+"


#: A Python task holds one batch of rows at a time; both bounds keep it small where texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow; when a task ends its memory goes back to the system, since Python workers are used again."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """Bounds of Arrow batches for the session; results are lazy, so the setting stays (the README says so)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is made and set on a local master; on a cluster, where executors
    would each write to their own disk, it is an error.
    """
    small_batches(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="engramspark-")
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/engramspark/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, a folder for each value of its last columns ``by``, and read it again.

    Cuts the lineage: what follows survives lost executors without computing ``df`` anew.
    """
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, for columns that an operator adds for its own use."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column, divisor: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def map_texts(df: DataFrame, id_col: str, text_col: str, rows: Callable[[Iterable, Iterable], dict], schema: str, keep: Iterable[str] = ()) -> DataFrame:
    """``rows(ids, texts)`` of every Arrow batch, as new columns or rows.

    ``rows`` gets the ids as a list and the texts as a list of ``bytes`` (UTF-8, null as empty) and returns
    a dict of equally long sequences, one for each name of ``schema``.  Whole texts; no state between tasks.
    Columns named in ``keep`` follow as strings.
    """
    small_batches(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    kept = [f"kept_{k}" for k, _ in enumerate(keep)]
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), *[F.col(f"`{c}`").cast("string").alias(k) for k, c in zip(kept, keep, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for b in batches:
            if not b.num_rows:
                continue
            out = rows(b.column(0).to_pylist(), b.column(1).to_pylist())
            types = types or arrow_types(schema)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)] + b.columns[2:], names=names + kept)

    return src.mapInArrow(lean(run), schema + "".join(f", {k} string" for k in kept))


_ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_types(schema: str) -> list[pa.DataType]:
    out = []
    for field in schema.split(","):
        kind = field.strip().split(" ", 1)[1].strip()
        out.append(pa.list_(_ARROW[kind[6:-1]]) if kind.startswith("array<") else _ARROW[kind])
    return out
