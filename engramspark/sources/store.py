"""Stored tables: rows are only ever appended, the latest of a key counts, deletions are rows too."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import upserted

_last = 0


def stamp() -> int:
    """A number that grows with every write of this process, and with the clock between processes."""
    global _last
    _last = max(_last + 1, time.time_ns())
    return _last


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, or a temporary one on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="engramspark-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return f"{base.rstrip('/')}/engramspark/{tag}-{uuid.uuid4().hex}"


class Table:
    """A table below ``path`` with ``keys``; files lie in BUCKETS folders by session, so one session is read alone."""

    BUCKETS = 16

    def __init__(self, spark: SparkSession, path: str, name: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, f"{path.rstrip('/')}/{name}", schema, keys
        self.columns = [x.strip().split(" ")[0] for x in schema.split(", ")]

    def _append(self, rows: DataFrame, part: str) -> None:
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(self.BUCKETS)).cast("int")
        rows.withColumns({"written": F.lit(stamp()), "bucket": bucket}).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{part}")

    def _read(self, part: str, schema: str, session_id: str | None) -> DataFrame | None:
        """All that was appended to a part; None before its first rows."""
        schema = f"{schema}, written long, bucket int"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        if session_id is not None:
            rows = rows.filter((F.col("bucket") == F.pmod(F.xxhash64(F.lit(session_id)), F.lit(self.BUCKETS)).cast("int")) & (F.col("session_id") == session_id))
        return rows

    def put(self, rows: DataFrame) -> None:
        """Insert, or replace where the key is there."""
        self._append(rows.select(self.columns), "rows")

    def delete(self, rows: DataFrame) -> None:
        """Delete by key, or whole sessions where ``rows`` has no other key; what is put later stays."""
        keys = [k for k in self.keys if k in rows.columns]
        self._append(rows.select(*keys).distinct(), "deleted_" + "_".join(keys))

    def read(self, session_id: str | None = None) -> DataFrame:
        """The rows that count, of one session if it is named."""
        rows = self._read("rows", self.schema, session_id)
        if rows is None:
            return self.spark.createDataFrame([], self.schema)
        kinds = dict(x.strip().split(" ", 1) for x in self.schema.split(", "))
        for n in sorted({1, len(self.keys)}):
            keys = self.keys[:n]
            gone = self._read("deleted_" + "_".join(keys), ", ".join(f"{k} {kinds[k]}" for k in keys), session_id)
            if gone is not None:
                gone = gone.groupBy(*keys).agg(F.max("written").alias("gone"))
                rows = rows.join(gone, keys, "left").filter(F.col("gone").isNull() | (F.col("written") > F.col("gone"))).drop("gone")
        return upserted(rows, self.keys, "written").select(self.columns)
