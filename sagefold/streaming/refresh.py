"""Incremental ingestion as a stream of pages.

Pages land in a folder as JSON lines.  A run reads what is new (``AvailableNow``)
and each micro-batch appends the versions at or after the high-water mark to a
Parquet table, with the order in which they were read (batch, page, row).  The checkpoint holds
which pages were read: an interrupted run goes on where it stopped, and a batch
that runs again overwrites its own folder.  Other options mean another
checkpoint, that is a full start.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, ledger
from ..schemas import RAW_PR


def option_key(**options) -> str:
    """A checkpoint's name: the options that change which rows a source gives."""
    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:16]


def read_pages(spark: SparkSession, path: str, schema: str = RAW_PR, pages_per_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", pages_per_batch).json(path)
    return rows.withColumn("page", F.col("_metadata.file_path"))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The versions so far; none before the first run."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def refresh(spark: SparkSession, pages: str, store: str, checkpoint: str, schema: str = RAW_PR, updated: str = "updatedAt", pages_per_batch: int = 1000) -> None:
    """Read the pages that are new; store versions at or after the mark before the run."""
    mark = ledger.watermark(_stored(spark, f"{store}/*", schema), updated).first()["watermark"]

    def write(batch: DataFrame, number: int) -> None:
        kept = batch if mark is None else ledger.refresh(batch, F.lit(mark), updated)
        ordered = kept.withColumn("read_order", F.struct(F.lit(number).alias("batch"), F.col("page"), F.monotonically_increasing_id().alias("row")))
        ordered.drop("page").write.mode("overwrite").parquet(f"{store}/batch={number:08d}")

    source = read_pages(spark, pages, schema, pages_per_batch)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def newest(spark: SparkSession, store: str, key: list[str], updated: str = "updatedAt") -> DataFrame:
    """The newest version of each key in the store."""
    return digest.latest(spark.read.parquet(f"{store}/*"), key, updated)
