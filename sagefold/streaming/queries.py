"""Streaming queries over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest, ledger
from ..plans import surrogates as S
from ..workspace import shared_dir

FEED = "pr long, state string, updated_at timestamp, read_order int"


def stream_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream of files, each batch appended, then the newest version of each pull request.

    A second run over the same checkpoint reads nothing.
    """
    base = f"{shared_dir(spark)}/refresh-{uuid.uuid4().hex}"
    S.feed(spark, d).select("pr", "state", "updated_at", "read_order").repartition(4, "read_order").write.parquet(f"{base}/pages")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/store/batch={number:08d}")

    for _ in range(2):
        source = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 2).parquet(f"{base}/pages")
        source.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.schema(FEED).parquet(f"{base}/store/*")
    mark = ledger.watermark(stored)
    return digest.latest(stored, ["pr"], "updated_at").join(F.broadcast(mark)).select("pr", "state", "updated_at", "read_order", "watermark")


def queries() -> dict:
    return {"stream_refresh": stream_refresh}


def oracle_sql() -> dict[str, str]:
    from ..plans.oracle import FEED as FEED_SQL

    return {"stream_refresh": f"WITH {FEED_SQL} SELECT pr, state, updated_at, read_order, (SELECT max(updated_at) FROM feed) AS watermark FROM feed QUALIFY row_number() OVER (PARTITION BY pr ORDER BY updated_at DESC, read_order) = 1"}
