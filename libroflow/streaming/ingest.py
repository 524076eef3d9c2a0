"""Continuous ingestion: new volume files pass through the same functions, batch by batch; and one request at a time."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from libroflow.sources.volumes import VOLUME, entries_of


def volume_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Volume records as their files arrive."""
    return spark.readStream.schema(VOLUME).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)


def entries_stream(spark: SparkSession, path: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Entries of arriving volumes, transformed and appended as parquet. Volumes need no state of one another, so each
    batch stands alone; a batch that is repeated after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        transform(entries_of(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return volume_stream(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def handled(event: dict, process: Callable[[str], object]) -> dict:
    """One request: its body is processed and the result comes back with status 200; without a body the status is 400."""
    body = event.get("body")
    if not body:
        return {"statusCode": 400, "body": json.dumps({"error": "no body"})}
    return {"statusCode": 200, "body": json.dumps(process(body), ensure_ascii=False)}
