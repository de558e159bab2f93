"""Answering a stream of requests: each micro-batch runs the same plan as a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.decide import decide
from ..sources.io import REQUESTS


def requests_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """JSON files of requests as they arrive."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def serve(requests: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, **options):
    """A query that hands the answers of each micro-batch to ``sink`` (frame, batch id); windows over questions aren't allowed on a stream itself.

    A batch that is tried again has the same id, so a sink that writes by id is exactly-once."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            sink(decide(batch, **options), number)
        finally:
            batch.unpersist()

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    return lambda answers, number: answers.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
