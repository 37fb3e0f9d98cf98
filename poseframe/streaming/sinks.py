"""Sinks that work on a stream's batches as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter


def batch_writer(path: str, work: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: runs `work` on each batch and writes it to a folder of its own, `path`/batch=<id>, replacing what is there.

    A batch that comes again after a failure replaces its own rows, so the table is the same as if it had come once; other batches'
    folders are not touched. Rows without a batch are written as an empty folder, so that reruns stay alike.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = work(batch) if work else batch
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch_id)}")

    return write


def frames_to(frames: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer of a stream through batch_writer(); start it with start()."""
    return frames.writeStream.foreachBatch(batch_writer(path, work)).option("checkpointLocation", checkpoint)


def written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What frames_to() has written, with the batch of each row."""
    return spark.read.schema(f"{schema}, batch long").parquet(path)
