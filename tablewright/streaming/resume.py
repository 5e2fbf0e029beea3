"""A resumable job: each run handles only the files that came since the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_new_files(
    spark: SparkSession, source: str, schema: T.StructType | str, transform: Callable[[DataFrame], DataFrame],
    target: str, progress: str, fmt: str = "parquet", files: str | None = None, max_files: int | None = None,
) -> None:
    """Transform files of ``source`` not seen before and append to ``target``.

    ``progress`` remembers the files done; a run that dies is repeated from
    there, and the parquet sink lists only finished batches.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    query = (
        transform(reader.load(source))
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
