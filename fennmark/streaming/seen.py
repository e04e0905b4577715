"""A seen-set as a stream: rows of new files whose key has not come before, with the keys kept in the stream's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..stored import work_folder


def new_keys(source: DataFrame, keys: list[str], folder: str, watermark: tuple[str, str] | None = None) -> None:
    """Append the first row of each key in `source`, a stream, to `folder`/rows, and stop when all that is there has been read.

    Started again with the same folder it goes on where it stopped. Without a watermark (a time column and a delay)
    the state holds every key that ever came; with one, keys older than it are let go and later rows with them are dropped as late."""
    once = source.withWatermark(*watermark).dropDuplicatesWithinWatermark(keys) if watermark else source.dropDuplicates(keys)
    query = once.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def seen_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The distinct keys of the files at `path`, by one run of the stream."""
    schema = spark.read.parquet(path).select(*keys).schema
    folder = work_folder(spark, "seen")
    new_keys(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), keys, folder)  # as a pattern, a path may be a single file
    return spark.read.schema(schema).parquet(f"{folder}/rows")
