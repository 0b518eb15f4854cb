"""A folder watched for new books: each micro-batch is checked, repaired and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textmend.sources import epub


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """The stream of (book, content) of files that appear in the folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.epub").load(path)
    return files.selectExpr("path AS book", "content")


def write_batch(batch: DataFrame, number: int, out: str) -> None:
    """Write one batch to the folder of its number. A batch that is run again after a failure writes the same folder anew, so
    that no file is repeated."""
    epub.checked(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the checked and repaired books of the folder below ``out``, one folder for each batch. The checkpoint keeps what was
    done, so that a restart neither drops nor repeats a file."""
    writer = incoming(spark, path).writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
