"""Additive counts kept by Structured Streaming: the incremental form of the count-based learners."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import shared_folder


def stream_table(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A growing folder of Parquet files, or a single file, as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), where.getParent().toString()
    return reader.parquet(path)


def streamed(counts: Callable[[DataFrame], DataFrame], stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All counts after everything that is there now; state is one row a group.

    Every batch writes all counts as a table of its own under `folder` (one in the shared folder if none is
    named), which also holds the stream's checkpoint; nothing gathers on the driver.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    whole = counts(stream)

    def keep(frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    run = whole.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress
    done = [p["batchId"] for p in run.recentProgress if p["numInputRows"]] or ([last["batchId"]] if last else [])
    return spark.read.schema(whole.schema).parquet(f"{folder}/batch={max(done)}") if done else spark.createDataFrame([], whole.schema)
