"""Sessions and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(cores: int = 8, shuffle_partitions: int = 8, checkpoint_dir: str | None = None, memory: str = "8g") -> SparkSession:
    """A session for one machine: adaptive plans, UTC, few shuffle partitions."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in os.environ.get("PYTHONPATH", "").split(":"):
        os.environ["PYTHONPATH"] = ":".join(x for x in (root, os.environ.get("PYTHONPATH")) if x)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only where that setting is missing (one machine, tests) it is one in the session's warehouse.
    """
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame computed once, written as a table in the shared folder and read back; `freed` deletes it."""
    path = f"{shared_folder(frame.sparkSession)}/quarry-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return reread(frame.sparkSession, path, frame.schema)


def reread(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    out = spark.read.schema(schema).parquet(path)
    out._quarry_path = path
    return out


def freed(frame: DataFrame) -> None:
    """Deletes the table behind what `checkpointed` returned, once nothing reads it any more."""
    spark, path = frame.sparkSession, frame._quarry_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    tidied(spark)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more (it does so when the driver collects garbage)."""
    spark._jvm.System.gc()
