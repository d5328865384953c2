"""The corpus pipeline: quality rules, near-duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  run() writes each stage's result as Parquet in the shared checkpoint folder and
reads it again for the next one; a stage's table is deleted once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.packing import packed
from quarry.llm.quality import drop_low_quality
from quarry.llm.similar import keep_one_of_each_group
from quarry.llm.suffix_array import drop_repeats
from quarry.session import freed, reread, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and do not diverge from their language."""
    return drop_low_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts."""
    return keep_one_of_each_group(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document with a smaller id has too."""
    return drop_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and batches."""
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("packing", packing)]

#: Fingerprints (XXH64), connected groups and the dynamic programme are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path, before = f"{folder}/{name}", docs
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = reread(spark, path, out.schema)
        if k:
            freed(before)
    return docs
