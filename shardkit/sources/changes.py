"""Streams of row changes of shards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Kinds of changes.
INSERT = "I"
UPDATE = "U"
DELETE = "D"


def change_feed(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    name_glob: str = "*.parquet",
    max_files: int | None = None,
) -> DataFrame:
    """Stream of the change files below a path, new ones as they appear.

    `max_files` bounds the files, and so the work, of one micro-batch.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
