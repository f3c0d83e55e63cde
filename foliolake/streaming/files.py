"""PDF files as a stream: the same tables, for files as they arrive. Nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pdf.scan import scan


def stream(spark: SparkSession, path: str, table: str, per_batch: int = 100, password: str = "") -> DataFrame:
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_batch).load(path)
    return scan(files.select(F.col("path").alias("doc_id"), "content"), table, password)
