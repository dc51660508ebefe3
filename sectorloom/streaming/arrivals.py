"""Segments that arrive one by one: a stream of new files with their family, for a folder that is filled while it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sectorloom.functions.scalar import signature_format

_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_segments(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified, family) of each new file; family null for files that are no segments."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", files["modificationTime"].alias("modified"), signature_format(files["content"]).alias("family"))
