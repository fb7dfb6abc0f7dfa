"""A folder that PDF files are dropped into, as a stream of parsed objects.

The file source remembers which files it has seen in the query's checkpoint, so each file is parsed once
and a query that is restarted elsewhere goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources.pdf_tables import parse_files

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.option("maxFilesPerTrigger", per_trigger).load(folder).select("path", "content")


def write_objects(spark: SparkSession, folder: str, target: str, checkpoint: str, with_content: bool = False) -> StreamingQuery:
    """Appends the parsed objects of all new files to Parquet and stops when the folder has been read."""
    parsed = parse_files(stream_files(spark, folder), with_content)
    writer = parsed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()
