"""Documents that arrive in a folder, converted as they come.

A thin layer over the batch engine: files are a stream source, conversion is stateless, and the sink commits a
batch as a whole, so that a restart neither loses nor repeats documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.functions.limits import DEFAULT, Limits
from leafmill.operators.convert import Engine, listed

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str, glob: str = "*", per_batch: int = 10_000, limits: Limits = DEFAULT) -> DataFrame:
    """A streaming (doc_id, name, length, content); files over the limit come without their bytes.  These are a second source,
    so a checkpoint of a query with one source cannot be carried on."""
    return listed(lambda: spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path), limits)


def convert_files(spark: SparkSession, path: str, output: str, checkpoint: str, engine: Engine | None = None, strict: str = "off", once: bool = True) -> StreamingQuery:
    """Markdown of all files that are new since the last run, appended to Parquet."""
    out = (engine or Engine()).convert(read_files(spark, path), strict=strict)
    w = out.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
