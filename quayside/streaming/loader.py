"""Loading from a folder as a stream: new monthly files are picked up, and the content hash decides what is loaded.

The file source remembers paths, so a file that is changed in place is not offered again; a batch load over the folder finds it by
its hash. The hash record stays the truth in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.load import load_files
from quayside.sources.trips import month_of_file


def load_stream(spark: SparkSession, folder: str, root: str, checkpoint: str):
    """Start a query that loads all files there are and ends; started again, it goes on with what is new."""
    schema = "path string, modificationTime timestamp, length long, content binary"  # of the format; content isn't read
    names = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "yellow_tripdata_*.parquet").load(folder).select("path")

    def load(batch: DataFrame, _: int) -> None:
        files = batch.where(month_of_file(F.col("path")).isNotNull()).select("path").orderBy("path").collect()  # a row a file
        if files:
            load_files(spark, [r["path"] for r in files], root)

    return names.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
