"""Ingest of arriving files into a catalog: each key once, over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terraloom.sources.files import new_rows


def ingest(spark: SparkSession, source: str, schema: str, catalog: str, checkpoint: str, keys: list[str], order: str, *, files_per_trigger: int = 64) -> StreamingQuery:
    """Add the rows of Parquet files that arrive in source to catalog, those with keys that it lacks, and stop when none is left.

    The checkpoint remembers the files done; a batch that a crash repeats adds nothing twice, as its keys are in the
    catalog already. files_per_trigger bounds a batch.
    """

    def add(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(catalog)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        known = spark.read.schema(schema).parquet(catalog) if there else spark.createDataFrame([], schema)
        new_rows(batch, known, keys, order).write.mode("append").parquet(catalog)

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
