"""Incremental top-ups as a stream: new files of a landing folder, merged into a table by key.

The batch form is tables.upsert; this is its Structured Streaming shape, exactly once through a batch's own
version folder: a batch that runs again rewrites the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfgraph.operators.tables import upsert
from shelfgraph.sources.tables import exists


def latest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The newest whole version of the table, or an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v")] if fs.exists(path) else []
    done = [v for v in versions if exists(spark, f"{folder}/v{v}/_SUCCESS")]
    return spark.read.schema(schema).parquet(f"{folder}/v{max(done)}") if done else spark.createDataFrame([], schema)


def upsert_stream(spark: SparkSession, landing: str, folder: str, key: str, schema, checkpoint: str) -> StreamingQuery:
    """Merges each batch of Parquet files in landing into folder's table; stops when all files there are merged."""

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        base = latest_before(session, folder, schema, number)
        upsert(base, batch.withColumn("__pos", F.monotonically_increasing_id()), key).select(*[f.name for f in base.schema.fields]).write.mode("overwrite").parquet(f"{folder}/v{number}")

    stream = spark.readStream.schema(schema).parquet(landing)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_before(spark: SparkSession, folder: str, schema, number: int) -> DataFrame:
    """The version that batch `number` builds on."""
    for v in range(number - 1, -1, -1):
        if exists(spark, f"{folder}/v{v}/_SUCCESS"):
            return spark.read.schema(schema).parquet(f"{folder}/v{v}")
    return spark.createDataFrame([], schema)
