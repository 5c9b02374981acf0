"""Running a stream over files that are there, and reading what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.session import ensure_checkpoint_dir
from siftmill.sources.tables import TABLE_DDL


def utc_instant(ts: Column) -> Column:
    """A zone-less timestamp as the instant it names in UTC, whatever the session zone.

    Watermarks need an instant; the table columns carry no zone.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, ts))


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 16, name: str = "events.parquet") -> DataFrame:
    """The event table, a folder of part files or one file, as a stream with ``event_time`` for watermarks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}")
    is_folder = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(TABLE_DDL["events"]).option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(f"{sf_dir}/{name}") if is_folder else reader.option("pathGlobFilter", name).parquet(sf_dir)
    return raw.withColumn("event_time", utc_instant(F.col("ts"))).withColumn("k", F.from_json("props", "k bigint")["k"])


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available, append it to a Parquet table in the shared folder, read it back."""
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
