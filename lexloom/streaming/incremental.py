"""Incremental runs: new files are extracted, cleaned and split as they come, each written once.

A run is a Structured Streaming query over the folder; its checkpoint remembers the files done, and each
micro-batch is written under its own number, so that a batch that runs again after a loss replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import cleaning as C
from ..functions import segment as S
from ..functions.profiles import Profile, Toggles
from ..sources.files import extracted

BINARY = "path string, modificationTime timestamp, length long, content binary"


def sentences_of(files: DataFrame, profile: Profile = Profile(), on: Toggles = Toggles()) -> DataFrame:
    """``path, n, sentence`` of files' rows, cleaned by the whole chain."""
    rows = extracted(files).filter("text is not null").select("path", C.chain(F.col("text"), profile, on).alias("text"))
    return rows.select("path", F.posexplode(S.sentences(F.col("text"), profile.abbreviations)).alias("n", "sentence")).withColumn("n", F.col("n") + 1)


def run(spark: SparkSession, source: str, target: str, checkpoint: str, profile: Profile = Profile(), per_batch: int = 1000, on: Toggles = Toggles()) -> StreamingQuery:
    """Process what is new and end. Call again for what comes later."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(source)

    def write(batch: DataFrame, number: int) -> None:
        sentences_of(batch, profile, on).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events by type in windows of event time, late ones dropped after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
