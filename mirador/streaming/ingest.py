"""Streams of pages and articles into the knowledge base.

The knowledge base is a folder of parquet by batch: a batch writes its own folder, so one that is run again after a
failure overwrites its own rows and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import entity_key, first_of_group
from ..sources.formats import articles
from ..sources.tables import exists


def feed_drops(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """A stream of the articles in feed files that are dropped into a folder."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("xml"))
    return articles(files, since=since)


def once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """A stream without repeats of ``key`` within the time that late rows may take; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts_by_hour(stream: DataFrame, time: str, by: str, late: str = "2 hours") -> DataFrame:
    """Rows per hour and ``by``, final once the watermark has passed the hour."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("w"), by).agg(F.count("*").alias("rows")).select(F.col("w.start").alias("hour"), by, "rows")


def upsert_stream(stream: DataFrame, kb: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Writes the entities (name, wikidataId, ...) of each batch that the knowledge base at ``kb`` doesn't have, once per key."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keyed = transform(batch).withColumn("key", entity_key(F.col("name"), F.col("wikidataId")))
        # Of rows of one key the one that sorts first stays, whatever the partitions.
        rows = first_of_group(keyed, ["key"], [F.to_json(F.struct(*keyed.columns))])
        if exists(spark, kb):
            # Only the key column is read; batches are folders, so the batch's own earlier try is pruned.
            known = spark.read.option("mergeSchema", False).parquet(kb).where(F.col("batch") != number).select("key")
            rows = rows.join(known, "key", "left_anti")
        rows.write.mode("overwrite").parquet(f"{kb}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
