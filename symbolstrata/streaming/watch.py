"""Streams of file events and of index deliveries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder


def ingest(spark: SparkSession, source: str, schema: StructType, keys: list[str], columns: list[str], at: str = "loaded_at", late: str = "30 days") -> DataFrame:
    """All deliveries below ``source`` read as a stream until none is left, one row per key, written and read again.

    The state holds the keys of the last ``late`` of event time (``at``), so it doesn't grow with the stream; a key that comes
    again after that is written once more and made one where the rows are read. Nulls in keys make keys of their own; rows
    with a null ``at`` are taken as of 1970.
    """
    folder = f"{shared_folder(spark, 'stream').rstrip('/')}/{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(source).withColumn("_at", F.coalesce(at, F.lit("1970-01-01")).cast("timestamp"))
    stream = rows.withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).select(*columns)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(StructType([f for f in schema if f.name in columns])).parquet(f"{folder}/rows").dropDuplicates(keys)


def coalesced(events: DataFrame, window: str = "1 second", late: str = "10 minutes") -> DataFrame:
    """File events (repo_id, path, kind, at) gathered by window, the last kind of each path: the debounce of a watcher.

    A lone deletion counts like any other event. Works on streams (with a watermark of ``late``) and on tables.
    """
    return events.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "repo_id", "path").agg(F.max(F.struct("at", "kind")).alias("e"), F.count("*").alias("events")).select(F.col("w.start").alias("since"), "repo_id", "path", F.col("e.kind").alias("kind"), "events")


def watched(paths: DataFrame, extensions: list[str]) -> DataFrame:
    """Events of files that an index holds: by extension, outside ignored folders."""
    from ..operators.filters import ignored_by_default
    from ..tables import extension

    return paths.where(F.lower(extension(F.col("path"))).isin(extensions) & ~ignored_by_default(F.col("path")))
