"""Streams: files as they arrive, and heart-rate measures of live beats. An addition to what batch offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_files(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, content) for :func:`pulsegrid.sources.reader.detect`; a trigger takes a bounded number of files."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "content")


def heart_rate_windows(beats: DataFrame, key: str = "user_id", at: str = "ts", window: str = "1 minute", lateness: str = "2 minutes") -> DataFrame:
    """(key, start, beats, mean_hr) over tumbling windows of beat times; beats later than ``lateness`` are left out.

    The rate follows from the first and last beat of a window: what a window needs is two times and a count, so the state
    of a key does not grow with its beats.
    """
    w = beats.withWatermark(at, lateness).groupBy(key, F.window(at, window)).agg(F.count("*").alias("beats"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    span = F.unix_millis("hi") - F.unix_millis("lo")
    return w.select(key, F.col("window.start").alias("start"), "beats", F.when(span > 0, F.lit(60000.0) * (F.col("beats") - 1) / span).alias("mean_hr"))
