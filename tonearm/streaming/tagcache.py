"""Incremental scans: a keyed cache of tags, and its micro-batch form.

A file is known by path, size and whole second of change. A key with null tags was tried
and failed; it counts as attempted until a refresh asks for failures again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cache_key() -> Column:
    """Key of a file; null, and so never in a cache, where its size or time is not known."""
    return F.concat("path", F.lit("|"), "size", F.lit("|"), F.floor(F.col("mtime")).cast("long").cast("string"))


def misses(files: DataFrame, cache: DataFrame, refresh: bool = False) -> DataFrame:
    """Files (cache_key, ...) to read: those without a cache row, with ``refresh`` also those that failed."""
    done = cache.where("tags is not null") if refresh else cache
    return files.join(done.select("cache_key").distinct(), "cache_key", "left_anti")


def merged(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache rows with the fresh ones in place of rows of the same key."""
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh)


def stream_scan(spark: SparkSession, listing: str, schema: str, cache_path: str, checkpoint: str, read_tags: Callable[[DataFrame], DataFrame], max_files: int = 1000):
    """Start a query that reads only files not yet in the cache, one cache segment per micro-batch.

    ``listing`` is a folder of parquet listings (path, size, mtime). A batch that runs twice
    after a failure overwrites its own segment, so the cache holds each key once.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(listing)

    def flush(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("cache_key", cache_key()).dropDuplicates(["cache_key"])
        own = f"{cache_path}/batch={number}"
        fs = spark._jvm.org.apache.hadoop.fs.Path(cache_path).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(cache_path)):
            cache = spark.read.parquet(cache_path).where(F.col("batch") != number)
            keyed = misses(keyed, cache)
        read_tags(keyed).write.mode("overwrite").parquet(own)

    return source.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_points(total: int, every: int) -> list[int]:
    """Counts at which a scan reports: each ``every`` files and the last."""
    points = list(range(every, total + 1, every))
    return points if not total or (points and points[-1] == total) else [*points, total]
