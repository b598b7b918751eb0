"""Audio files on disk as records: recursive scans, explicit lists, tags and fingerprints."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonearm import model
from tonearm.functions import paths

SCHEMA = "path string, size long, mtime double"
TAGS = "artist string, title string, album string, playtime_float string, bitrate string"


def scan(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(path, size, mtime, root_ord) of the audio files below the roots, each path once at its first root.

    Listing goes through Spark's file index, so object stores work and large trees list in parallel.
    """
    found = None
    for i, root in enumerate(roots):
        one = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        one = one.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("ms"), F.lit(i).alias("root_ord"))
        found = one if found is None else found.unionByName(one)
    audio = found.where(paths.audio_file(F.element_at(F.split("path", "/"), -1), model.AUDIO_SUFFIXES))
    first = Window.partitionBy("path").orderBy("root_ord")
    return audio.withColumn("r", F.row_number().over(first)).where("r = 1").select("path", "size", (F.col("ms") / 1000).alias("mtime"), "root_ord")


def explicit(spark: SparkSession, names: list[str]) -> DataFrame:
    """(ord, path, size, mtime) of listed files in their order, repeats kept; a missing file is an error."""
    rows = [(i, p, os.stat(p).st_size, os.stat(p).st_mtime) for i, p in enumerate(names)]
    return spark.createDataFrame(rows, "ord int, " + SCHEMA)


def read_tags(files: DataFrame) -> DataFrame:
    """Files with a struct of their tags, null where the reader is absent or fails."""

    def tags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import mutagen
        except ImportError:
            mutagen = None
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                row = (None,) * 5
                try:
                    f = mutagen.File(path, easy=True) if mutagen else None
                    if f is not None:
                        one = lambda k, f=f: (f.get(k) or [""])[0]
                        row = (one("artist"), one("title"), one("album"), f"{f.info.length:.3f}", str(int(getattr(f.info, "bitrate", 0) / 1000)))
                except Exception:  # noqa: BLE001  a file that cannot be read has no tags
                    pass
                out.append((path, *row))
            yield pd.DataFrame(out, columns=["path", "artist", "title", "album", "playtime_float", "bitrate"])

    return files.select("path").mapInPandas(tags, "path string, " + TAGS)


def records(files: DataFrame, tags: DataFrame) -> DataFrame:
    """Records of scanned files: size in kilobytes, tags or empty, folders from the path, never an audio id."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.join(tags, "path", "left").select(
        F.xxhash64("path").alias("rid"), F.col("path").alias("source_path"), blank("artist"), blank("title"), blank("album"), F.lit("").alias("audio_id"),
        F.bround(F.col("size") / 1024, 0).cast("long").cast("string").alias("filesize"), blank("playtime_float"), blank("bitrate"),
        F.lit("").alias("volume"), F.lit("").alias("volumeid"), paths.encode_dir(folder).alias("dir"), F.substring_index("path", "/", -1).alias("file"),
        F.concat(paths.encode_dir(folder), F.substring_index("path", "/", -1)).alias("primary_key"), F.lit(True).alias("from_disk"),
    )


def parse_fingerprint(output: str) -> tuple[float, str] | None:
    """(seconds, fingerprint) of the external tool's output, or None."""
    found = dict(line.split("=", 1) for line in output.splitlines() if "=" in line)
    try:
        return float(found["DURATION"]), found["FINGERPRINT"]
    except (KeyError, ValueError):
        return None


def fingerprints(files: DataFrame, tool: str = "fpcalc", seconds: int = 120, timeout: int = 30) -> DataFrame:
    """(path, sec, fingerprint) through an external process, null where it is absent, fails or takes too long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                try:
                    done = subprocess.run([tool, "-length", str(seconds), path], capture_output=True, text=True, timeout=timeout, check=True)
                    got = parse_fingerprint(done.stdout)
                except (OSError, subprocess.SubprocessError):
                    got = None
                out.append((path, *(got or (None, None))))
            yield pd.DataFrame(out, columns=["path", "sec", "fingerprint"])

    return files.select("path").mapInPandas(run, "path string, sec double, fingerprint string")
