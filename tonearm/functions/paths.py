"""Folder lists, keys and file names of a collection as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "/:"


def casefold(text: Column) -> Column:
    """Unicode case folding inside the JVM; null stays null."""
    # The dotless i has no part in folding; the step between the two keeps the planner from merging them.
    up = F.translate(F.upper(F.translate(text, "\u0131", "\ue000")), "\ue001", "\ue001")
    return F.translate(F.lower(up), "\u03c2\ue000", "\u03c3\u0131")


def folder_parts(dir_value: Column) -> Column:
    """The folders of an encoded folder list, outermost first; empty and `.` components fall away."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(dir_value, F.lit("")), "/:", "/"), "/"), lambda p: (p != "") & (p != "."))


def decode_dir(dir_value: Column) -> Column:
    """`/:A/:B/:` as `A/B`."""
    return F.array_join(folder_parts(dir_value), "/")


def decoded_path(dir_value: Column, file_name: Column) -> Column:
    return F.concat_ws("/", F.array_join(folder_parts(dir_value), "/"), file_name)


def encode_dir(path: Column) -> Column:
    """A human path as an encoded folder list. An empty path gives `/:/:`."""
    parts = F.filter(F.split(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: p != "")
    return F.concat(F.lit(SEP), F.array_join(parts, SEP), F.lit(SEP))


def normalize_prefix(value: Column) -> Column:
    """An encoded prefix as it is (with both separators), a human path encoded."""
    inner = F.regexp_replace(F.regexp_replace(value, "^(/:)+", ""), "(/:)+$", "")
    encoded = F.when(inner == "", F.lit("/:/:")).otherwise(F.concat(F.lit(SEP), inner, F.lit(SEP)))
    return F.when(F.contains(value, F.lit(SEP)), encoded).otherwise(encode_dir(value))


def primary_key(volume: Column, dir_value: Column, file_name: Column) -> Column:
    return F.concat(*[F.coalesce(c, F.lit("")) for c in (volume, dir_value, file_name)])


def parse_key(key: Column) -> Column:
    """struct(volume, dir, file) of a key, null for a key without a folder list."""
    volume, name = F.substring_index(key, SEP, 1), F.substring_index(key, SEP, -1)
    middle = F.substring(key, F.length(volume) + 1, F.length(key) - F.length(volume) - F.length(name))
    return F.when(F.contains(key, F.lit(SEP)), F.struct(volume.alias("volume"), middle.alias("dir"), name.alias("file")))


def bare_name(file_name: Column) -> Column:
    """File name without its container suffix, folded; null where nothing is left."""
    stem = F.regexp_replace(file_name, r"(?i)(\.stem)?\.[A-Za-z0-9]{1,5}$", "")
    return F.nullif(casefold(stem), F.lit(""))


def path_suffix(parts: Column, file_name: Column, depth: int) -> Column:
    """The last ``depth`` folders and the file name, folded and joined; null where there are fewer."""
    tail = F.slice(parts, -depth, depth)
    return F.when((F.size(parts) >= depth) & (file_name != ""), F.concat_ws("\x1f", casefold(F.array_join(tail, "\x1f")), casefold(file_name)))


def audio_file(name: Column, suffixes: list[str]) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | low.endswith(s)
    return hit


def label(artist: Column, title: Column, fallback: Column) -> Column:
    """`artist - title` without dangling dash, or the fallback."""
    both = F.concat(F.coalesce(artist, F.lit("")), F.lit(" - "), F.coalesce(title, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_replace(both, "^[ -]+|[ -]+$", ""), F.lit("")), fallback)
