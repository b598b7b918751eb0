"""External request lists: plain text, CSV, M3U and folders.

Each reader gives rows (line_number, raw_text, kind, artist, title, album, playtime_float,
file, folders) with kind `track` or `unparseable`; list files are small documents and are
parsed whole, many of them in parallel through ``read_lists``.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator
from pathlib import PurePosixPath, PureWindowsPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm import model

SCHEMA = "list_id string, line_number int, raw_text string, kind string, artist string, title string, album string, playtime_float string, file string, folders array<string>"
#: Columns of a CSV list; the first two are required.
COLUMNS = ["Artist", "Title", "Album", "Duration", "File name"]
#: Bytes that the western code page leaves undefined.
_UNDEFINED = {0x81: "\x81", 0x8D: "\x8d", 0x8F: "\x8f", 0x90: "\x90", 0x9D: "\x9d"}


class ListError(ValueError):
    """A list that cannot be read; the message is the reason."""


def decode(data: bytes, strict: bool = False) -> str:
    """UTF-8 with or without mark, else the western code page (unless ``strict``)."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        if strict:
            raise ListError("not UTF-8") from None
        return "".join(_UNDEFINED.get(b) or bytes([b]).decode("cp1252") for b in data)


def _row(number: int, raw: str, kind: str = "unparseable", artist: str = "", title: str = "", album: str = "", time: str = "", file: str = "", folders: tuple = ()) -> tuple:
    return number, raw, kind, artist, title, album, time, file, list(folders)


def parse_text(data: bytes) -> list[tuple]:
    out = []
    for n, raw in enumerate(decode(data, strict=True).splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        artist, dash, title = re.sub(r"^\d+\s*-\s*", "", line, count=1).partition(" - ")
        ok = bool(dash and artist.strip() and title.strip())
        out.append(_row(n, raw, "track", artist.strip(), title.strip()) if ok else _row(n, raw))
    return out


def duration(text: str) -> str:
    m = re.fullmatch(r"(?:(?:(\d+):)?(\d+):)?(\d+(?:\.\d+)?)", text.strip())
    seconds = sum(float(v or 0) * f for v, f in zip(m.groups(), (3600, 60, 1), strict=True)) if m else 0
    return f"{seconds:.3f}" if seconds > 0 else ""


def parse_csv(data: bytes) -> list[tuple]:
    """Rows by header name, comma or semicolon; each with the physical line it starts on."""
    text = decode(data)
    head = text.split("\n", 1)[0].strip("\r")
    fold = lambda cells: [c.strip().casefold() for c in cells]
    need = fold(COLUMNS[:2])
    mark = next((d for d in ",;" if set(need) <= set(fold(next(csv.reader([head], delimiter=d), [])))), None)
    if mark is None:
        raise ListError("columns Artist and Title are required")
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=mark)
    names = fold(next(reader))
    at = {c: names.index(c) for c in reversed(names)}
    lines, out, start = text.splitlines(), [], reader.line_num
    for cells in reader:
        first, start = start + 1, reader.line_num
        if not any(c.strip() for c in cells):
            continue
        read = lambda c, cells=cells: cells[at[c]].strip() if c in at and at[c] < len(cells) else ""
        artist, title = read("artist"), read("title")
        raw = "\n".join(lines[first - 1 : start])
        kind = "track" if artist and title else "unparseable"
        out.append(_row(first, raw, kind, artist, title, read("album"), duration(read("duration")), read("file name")))
    return out


def csv_template() -> bytes:
    return ("﻿" + ",".join(COLUMNS) + "\r\n").encode("utf-8")


def parse_extinf(line: str) -> tuple[str, str, str]:
    """(seconds, artist, title) of an extended line, in any letter case; attributes may stand before the comma; what cannot be read is empty."""
    length, _, name = re.sub(r"^#EXTINF:", "", line, flags=re.I).partition(",")
    m = re.match(r"\s*(\d+(?:\.\d+)?)", length)
    seconds = float(m[1]) if m else 0
    artist, dash, title = name.strip().partition(" - ")
    both = dash and artist.strip() and title.strip()
    return f"{seconds:.3f}" if seconds > 0 else "", artist.strip() if both else "", title.strip() if both else ""


def parse_m3u(data: bytes, strict: bool = False) -> list[tuple]:
    """Path lines with the extended line before them. Addresses on the web are unparseable. ``strict`` takes UTF-8 only, as .m3u8 must be."""
    out, told = [], ("", "", "")
    for n, raw in enumerate(decode(data, strict).splitlines(), 1):
        line = raw.strip()
        if line[:8].upper() == "#EXTINF:":
            told = parse_extinf(line)
        if not line or line.startswith("#"):
            continue
        seconds, artist, title = told
        told = ("", "", "")
        if re.match(r"[A-Za-z][\w+.-]+://", line):
            out.append(_row(n, raw))
            continue
        windows = re.match(r"[A-Za-z]:", line) or "\\" in line
        path = PureWindowsPath(line) if windows else PurePosixPath(line)
        folders = [p for p in path.parent.parts if p not in (path.anchor, ".", "..")]
        out.append(_row(n, raw, "track", artist, title, "", seconds, path.name, folders))
    return out


def natural(name: str) -> tuple:
    """Sort key: runs of digits as numbers, the rest folded, the plain name last."""
    return tuple((0, int(p), "") if p.isdigit() else (1, 0, p.casefold()) for p in re.findall(r"\d+|\D+", name)), name


def parse_folder(names: list[str], audio) -> list[tuple]:
    own = sorted((n for n in names if audio(n)), key=natural)
    return [_row(i, n, "track", file=n) for i, n in enumerate(own, 1)]


def detect(path: str) -> str:
    """Format of a list by its name: text, csv, m3u or folder."""
    if os.path.isdir(path):
        return "folder"
    if not os.path.exists(path):
        raise ListError("not found")
    kind = {".txt": "text", ".csv": "csv", ".m3u": "m3u", ".m3u8": "m3u"}.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise ListError("unknown format")
    return kind


PARSERS = {"text": parse_text, "csv": parse_csv, "m3u": parse_m3u}


def read_input(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Request rows of one list, by the format its name tells; a different ``kind`` is refused."""
    found = detect(path)
    if kind is not None and kind != found:
        raise ListError(f"{path!r} is {found}, not {kind}")
    if found == "folder":
        rows = parse_folder(sorted(n for n in os.listdir(path) if os.path.isfile(os.path.join(path, n))), lambda n: n.lower().endswith(tuple(model.AUDIO_SUFFIXES)))
        return spark.createDataFrame([(path, *r) for r in rows], SCHEMA)
    return read_lists(spark, path, found)


def read_lists(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """All lists of one kind below a path (or one file) as request rows."""
    parse = PARSERS[kind]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                got = parse(data, name.lower().endswith(".m3u8")) if kind == "m3u" else parse(data)
                yield pd.DataFrame([(name, *r) for r in got], columns=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(rows, SCHEMA)


def request_records(rows: DataFrame) -> DataFrame:
    """Request rows of kind `track` as records of the cascade: tags, time, file and folders, each where the list names it.

    rid is a number within this frame; (list_id, line_number) stand beside it.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    place = F.concat(F.lit("/:"), F.array_join("folders", "/:"), F.when(F.size("folders") > 0, "/:").otherwise(""))
    return rows.where("kind = 'track'").select(
        F.monotonically_increasing_id().alias("rid"), "list_id", "line_number", text("artist"), text("title"), text("album"), F.lit("").alias("audio_id"), F.lit("").alias("filesize"),
        text("playtime_float"), text("file"), F.when(F.size("folders") > 0, place).otherwise("").alias("dir"), F.lit("").alias("primary_key"), F.lit("").alias("bitrate"),
    )


def index_present(rows: DataFrame, records: DataFrame) -> DataFrame:
    """Request records with size and tags of the files on disk (``records``: file, dir, filesize, playtime_float, artist, title) put in where the
    list names a path that exists; what the list says itself goes first."""
    found = records.groupBy("dir", "file").agg(*[F.min(c).alias("d_" + c) for c in ("filesize", "playtime_float", "artist", "title")])
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("d_" + c), F.lit("")).alias(c)
    met = rows.join(found, ["dir", "file"], "left")
    return met.select(*[own(c) if c in ("filesize", "playtime_float", "artist", "title") else F.col(c) for c in rows.columns])
