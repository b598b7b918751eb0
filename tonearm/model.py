"""The record model: column names, tiers of the match cascade and their order."""

from __future__ import annotations

#: Attributes that a merge compares, by kind.
EDITORIAL = ["artist", "title", "album"]
MEASURED = ["filesize", "playtime_float", "bitrate"]
TRACKED = ["artist", "title", "album", "filesize", "playtime_float", "bitrate"]
#: Tiers in cascade order with the least level that admits each.
TIERS = [
    ("audio_id", "strict"), ("artist_title_size_time", "strict"), ("artist_title_file", "strict"), ("file_size_time", "strict"),
    ("artist_title_album_time", "strict"), ("path_suffix_3", "strict"), ("path_suffix_2", "loose"), ("artist_title", "loose"),
    ("path_suffix_1", "loose"), ("bare_name_in_folder", "loose"), ("filename", "filename"), ("bare_name", "filename"),
]
LEVELS = ["strict", "loose", "filename"]
#: Tiers that a size or time never refutes.
NOT_REFUTABLE = {"audio_id"}
#: Tiers that work without tags.
TAG_FREE = {"audio_id", "file_size_time", "path_suffix_3", "path_suffix_2", "path_suffix_1", "bare_name_in_folder", "filename", "bare_name"}
#: Share of size and seconds of time beyond which two records are not one.
SIZE_SHARE, SECONDS, CROSS_TIME_SHARE = 0.02, 1.0, 0.15
#: Share by which a measured value may differ before it is an outlier.
OUTLIER_SHARE = "0.01"
#: Suffixes of audio files.
AUDIO_SUFFIXES = [".mp3", ".flac", ".wav", ".aiff", ".aif", ".m4a", ".ogg", ".stem.mp3", ".stem.flac"]
#: How a match of each tier is described; any other tier is Weak.
STRONG = ["audio_id", "artist_title_size_time", "artist_title_file", "file_size_time"]
GOOD = ["artist_title_album_time", "path_suffix_3"]


def admitted(level: str) -> list[str]:
    """Names of the tiers that a level admits, in cascade order."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    return [t for t, least in TIERS if LEVELS.index(least) <= LEVELS.index(level)]


def tag_free(level: str) -> list[str]:
    return [t for t in admitted(level) if t in TAG_FREE]


def confidence_label(tier: str | None) -> str:
    return "None" if tier is None else "Strong" if tier in STRONG else "Good" if tier in GOOD else "Weak"
