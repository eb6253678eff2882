"""Keys and projections of index records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def image_id(path: Column) -> Column:
    """SHA-1 of a path, whatever its slashes and letter case."""
    return F.sha1(F.lower(slashes(path)).cast("binary"))


def folder_id(path: Column) -> Column:
    """As :func:`image_id`, without slashes at the end."""
    return F.sha1(F.regexp_replace(F.lower(slashes(path)), "/+$", "").cast("binary"))


def parent(path: Column) -> Column:
    return F.regexp_replace(slashes(path), "/[^/]*$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(slashes(path), "([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """The name of a file without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]+)$", 1))


def path_text(path: Column) -> Column:
    """What a path says: its last two folders and its stem."""
    folders = F.filter(F.split(parent(path), "/"), lambda x: x != "")
    last = F.slice(folders, F.greatest(F.lit(1), F.size(folders) - 1), F.lit(2))
    return F.concat_ws(" ", last, stem(path))


def change_key(seconds: Column) -> Column:
    """A modification time as text of three decimals; '0' if there is none."""
    return F.coalesce(F.format_string("%.3f", seconds.cast("double")), F.lit("0"))


def composite_key(image: Column, label: Column) -> Column:
    """The change keys of an image and of its label file, which may be missing."""
    return F.concat_ws("|", image, label)


def folder_document(caption: Column, sidecar: Column, path: Column) -> Column:
    """Text of a folder record: caption and sidecar text, or the path if both are blank."""
    text = F.regexp_replace(F.concat(F.coalesce(caption, F.lit("")), F.lit("\n"), F.coalesce(sidecar, F.lit(""))), r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), path)


def image_document(caption: Column, path: Column) -> Column:
    """Text of an image record: its caption or its file name."""
    return F.coalesce(F.nullif(F.trim(caption), F.lit("")), basename(path))


def display_caption(caption: Column, document: Column) -> Column:
    return F.coalesce(F.nullif(caption, F.lit("")), document, F.lit(""))


def badge(match: Column) -> Column:
    """Mark of where a hit comes from."""
    return F.when(match == "vector", "V").when(match == "keyword", "K").when(match == "both", "V+K").when(match == "graph", "G").otherwise("")


def passes_threshold(score: Column, match: Column, threshold: float) -> Column:
    """Whether a hit is shown: its score is high enough, or the graph brought it. A score that is no number isn't high."""
    high = score.isNotNull() & ~F.isnan(score) & (score >= threshold)
    return high | F.coalesce(match == "graph", F.lit(False))
