"""Image trees as tables: images, label files, sidecar texts, class names; and the sinks for results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import basename, extension, parent, stem
from tessera.functions.text import collapse
from tessera.operators.labels import is_yolo_text

# Suffixes of images and sidecars, folders that are skipped, names of folder notes, keys of captions.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".webp", ".gif", ".tif", ".tiff"]
SIDECAR_SUFFIXES = [".txt", ".caption", ".json"]
SKIPPED = [".git", "__pycache__", "thumbs", ".thumbs", ".cache", "$recycle.bin"]
NOTES = ["caption.txt", "readme.txt", "description.txt", "info.txt"]
CAPTION_KEYS = ("caption", "text", "description", "desc", "prompt", "label")


def plain_path(path: Column) -> Column:
    """A path without the file scheme; other schemes stay."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"\+", "%2B"), r"^file:/+", "/"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under ``root``: (path, seconds, length), without folders that are hidden or skipped.

    Spark lists the tree; only names and sizes are read. It leaves out empty files and names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    rows = files.select(plain_path(F.col("path")).alias("path"), (F.unix_micros("modificationTime") / 1e6).alias("seconds"), "length")
    base = root.rstrip("/")
    inside = F.split(parent(F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 100_000)).otherwise(F.col("path"))), "/")
    return rows.filter(~F.exists(inside, lambda d: d.startswith(".") | F.lower(d).isin(SKIPPED)))


def images(files: DataFrame, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """The images among files, with ``folder`` and ``stem``."""
    return files.filter(extension(F.col("path")).isin(suffixes)).withColumn("folder", parent(F.col("path"))).withColumn("stem", stem(F.col("path")))


def leaf_folders(found: DataFrame) -> DataFrame:
    """Folders that directly hold images: (folder, n_images)."""
    return found.groupBy("folder").agg(F.count("*").alias("n_images"))


def texts(spark: SparkSession, root: str, suffixes: list[str] = SIDECAR_SUFFIXES) -> DataFrame:
    """Text files under ``root``: (path, folder, stem, suffix, text, seconds)."""
    glob = "*{" + ",".join(suffixes) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = rows.select(plain_path(F.col("path")).alias("path"), F.col("content").cast("string").alias("text"), (F.unix_micros("modificationTime") / 1e6).alias("seconds"))
    return rows.select("path", parent(F.col("path")).alias("folder"), stem(F.col("path")).alias("stem"), extension(F.col("path")).alias("suffix"), "text", "seconds")


@F.pandas_udf(T.StringType())
def json_caption(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The caption in a JSON object: the first known key that holds a string, else all strings in a row; other texts stay as they are."""

    def one(raw):
        if raw is None:
            return None
        try:
            data = json.loads(raw)
        except ValueError:
            return raw
        if not isinstance(data, dict):
            return raw
        named = [data[k] for k in CAPTION_KEYS if isinstance(data.get(k), str)]
        return (named[0] if named else " ".join(v for v in data.values() if isinstance(v, str))).strip()

    for batch in batches:
        yield batch.map(one)


def sidecar_texts(found: DataFrame) -> DataFrame:
    """Adds ``content``: what the file says of its image; empty for label files."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    labels = (F.col("suffix") == ".txt") & is_yolo_text(text)
    plain = found.filter("suffix <> '.json'").withColumn("content", F.when(labels, F.lit("")).otherwise(text))
    parsed = found.filter("suffix = '.json'").withColumn("content", json_caption(text))
    return plain.unionByName(parsed)


def with_sidecar(found: DataFrame, sidecars: DataFrame, suffixes: list[str] = SIDECAR_SUFFIXES) -> DataFrame:
    """Images with the first sidecar of the same stem that says something, by the order of ``suffixes``: adds ``sidecar`` ('' if none)."""
    rank = F.array_position(F.array(*map(F.lit, suffixes)), F.col("suffix"))
    best = sidecars.filter("content <> ''").groupBy("folder", "stem").agg(F.min_by("content", rank).alias("sidecar"))
    return found.join(best, ["folder", "stem"], "left").withColumn("sidecar", F.coalesce("sidecar", F.lit("")))


def folder_texts(with_text: DataFrame, sidecars: DataFrame, max_items: int = 8, max_chars: int = 800) -> DataFrame:
    """Text of each folder: its notes, then the sidecars of its first ``max_items`` images, each text once, at most ``max_chars``."""
    notes = sidecars.filter(F.lower(basename(F.col("path"))).isin(NOTES) & (F.col("content") != "")).select(
        "folder", F.array_position(F.array(*map(F.lit, NOTES)), F.lower(basename(F.col("path")))).cast("int").alias("pos"), F.col("content").alias("t")
    )
    first = with_text.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy(F.lower("path"), "path"))).filter(F.col("r") <= max_items)
    own = first.filter("sidecar <> ''").select("folder", (F.col("r") + 100).alias("pos"), F.col("sidecar").alias("t"))
    listed = notes.unionByName(own).groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("l"))
    joined = F.array_join(F.transform(F.array_distinct(F.transform("l", lambda x: x["t"])), collapse), " ")
    return listed.select("folder", F.left(joined, F.lit(max_chars)).alias("sidecar_text"))


def labels(found: DataFrame, text_files: DataFrame) -> DataFrame:
    """Images with the text of the label file of the same stem: (path, label_text, label_seconds), null without one."""
    files = text_files.filter("suffix = '.txt'").select("folder", "stem", F.col("text").alias("label_text"), F.col("seconds").alias("label_seconds"), F.col("path").alias("label_path"))
    return found.join(files, ["folder", "stem"], "left").withColumn("label_text", F.when(F.col("label_path") != F.col("path"), F.col("label_text"))).select("path", "folder", "label_text", "label_seconds")


def directory_size(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def dataset_profile(found: DataFrame) -> DataFrame:
    """Profile of a tree, one row: folders, images and the spread of images over folders."""
    sizes = leaf_folders(found)
    return sizes.agg(F.count("*").alias("folders"), F.coalesce(F.sum("n_images"), F.lit(0)).alias("images"), F.min("n_images").alias("least"), F.max("n_images").alias("most"), F.avg("n_images").alias("mean"), F.median("n_images").alias("median"))


def suffix_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(extension(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"))


# class names and settings: small files that the driver reads


def _yaml(text: str):
    try:
        import yaml
    except ImportError:
        return _flat_yaml(text)
    return yaml.safe_load(text)


def _flat_yaml(text: str):
    """Class-name files without a YAML library: ``names:`` with a list or a mapping, or a mapping."""
    top: dict = {}
    name = None
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        item = bare.strip()
        if not item or item.startswith("#"):
            continue
        if item.startswith("- ") and name:
            if not isinstance(top[name], list):
                top[name] = []
            top[name].append(item[2:].strip().strip("'\""))
        elif ":" in item:
            key, _, value = (x.strip().strip("'\"") for x in item.partition(":"))
            if line[0] in " \t" and name and isinstance(top[name], dict):
                top[name][key] = value
            elif value.startswith("[") or value.startswith("{"):
                top[key] = json.loads(value) if '"' in value else [x.strip() for x in value.strip("[]").split(",")]
            else:
                name, top[key] = key, value or {}
    return top


def class_names(text: str) -> dict[str, str]:
    """Names by class id from a YAML text: ``names`` as a mapping or a list, or a mapping by itself; anything else gives none."""
    try:
        data = _yaml(text)
    except Exception:  # noqa: BLE001
        return {}
    if not isinstance(data, dict):
        return {}
    names = data.get("names", data)
    if isinstance(names, list):
        names = dict(enumerate(names))
    return {str(k): str(v) for k, v in names.items()} if isinstance(names, dict) else {}


def class_table(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    rows = [(int(k), v) for k, v in names.items() if str(k).lstrip("-").isdigit()]
    return spark.createDataFrame(rows, "cid int, name string")


def save_class_names(path: str, names: dict[str, str]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("names:\n" + "".join(f"  {k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in sorted(names.items(), key=lambda x: (not x[0].isdigit(), int(x[0]) if x[0].isdigit() else 0, x[0]))))


def export_csv(rows: DataFrame, path: str) -> int:
    """A result as one CSV file with a byte-order mark, in the order of ``rows``; for the few rows of a result. Returns their number."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for row in rows.toLocalIterator():
            out.writerow(list(row))
            n += 1
    return n


def path_list(rows: DataFrame) -> str:
    return "\n".join(r["image_path"] for r in rows.select("image_path").toLocalIterator())

