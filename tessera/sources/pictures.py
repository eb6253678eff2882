"""Pictures made from images: thumbnails, crops of boxes, data URLs; and a small image tree for trials."""

from __future__ import annotations

import base64
import hashlib
import io
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.embedding import pixels, shrink, write_bmp
from tessera.operators.labels import pixel_rect, top_boxes

SCENES = (
    ("harbour", "crane_at_dawn", "A crane lifts a container at dawn"), ("harbour", "ferry_in_fog", "A ferry waits in thick fog"),
    ("orchard", "ladders_in_spring", "Ladders lean on blossoming trees"), ("orchard", "baskets_of_plums", "Baskets of plums stand in the grass"),
    ("workshop", "lathe_and_lamp", "A lathe under a green lamp"), ("station", "tram_in_snow", "A tram stops in fresh snow"),
    ("market", "umbrellas_in_rain", "Umbrellas cover the stalls in the rain"), ("observatory", "dome_under_stars", "The open dome under the stars"),
)


def encode(image: np.ndarray, quality: int = 85) -> tuple[bytes, str]:
    """A picture file and its suffix: JPEG with Pillow, BMP without."""
    try:
        from PIL import Image
    except ImportError:
        return write_bmp(image), ".bmp"
    out = io.BytesIO()
    Image.fromarray(image).save(out, "JPEG", quality=quality)
    return out.getvalue(), ".jpg"


def fit(image: np.ndarray, size: int) -> np.ndarray:
    """The image, at most ``size`` pixels either way."""
    height, width = image.shape[:2]
    scale = min(1.0, size / max(height, width))
    return image if scale == 1 else shrink(image, max(1, round(width * scale)), max(1, round(height * scale))).round().astype(np.uint8)


def data_url(content: bytes, size: int = 1024) -> str | None:
    image = pixels(content)
    if image is None:
        return None
    data, suffix = encode(fit(image, size), 88)
    return f"data:image/{'jpeg' if suffix == '.jpg' else 'bmp'};base64,{base64.b64encode(data).decode()}"


@F.udf(T.BinaryType())
def thumbnail(content, size):
    """A picture of at most ``size`` pixels either way. One file at a time, so that no task holds many."""
    image = pixels(bytes(content)) if content is not None else None
    return None if image is None else encode(fit(image, size))[0]


def thumbnails(spark: SparkSession, root: str, pattern: str = "*", size: int = 256) -> DataFrame:
    """Thumbnails of the images under ``root``: (path, key, picture); null pictures where an image can't be read.

    ``key`` names the image, its time, length and the size, so a cache of files by key never serves an old picture.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    key = F.md5(F.concat_ws("|", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"), F.lit(str(size))).cast("binary"))

    # a row at a time, in compiled code up to the picture: a batch holds as many files as its setting says, whatever their size
    return rows.select("path", key.alias("key"), thumbnail(F.col("content"), F.lit(size)).alias("picture"))


def save_pictures(pictures: DataFrame, folder: str) -> None:
    """Write pictures to files named by key, each to a name of its own first, so that no reader sees half a file."""

    def run(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            if r["picture"] is not None:
                data = bytes(r["picture"])
                at = os.path.join(folder, r["key"] + (".bmp" if data[:2] == b"BM" else ".jpg"))
                with open(at + ".part", "wb") as f:
                    f.write(data)
                os.replace(at + ".part", at)

    pictures.foreachPartition(run)


def class_crops(boxes: DataFrame, images: DataFrame, per_image: int = 2, per_class: int = 16, pad: float = 0.02, size: int = 256) -> DataFrame:
    """Crops of the largest boxes of each class: (cid, image, rank, key, picture). ``images`` has (image, content)."""
    chosen = top_boxes(boxes, per_image, per_class).join(images, "image")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                image = pixels(bytes(r.content))
                if image is None:
                    continue
                height, width = image.shape[:2]
                bw, bh = r.w * width, r.h * height
                x1, y1 = max(0, int((r.cx - r.w / 2) * width - bw * pad)), max(0, int((r.cy - r.h / 2) * height - bh * pad))
                x2, y2 = min(width, int((r.cx + r.w / 2) * width + bw * pad)), min(height, int((r.cy + r.h / 2) * height + bh * pad))
                if x2 > x1 and y2 > y1:
                    out.append((r.cid, r.image, r.rank, hashlib.md5(f"{r.cid}|{r.image}|{r.rank}".encode()).hexdigest(), encode(fit(image[y1:y2, x1:x2], size))[0]))
            yield pd.DataFrame(out, columns=["cid", "image", "rank", "key", "picture"])

    return chosen.select("cid", "image", "rank", "cx", "cy", "w", "h", "content").mapInPandas(run, f"cid int, image {dict(boxes.dtypes)['image']}, rank int, key string, picture binary")


def viewer_rects(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes as pixel rectangles of an image of that size."""
    return boxes.select("*", *pixel_rect(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(float(width)), F.lit(float(height))))


def sample_tree(root: str, per_scene: int = 5, seed: int = 7) -> int:
    """A tree of eight scenes with captions beside their frames, the same for the same seed. Returns the frames."""
    rng = np.random.default_rng(seed)
    for folder, scene, caption in SCENES:
        at = os.path.join(root, folder, scene)
        os.makedirs(at, exist_ok=True)
        sky, ground = rng.integers(0, 255, 3), rng.integers(0, 255, 3)
        for i in range(per_scene):
            image = np.empty((60, 80, 3), np.uint8)
            image[:30], image[30:] = sky, ground
            x = int(rng.integers(5, 60))
            image[25:40, x : x + 15] = rng.integers(0, 255, 3)
            with open(os.path.join(at, f"frame_{i:03d}.bmp"), "wb") as f:
                f.write(write_bmp(image))
            with open(os.path.join(at, f"frame_{i:03d}.txt"), "w", encoding="utf-8") as f:
                f.write(f"{caption} (frame {i + 1}/{per_scene})")
    return len(SCENES) * per_scene
