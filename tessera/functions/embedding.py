"""Deterministic stand-ins for an embedder and a captioner, and the interface for real ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.paths import basename, parent, path_text
from tessera.functions.text import collapse, concept_hints
from tessera.functions.text import TRANSLATIONS
from tessera.plans.planner import tokens, without_particle

SEED = 7_919  # of the projection of visual descriptors
VISUAL = 304  # 16 x 16 grey values and 16 bins for each of three colours


class Embedder(Protocol):
    """Unit vectors (n x dim, float32) of image files or texts, in order; must be picklable."""

    name: str
    dim: int

    def embed_image(self, paths: Sequence[str]) -> np.ndarray: ...

    def embed_text(self, texts: Sequence[str]) -> np.ndarray: ...


def bucket(feature: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(feature.encode()).digest()[:4], "little") % dim


def text_vector(text: str, dim: int) -> np.ndarray:
    """Hashed features of a text as a unit vector; the same features as :func:`tessera.functions.text.feature_tokens`."""
    v = np.zeros(dim, dtype=np.float32)
    for t in tokens(text):
        stem = without_particle(t)
        words = [("w:" + t, 3.0), *([("w:" + stem, 2.0)] if stem != t else []), *(("w:" + e, 2.0) for e in TRANSLATIONS.get(t, []) + TRANSLATIONS.get(stem, []))]
        grams = [(f"g{n}:" + t[i : i + n], w) for n, w in ((2, 1.0), (3, 0.7)) for i in range(len(t) - n + 1)]
        for feature, weight in words + grams:
            v[bucket(feature, dim)] += weight
    if not v.any():
        v[bucket("raw:" + (text or "∅"), dim)] = 1.0
    return v / np.linalg.norm(v)


def pixels(data: bytes) -> np.ndarray | None:
    """An image as height x width x 3 bytes: any format with Pillow, plain 24-bit BMP without; None if it can't be read."""
    try:
        import io

        from PIL import Image, ImageOps

        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"))  # upright, as the camera was held
    except ImportError:
        return _bmp(data)
    except Exception:  # noqa: BLE001
        return None


def _bmp(data: bytes) -> np.ndarray | None:
    if data[:2] != b"BM" or len(data) < 54 or int.from_bytes(data[28:30], "little") != 24 or int.from_bytes(data[30:34], "little"):
        return None
    start, width, height = (int.from_bytes(data[a : a + 4], "little", signed=True) for a in (10, 18, 22))
    step = (width * 3 + 3) // 4 * 4
    if width <= 0 or len(data) < start + step * abs(height):
        return None
    rows = np.frombuffer(data, np.uint8, step * abs(height), start).reshape(abs(height), step)[:, : width * 3].reshape(abs(height), width, 3)[:, :, ::-1]
    return rows[::-1] if height > 0 else rows


def write_bmp(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    step = (width * 3 + 3) // 4 * 4
    body = np.zeros((height, step), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    ints = lambda *xs: b"".join(int(x).to_bytes(4, "little") for x in xs)
    return b"BM" + ints(54 + body.size, 0, 54, 40, width, height) + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + ints(0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def shrink(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean of the pixels that fall into each cell of a grid; a grid finer than the image repeats its pixels."""
    for axis, most in ((0, height), (1, width)):
        if image.shape[axis] < most:
            image = image.take(np.arange(most) * image.shape[axis] // most, axis=axis)
    ys, xs = (np.minimum(np.arange(n) * m // n, m - 1) for n, m in ((image.shape[0], height), (image.shape[1], width)))
    flat = (ys[:, None] * width + xs[None, :]).ravel()
    channels = image.reshape(-1, image.shape[2] if image.ndim == 3 else 1).astype(np.float64)
    n = np.maximum(np.bincount(flat, minlength=width * height), 1)
    return np.stack([np.bincount(flat, channels[:, c], width * height) / n for c in range(channels.shape[1])], axis=1).reshape(height, width, -1)


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def dhash(image: np.ndarray, size: int = 8) -> int:
    """64 bits: whether each cell of a 9 x 8 grid is brighter than the one to its left; as a signed number."""
    g = shrink(grey(image)[:, :, None], size + 1, size)[:, :, 0]
    bits = (g[:, 1:] > g[:, :-1]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def visual_descriptor(image: np.ndarray | None, path: str) -> np.ndarray:
    """Grey values and a colour histogram; random numbers seeded by the path if there is no image."""
    if image is None:
        seed = int.from_bytes(hashlib.md5(path.encode()).digest()[:8], "little")
        return np.random.default_rng(seed).random(VISUAL).astype(np.float32)
    grid = shrink(grey(image)[:, :, None], 16, 16)[:, :, 0].ravel() / 255
    small = shrink(image, 32, 32)
    bins = np.concatenate([np.histogram(small[:, :, c], bins=16, range=(0, 255))[0] for c in range(3)]).astype(np.float64)
    return np.concatenate([grid, bins / max(bins.sum(), 1)]).astype(np.float32)


class HashEmbedder:
    """Embeds without a model: hashed words of the path or text, and a little of what the image looks like."""

    name = "hash"

    def __init__(self, dim: int = 512):
        self.dim = dim

    def embed_text(self, texts: Sequence[str]) -> np.ndarray:
        return np.stack([text_vector(t, self.dim) for t in texts]) if len(texts) else np.zeros((0, self.dim), np.float32)

    def embed_image(self, paths: Sequence[str], contents: Sequence[bytes | None] | None = None) -> np.ndarray:
        projection = np.random.default_rng(SEED).standard_normal((VISUAL, self.dim)).astype(np.float32)
        out = []
        for k, path in enumerate(paths):
            if contents is not None:
                data = contents[k]
            else:
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                except OSError:
                    data = None
            look = visual_descriptor(pixels(data) if data else None, path) @ projection
            folders, _, name = path.replace("\\", "/").rpartition("/")
            said = " ".join([*[p for p in folders.split("/") if p][-2:], name.rsplit(".", 1)[0]])
            v = text_vector(said, self.dim) + 0.25 * look / max(float(np.linalg.norm(look)), 1e-12)
            out.append(v / np.linalg.norm(v))
        return np.stack(out).astype(np.float32) if out else np.zeros((0, self.dim), np.float32)


def embed_images(df: DataFrame, embedder: Embedder, path_col: str = "path", batch: int = 32) -> DataFrame:
    """Adds ``embedding``; files are embedded ``batch`` at a time, those of a batch that fails one by one, the failing ones as null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list = []
            for s in range(0, len(pdf), batch):
                paths = pdf[path_col].iloc[s : s + batch].tolist()
                try:
                    found = list(embedder.embed_image(paths))
                    if len(found) != len(paths) or not np.isfinite(np.stack(found)).all():
                        raise ValueError("not finite")
                except Exception:  # noqa: BLE001
                    found = []
                    for p in paths:
                        try:
                            v = embedder.embed_image([p])[0]
                            found.append(v if np.isfinite(v).all() else None)
                        except Exception:  # noqa: BLE001
                            found.append(None)
                out += found
            yield pdf.assign(embedding=out)

    return df.mapInPandas(run, f"{df._jdf.schema().toDDL()}, embedding array<float>")


def embed_texts(embedder: Embedder):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder.embed_text([t or "" for t in texts])))

    return run


@F.pandas_udf(T.DoubleType())
def mean_brightness(content: pd.Series) -> pd.Series:
    """Mean grey value of image files; null if they can't be read."""

    def one(data):
        image = pixels(bytes(data)) if data is not None else None
        return None if image is None else float(shrink(grey(image)[:, :, None], 32, 32).mean())

    return content.map(one).astype("float64")


@F.pandas_udf(T.LongType())
def image_dhash(content: pd.Series) -> pd.Series:
    def one(data):
        image = pixels(bytes(data)) if data is not None else None
        return None if image is None else dhash(image)

    return content.map(one).astype("Int64")


def rule_caption(path: Column, brightness: Column, context: Column) -> Column:
    """A caption without a model: light, concepts named by path and context, folder, and a note of 80 characters."""
    light = F.when(brightness.isNull(), "unknown-lighting").when(brightness < 60, "dark (night)").when(brightness < 110, "dimly lit").when(brightness < 185, "normally lit").otherwise("bright (daytime)")
    hints = concept_hints(F.concat(path_text(path), F.lit(" "), F.coalesce(context, F.lit(""))))
    note = collapse(F.coalesce(context, F.lit("")))
    return F.concat(
        light, F.lit(" photo"), F.when(F.size(hints) > 0, F.concat(F.lit(" — "), F.array_join(hints, ", "))).otherwise(""), F.lit(" (folder: "), basename(parent(path)), F.lit(")"), F.when(note != "", F.concat(F.lit(". note: "), F.left(note, F.lit(80)))).otherwise("")
    )
